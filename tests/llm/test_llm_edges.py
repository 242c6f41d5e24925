"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm_queries import classes_of
from txrisk.llm import ann, bpe, catalog, chat, components, langid, licenses, lm, mixing, near_dedup, topk, url_filter
from txrisk.llm import words as W

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(150_000))
ROWS = [
    (1, "one two three four five six seven eight nine ten", "a"), (2, None, "b"), (3, "", "c"), (4, "  \n\t ", "d"),
    (5, LONG, "e"), (6, "one two three four five six seven eight nine ten", "f"), (6, "one two three four five six seven eight nine ten", "f"),
    (7, "short text", "g"), (8, "12 34 !!", "h"), (9, "émigré naïve été où là déjà garçon", "i"),
]
CLASH = "id BIGINT, body STRING, score STRING"


@pytest.fixture(scope="module")
def rows(spark):
    """A table whose other column is called like a result column."""
    return spark.createDataFrame(ROWS, CLASH)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASH)


NAMES = {"id_column": "id", "text_column": "body"}


def test_word_hashes_are_those_of_the_words():
    raw = "Ab  cd\tAB\x0b\x0ccd e".encode() + b"" + "x y".encode()
    offsets = np.array([0, len(raw) - 3, len(raw) - 3, len(raw)])
    text, start, end, hashes = W.words(np.frombuffer(raw, np.uint8), offsets)
    assert [raw[a:b].decode() for a, b in zip(start, end)] == ["Ab", "cd", "AB", "cd", "e", "x", "y"]
    assert text.tolist() == [0, 0, 0, 0, 0, 2, 2]
    assert hashes[0] == hashes[2] and hashes[1] == hashes[3] and len(set(hashes.tolist())) == 5


def test_word_hashes_do_not_depend_on_place():
    raw = LONG.encode()
    data = np.frombuffer(raw, np.uint8)
    whole = W.words(data, np.array([0, len(raw)]))[3]
    cut = len(" ".join(LONG.split()[:1000]).encode())
    parts = W.words(data, np.array([0, cut, len(raw)]))[3]
    assert (whole == parts).all() and len(whole) == 150_000


def test_licenses(rows, empty, spark):
    assert licenses.scan(rows, **NAMES).count() == 0 and licenses.scan(empty, **NAMES).count() == 0
    template = licenses.TEMPLATES["mit"].split()
    edited = [*template]
    edited[40] = edited[80] = "altered"  # 10 of the 83 shingles go
    broken = [w if i % 9 else "altered" for i, w in enumerate(template)]
    noise = LONG.split()[:5000]
    table = spark.createDataFrame(
        [(1, " ".join([*noise, *template, *noise, *template])), (2, " ".join([*noise, *edited])),
         (3, " ".join(broken)), (4, " ".join(template[:60])), (5, " ".join(template).upper())],
        "id BIGINT, body STRING",
    )
    found = licenses.scan(table, **NAMES).where("license = 'mit'").orderBy("id", "first_word").collect()
    assert [r.id for r in found] == [1, 1, 2, 5]
    assert [r.first_word for r in found] == [5000, 10000 + len(template), 5000, 0]
    assert found[0].last_word == 5000 + len(template) - 1 and found[0].containment == 1.0
    assert 0.8 <= found[2].containment < 1
    with pytest.raises(ValueError):
        licenses.Templates({"tiny": "only four words here"})
    assert licenses.scan(rows, {}, **NAMES).count() == 0


def test_chat_fold(spark):
    events = spark.createDataFrame([
        (1, 1, 0, "message", "user", "a<|im_end|>b"), (1, 2, 1, "message", "assistant", "x"), (1, 3, 1, "delta", None, "y\\"),
        (1, 4, 2, "message", "user", "gone"), (1, 5, 1, "regenerate", None, None), (1, 6, 1, "delta", None, "new"),
        (1, 7, 1, "delta", None, " text"), (1, 8, 3, "message", "user\nassistant", "<\\|"), (1, 9, 4, "what", "user", "ignored"),
        (None, 1, 0, "delta", None, "alone"), (2, 1, 0, "message", "assistant", None), (2, 1, 0, "message", "assistant", None),
        (3, 1, 0, "message", "user", "q"), (3, 2, 1, "message", "assistant", "r"), (3, 3, 0, "edit", None, "edited"),
    ], "conv_id BIGINT, seq BIGINT, message BIGINT, kind STRING, role STRING, text STRING")
    folded = {(r.conv_id, r.message): (r.role, r.text) for r in chat.fold_events(events).collect()}
    assert folded == {
        (1, 0): ("user", "a<|im_end|>b"), (1, 1): ("assistant", "new text"), (1, 3): ("user\nassistant", "<\\|"),
        (None, 0): ("", "alone"), (2, 0): ("assistant", ""), (3, 0): ("user", "edited"),
    }
    parts = chat.render_messages(chat.fold_events(events), segment_chars=10)
    assert parts.where("conv_id = 1").count() == 3
    assert all(r.formatted.count(chat.START) == r.formatted.count(chat.END) == 1 for r in parts.collect())
    small = {r.conv_id: r for r in chat.read_back(parts).collect()}
    whole = {r.conv_id: r for r in chat.read_back(chat.render_messages(chat.fold_events(events))).collect()}
    assert small == whole and whole[1].n_turns == 3 and whole[1].loss_chars == 8 and whole[2].loss_chars == 0
    assert chat.fold_events(events.limit(0)).count() == 0


def test_lm_edges(rows, empty, spark):
    model = lm.fit(rows, "body")
    found = {r.id: r for r in lm.score(rows, model, **NAMES).collect()}
    assert lm.score(rows, model, **NAMES).count() == len(ROWS) and found[2].n_tokens == found[3].n_tokens == 1
    assert found[1].score == found[6].score and found[5].n_tokens == 150_001
    assert lm.score(empty, model, **NAMES).count() == 0
    nothing = lm.fit(empty, "body")
    assert all(r.score == 0 and r.n_known == 0 for r in lm.score(rows, nothing, **NAMES).collect())


def kneser_ney(texts, order):
    """Reference model with dictionaries: probability of a token after a context."""
    levels, tokens = {order: {}}, {}
    for words in texts:
        row = ["<"] * (order - 1) + words + [">"]
        for i in range(order - 1, len(row)):
            gram = tuple(row[i - order + 1:i + 1])
            levels[order][gram] = levels[order].get(gram, 0) + 1
            for level in range(1, order):
                tokens[gram[-level:]] = tokens.get(gram[-level:], 0) + 1
    for level in range(order - 1, 0, -1):
        levels[level] = {}
        for gram in levels[level + 1]:
            levels[level][gram[1:]] = levels[level].get(gram[1:], 0) + 1
        for gram in levels[level]:
            if gram[0] == "<":  # nothing but the start stands before the start of a text
                levels[level][gram] = tokens[gram]
    discounts = {}
    for level, grams in levels.items():
        ns = [sum(c == k for c in grams.values()) for k in (1, 2, 3, 4)]
        discounts[level] = lm._discounts([0, 0, 0, *ns])

    def probability(gram):
        level = len(gram)
        d = [0, *discounts[level]] if level else None
        if not level:
            return 1 / (len(levels[1]) + 1)
        after = {g: c for g, c in levels[level].items() if g[:-1] == gram[:-1]}
        if not after:
            return probability(gram[1:])
        own, total = after.get(gram, 0), sum(after.values())
        spread = sum(d[min(c, 3)] for c in after.values())
        return (own - d[min(own, 3)] + spread * probability(gram[1:])) / total

    return probability, {g[0] for g in levels[1]}


@pytest.mark.parametrize("order, kinds, numbered", [(2, 120, 20), (3, 7, 1000), (3, 120, 0), (3, 120, 1000), (4, 120, 20)])
def test_lm_is_modified_kneser_ney(spark, order, kinds, numbered, monkeypatch):
    """With few kinds all contexts are hot, with many most are not; words with and without numbers."""
    monkeypatch.setattr(lm, "NUMBERED_WORDS", numbered)
    monkeypatch.setattr(lm, "RANGES_PER_PARTITION", 1)
    rng = random.Random(5)
    vocabulary = ["a", *(f"w{i}" for i in range(1, kinds))]
    texts = [[vocabulary[int(kinds * rng.random() ** 3)] for _ in range(rng.randint(0, 12))] for _ in range(60)]
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id BIGINT, body STRING")
    model = lm.fit(table, "body", order)
    probability, known = kneser_ney(texts, order)
    for context in (("a",) * (order - 1), ("<",) * (order - 1), ("z",) * (order - 1)):
        assert sum(probability((*context, w)) for w in [*known, "new"]) == pytest.approx(1)
    asked = [*texts[:10], ["a", "new", "b"], ["new", "newer"], []]
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(asked)], "id BIGINT, body STRING")
    for r in lm.score(table, model, **NAMES).collect():
        row = ["<"] * (order - 1) + asked[r.id] + [">"]
        logs = [np.log10(probability(tuple(row[i - order + 1:i + 1]))) for i in range(order - 1, len(row))]
        assert r.score == pytest.approx(sum(logs)) and r.perplexity == pytest.approx(10 ** (-sum(logs) / len(logs)))


def test_registered_lm_sees_two_words_of_context(spark, tmp_path):
    rng = random.Random(6)
    texts = {i: [rng.choice("abcdefg") for _ in range(rng.randint(0, 12))] for i in range(60)}
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id BIGINT, text STRING")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    probability, _ = kneser_ney([t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2], 3)
    for r in catalog.op3_lm_scores(spark, str(tmp_path)).collect():
        row = ["<", "<", *texts[r.doc_id], ">"]
        logs = [np.log10(probability(tuple(row[i - 2:i + 1]))) for i in range(2, len(row))]
        assert r.score == pytest.approx(sum(logs))


def test_lm_looks_each_word_up_once(spark, monkeypatch):
    table = spark.createDataFrame([(i, "a b a a c b a") for i in range(20)], "id BIGINT, body STRING")
    model, asked, names = lm.fit(table, "body"), [], lm._names
    monkeypatch.setattr(lm, "_names", lambda folder, hashes: asked.append(hashes.tolist()) or names(folder, hashes))
    data = np.frombuffer(b"a b a a c b a", np.uint8)
    text, hashes = lm.token_rows(data, np.array([0, len(data)]))
    logs, tokens = lm._log_probabilities(model, text, hashes)
    assert len(asked) == 1 and sorted(asked[0]) == sorted(set(hashes.tolist())) and len(logs) == 8
    assert tokens.tolist() == [80, 40, 80, 80, 20, 40, 80, 20]


def test_packed_counts():
    counts = np.array([0, 1, 254, 255, 256, 70_000, 3])
    assert lm.unpack(*lm.pack(counts)).tolist() == counts.tolist()
    assert lm._found(*lm.pack(counts), np.array([5, 0, 3, 6])).tolist() == [70_000, 0, 255, 3]


def test_urls(spark):
    urls = [
        "http://A.Example.ORG/es/x", "http://example.org/en/1", "http://example.org/en/12", "http://notexample.org/es/",
        "x://com/fr/", "x://com/fr", "no scheme", None, "http://org?/q", "http://example.org", "http://com:80/de/", "",
        "http://b.com/de/#/fr/", "http://b.com/de/", "http://b.com/de/",
    ]
    table = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)], "page_id BIGINT, link STRING, verdict STRING")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(table, catalog.URL_RULES, "link").collect()}
    assert len(found) == len(urls)
    assert found[0] == ("a.example.org", "/es/x", "example.org/es/", "block") and found[2][2:] == ("example.org/en/1", "block")
    assert found[3][2:] == ("org/", "allow") and found[4][2:] == ("com/fr/", "allow") and found[5][2:] == (None, "allow")
    assert found[6] == found[7] == found[11] == ("", "", None, "allow") and found[8][:3] == ("org", "", None)
    assert found[10][2] is None and found[12] == ("b.com", "/de/", "com/de/", "block") == found[13] == found[14]
    assert url_filter.judge_urls(table.limit(0), catalog.URL_RULES, "link").count() == 0
    with pytest.raises(ValueError):
        url_filter.RuleTrie(catalog.URL_RULES, max_rules=4)


def test_trie_agrees_with_a_plain_scan():
    rng = random.Random(2)
    hosts, paths = ["a", "b.a", "c.b.a", "d"], ["/", "/x", "/x/", "/x/y", "/xy", "/y/z/"]
    rules = [(rng.choice(["allow", "block"]), h, p) for h in hosts for p in paths if rng.random() < 0.6]
    trie = url_filter.RuleTrie(rules)
    for _ in range(500):
        host, path = ".".join(rng.choices("abcd", k=rng.randint(1, 4))), "/" + "/".join(rng.choices(["x", "y", "xy", "z", ""], k=3))
        fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert trie.match(host, path) == (max(fits)[3:] if fits else (None, None))


def test_language_edges(rows, empty):
    labelled = rows.withColumn("lang", F.when(F.col("id") == 9, "fr").when(F.col("id") == 1, "en"))
    model = langid.fit(labelled, "body")
    found = {r.id: (r.lang_pred, r.score) for r in langid.predict(rows, model, **NAMES).collect()}
    assert model[0] == ["en", "fr"] and found[9][0] == "fr" and found[1][0] == "en" and found[1] == found[6]
    assert all(found[i] == ("und", 0.0) for i in (2, 3, 4, 8)) and found[5][1] > 0
    assert langid.predict(rows, model, **NAMES).count() == len(ROWS)
    assert langid.predict(empty, model, **NAMES).count() == 0
    untaught = langid.fit(rows.withColumn("lang", F.lit(None).cast("string")), "body")
    assert {r.lang_pred for r in langid.predict(rows, untaught, **NAMES).collect()} == {"und"}
    kept = langid.recognised(rows, model, 0.0, "body")
    assert kept.columns == rows.columns and sorted(r.id for r in kept.collect()) == [1, 5, 6, 6, 7, 9]


def test_copies_take_no_other_text_out_of_the_training(spark, monkeypatch):
    """One language is nearly all copies of one page, another one nothing but copies."""
    pages = [(f"page {i} of the {lang} texts", lang) for lang in ("en", "fr") for i in range(30)]
    copied = spark.range(20_000).select(F.lit("la page").alias("body"), F.lit("fr").alias("lang"))
    only = spark.range(20_000).select(F.lit("una pagina").alias("body"), F.lit("es").alias("lang"))
    labelled = spark.createDataFrame(pages, "body STRING, lang STRING").unionByName(copied).unionByName(only)
    monkeypatch.setattr(langid, "train_network", lambda stretches, labels, languages: (stretches, labels))
    languages, (stretches, labels) = langid.fit(labelled, "body", docs_per_language=20)
    assert languages == ["en", "es", "fr"] and np.bincount(labels).tolist() == [20, 1, 20]
    assert len(set(stretches)) == 41


def test_gradients_by_differences():
    rng = np.random.default_rng(2)
    network = {k: v.astype(np.float64) for k, v in langid.new_network(3, rng, hidden=4).items()}
    cut, sizes, target = rng.integers(0, 256, (5, 7)).astype(np.uint8), np.array([7, 3, 7, 5, 6]), np.array([0, 1, 2, 1, 0])

    def loss():
        total = 0
        for place, shares in langid.position_probabilities(network, cut):
            total -= (np.log(shares[target, np.arange(5)]) * (place < sizes)).sum()
        return total / sizes.sum()

    slopes = langid._gradients(network, cut, sizes, target)
    for name, value in network.items():
        at = np.unravel_index(np.abs(slopes[name]).argmax(), value.shape)
        value[at] += 1e-5
        above = loss()
        value[at] -= 2e-5
        below = loss()
        value[at] += 1e-5
        assert slopes[name][at] == pytest.approx((above - below) / 2e-5, rel=1e-3)


def test_bpe_edges(rows, empty):
    path, pattern = catalog.public_tokenizer()
    encoded = bpe.encode_texts(rows, path, pattern, **NAMES)
    back = {r.id: r for r in bpe.decode_ids(encoded, path, pattern, "id").collect()}
    assert encoded.count() == len(ROWS) and back[2].n_tokens == back[3].n_tokens == 0
    assert all(back[i].decoded.decode() == (text or "") for i, text, _ in ROWS)
    assert bpe.decode_ids(bpe.encode_texts(empty, path, pattern, **NAMES), path, pattern, "id").count() == 0


def test_bpe_on_odd_texts():
    import tiktoken

    path, pattern = catalog.public_tokenizer()
    own = bpe.Codec(path, pattern)
    usual = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    pool = [*map(chr, range(32, 127)), *"\t\n\r\x85\xa0\u2028\u3000\x1c\x1f\u200bé中😀\u0301٠▁Ġ\0"]
    rng = random.Random(1)
    odd = ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(3000)]
    for text in [*odd, "a" * 20_000, " " * 3000, "é" * 3000, "▁▁ <unk> <s> <|endoftext|>"]:
        ids = np.frombuffer(own.encode(text), np.uint32)
        assert ids.tolist() == usual.encode_ordinary(text) and own.decode(ids) == text.encode()


def test_top_k_edges(spark):
    vectors = [
        (0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]),
        (6, [float("inf"), 0.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [2.0]), (None, [9.0, 9.0]), (9, []),
    ]
    table = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id BIGINT, embedding ARRAY<FLOAT>, rank STRING")
    rows = topk.scaled(table)
    found = topk.top_k(rows, rows.where("vec_id % 100 = 0"), k=4).orderBy("query_id", "rank").collect()
    m = 1024 * 1024
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in found] == [
        (0, 1, 8, 2 * m), (0, 2, 1, m), (0, 3, 2, m), (0, 4, 7, m),
        (100, 1, 1, m), (100, 2, 2, m), (100, 3, 7, m), (100, 4, 7, m),
    ]
    assert topk.top_k(rows, rows.where("vec_id = 0"), k=50).count() == 7
    assert topk.top_k(rows.limit(0), rows.where("vec_id = 0")).count() == 0
    assert topk.top_k(rows, rows.limit(0)).count() == 0


def test_top_k_against_brute_force_in_blocks(spark):
    rng = np.random.default_rng(3)
    table = rng.integers(-900, 900, (700, 13))
    table[200:500] = table[7]
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(table)], "vec_id BIGINT, vector ARRAY<BIGINT>")
    found = topk.top_k(rows, rows.where("vec_id % 10 = 0"), k=5, query_block=16).orderBy("query_id", "rank").collect()
    for q in range(0, 700, 10):
        scores = table @ table[q]
        order = [i for i in np.lexsort((np.arange(700), -scores)) if i != q][:5]
        assert [(r.vec_id, r.score) for r in found if r.query_id == q] == [(i, scores[i]) for i in order]


def test_nearest_edges(spark):
    vectors = [
        (0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [3.0, 0.0]), (6, [3.0, 0.0]),
        (6, [3.0, 0.0]), (20, [0.0, 1.0]), (7, [-1.0, 0.5]), (None, [5.0, 5.0]), (8, [float("inf"), 1.0]),
    ]
    table = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id BIGINT, embedding ARRAY<FLOAT>, score STRING")
    found = ann.nearest(table, table.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in found] == [
        (0, 1, 5, 3.0), (0, 2, 6, 3.0), (0, 3, 20, 0.0), (0, 4, 7, -1.0),
        (20, 1, 7, 0.5), (20, 2, 0, 0.0), (20, 3, 5, 0.0), (20, 4, 6, 0.0),
    ]
    assert ann.nearest(table.limit(0), table.where("vec_id = 0")).count() == 0


def test_a_common_vector_does_not_hide_the_others(spark):
    rng = np.random.default_rng(1)
    table = rng.standard_normal((3000, 32))
    table[:1000] = table[0] + rng.standard_normal((1000, 32)) * 0.01
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(table)], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    found = ann.nearest(rows, rows.where("vec_id % 60 = 0")).collect()
    hits = 0
    for q in range(0, 3000, 60):
        scores = table @ table[q]
        scores[q] = -np.inf
        hits += len({r.vec_id for r in found if r.query_id == q} & set(np.argsort(-scores)[:20].tolist()))
    assert hits >= 0.9 * 20 * 50


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 7), (5, 5), (9, 3)] + [(1, i) for i in range(200, 260)]
    table = spark.createDataFrame(edges, "u BIGINT, v BIGINT")
    found = {r.node: r.root for r in components.components(table).collect()}
    assert found == {**{i: 100 for i in range(101, 161)}, 7: 3, 9: 3, **{i: 1 for i in range(200, 260)}}
    assert components.components(table.limit(0)).count() == 0


def test_components_that_are_known_take_no_round(spark, monkeypatch):
    """Stars come back as they are, and a chain still takes rounds."""
    rounds, star = [], components._large_star
    monkeypatch.setattr(components, "_large_star", lambda edges: rounds.append(1) or star(edges))
    stars = spark.createDataFrame([(2, 1), (3, 1), (1, 3), (9, 4), (4, 4)], "u BIGINT, v BIGINT")
    assert {r.node: r.root for r in components.components(stars).collect()} == {2: 1, 3: 1, 9: 4}
    assert not rounds
    chain = spark.createDataFrame([(2, 1), (3, 2), (9, 3)], "u BIGINT, v BIGINT")
    assert {r.node: r.root for r in components.components(chain).collect()} == {2: 1, 3: 1, 9: 1}
    assert rounds


def test_near_duplicates_edges(rows, empty):
    found = {r.id: r.class_id for r in near_dedup.near_duplicates(rows, **NAMES).collect()}
    assert found == {1: 1, 6: 1, **{i: i for i in (2, 3, 4, 5, 7, 8, 9)}}
    assert near_dedup.near_duplicates(empty, **NAMES).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    """Copies of one text with more and more edits, and a second family inside the same buckets."""
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    other = base[:100] + [f"v{i}" for i in range(20)]

    def edited(words, edits):
        words = [*words]
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
        return " ".join(words)

    texts = {i: edited(base, i % 7) for i in range(1, 160)}
    texts |= {i: edited(other, i % 5) for i in range(200, 260)}
    texts[400] = " ".join(reversed(base))
    table = spark.createDataFrame(list(texts.items()), "id BIGINT, body STRING")
    found = {r.id: r.class_id for r in near_dedup.near_duplicates(table, **NAMES).collect()}
    assert found == classes_of(texts)


def test_near_duplicates_that_repeat_lines_unequally(spark):
    """Pages of equal lines, of which each repeats another half: all are similar as sets."""
    texts = {}
    for page in range(30):
        lines = [" ".join(f"p{page}l{line}w{word}" for word in range(40)) for line in range(10)]
        for half in range(2):
            repeated = [" ".join([line] * (30 if i % 2 == half else 1)) for i, line in enumerate(lines)]
            texts[2 * page + half] = " ".join(repeated)
    table = spark.createDataFrame(list(texts.items()), "id BIGINT, body STRING")
    found = {r.id: r.class_id for r in near_dedup.near_duplicates(table, **NAMES).collect()}
    assert found == classes_of(texts) == {i: i - i % 2 for i in texts}


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(8)
    items = rng.integers(1, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(1, 9, 300).astype(float), rng.integers(1, 9, 300).astype(float)
    a[:60], b[60:120] = 0, 0
    both = (a > 0) & (b > 0)
    truth = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in np.flatnonzero(both))
    text = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
    signs = near_dedup.prob_min_hash(
        2, text, np.concatenate([items[a > 0], items[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 1 << 14
    )
    assert (signs[0] == signs[1]).mean() == pytest.approx(truth, abs=0.02)


def test_filter_by_bitmap_loses_no_row(spark):
    table = spark.range(5000).withColumn("x", F.lit(1))
    ids = table.where("id % 7 = 0").select("id")
    found = {r.id for r in near_dedup.maybe_among(table, ids).collect()}
    assert set(range(0, 5000, 7)) <= found and len(found) < 730
    assert set(range(0, 5000, 7)) <= {r.id for r in near_dedup.maybe_among(table, ids, bits=8).collect()}


def test_mixing_edges(spark, rows, empty):
    levels = [F.lit("d"), F.when(F.col("id") > 5, "x"), F.col("score")]
    for share in (0.5, 1.0, 2.5, 9.0):
        found = mixing.mix(rows, levels, {}, share=share, **NAMES)
        assert found.columns[:3] == rows.columns and found.count() > 0
    assert mixing.mix(empty, levels, {}, **NAMES).count() == 0
    assert mixing.mix(rows, levels, {("d",): 0}, **NAMES).count() == 0


def plain_prefix(rows, tokens, seed=mixing.SEED):
    """{row number: copies} of one leaf of (id, body) rows with a budget."""
    sizes = [len((body or "").split()) for _, body in rows]
    whole, rest = divmod(tokens, sum(sizes))

    def place(n):
        key = ":".join(str(x) for x in (rows[n][0], seed, whole) if x is not None)
        return hashlib.md5(key.encode()).hexdigest(), rows[n][0] is not None, rows[n][0] or 0, sizes[n]

    copies, before = {}, 0
    for n in sorted(range(len(rows)), key=place):
        copies[n] = whole + (before < rest)
        before += sizes[n]
    return copies


@pytest.mark.parametrize("digits", [1, 3])
def test_mixing_equals_a_plain_prefix(spark, digits):
    rng = random.Random(4)
    data = [(i, "w " * rng.randrange(6)) for i in range(300)] + [(7, "w w w")] * 150 + [(None, "w")] * 20 + [(400, None)]
    table = spark.createDataFrame(data, "id BIGINT, body STRING").repartition(6)
    for tokens in (1, 150, 700, 1211, 2000):
        found = mixing.mix(table, [F.lit("d"), F.lit("l"), F.lit("s")], {}, total_tokens=tokens, digits=digits, **NAMES)
        ours = collections.Counter((r.id, r.body) for r in found.collect())
        wanted = collections.Counter()
        for n, copies in plain_prefix(data, tokens).items():
            wanted[data[n]] += copies
        assert ours == +wanted, tokens


def test_leaves_without_tokens_are_kept(spark):
    data = [(1, "a b c", "x"), (2, None, "y"), (3, " ", "y"), (3, " ", "y"), (4, "", "z"), (5, "d e", "x")]
    table = spark.createDataFrame(data, "id BIGINT, body STRING, source STRING")
    levels = [F.lit("d"), F.lit("l"), F.col("source")]
    found = mixing.mix(table, levels, {("d", "l", "z"): 0}, **NAMES).collect()
    assert sorted(r.id for r in found) == [1, 2, 3, 3, 5] and {r.copy for r in found} == {1}
    none = mixing.mix(table.where("source = 'y'"), levels, {}, **NAMES)
    assert sorted(r.id for r in none.collect()) == [2, 3, 3]


def test_mixing_keeps_columns_whatever_their_names(spark):
    names = ["id", "body", "own", "border", "rest", "digest", "tokens", "__bucket", "place", "a.b"]
    table = spark.createDataFrame([(1, "x y", *names[2:])], names)
    found = mixing.mix(table, [F.lit("d"), F.lit("l"), F.col("own")], {}, **NAMES)
    assert found.columns == [*names, *mixing.LEVELS, "__tokens", "copy"]
    assert found.first()[:len(names)] == (1, "x y", *names[2:])
    taken = table.select("id", "body", F.lit("old").alias("__level1"), F.lit("old").alias("__tokens"), F.lit("old").alias("copy"))
    row = mixing.mix(taken, [F.lit("d"), F.lit("l"), F.lit("s")], {}, **NAMES)
    assert len(set(row.columns)) == len(row.columns) and "old" not in row.first()


def test_shortages_go_to_siblings_first(spark):
    """Domain a is 80 of 100 by weight; its language x has too little, so y gets more, not b."""
    leaves = [("a", "x", "s", 5), ("a", "y", "s", 1000), ("b", "x", "s", 1000), ("b", "y", "t", 3), ("c", "z", "s", 2)]
    table = spark.createDataFrame(leaves, "__level1 STRING, __level2 STRING, __level3 STRING, tokens BIGINT")
    weights = {("a",): 8, ("b",): 1, ("c",): 1}
    found = {(r[0], r[1], r[2]): r.budget for r in mixing.leaf_budgets(table, weights, 100, max_epochs=2).collect()}
    # c can use 4 of its 10; the 6 left go to a and b by 8 to 1, 85 and 10 (cut to whole tokens).
    assert found == {("a", "x", "s"): 10, ("a", "y", "s"): 75, ("b", "x", "s"): 5, ("b", "y", "t"): 5, ("c", "z", "s"): 4}


def test_a_leaf_keeps_the_shortest_prefix_of_its_epoch(spark):
    table = spark.createDataFrame([(i, "w " * (i % 5 + 1), "s") for i in range(200)], "id BIGINT, body STRING, source STRING")
    levels = [F.lit("d"), F.lit("l"), F.col("source")]
    found = mixing.mix(table, levels, {}, total_tokens=1300, digits=1, **NAMES).collect()
    copies = {}
    for r in found:
        copies[r.id] = max(copies.get(r.id, 0), r.copy)
    more = [i for i, n in copies.items() if n == 3]
    assert len(copies) == 200 and set(copies.values()) == {2, 3}
    tokens = sum(i % 5 + 1 for i in more)
    assert 100 <= tokens < 105 and sum(r.body.count("w") for r in found) == 1200 + tokens
