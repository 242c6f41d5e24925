"""The registered queries over the smallest tables, against SQL or a brute-force version."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

from tests.conftest import DATA
from tests.test_catalog import comparable
from txrisk.llm import bpe, catalog, licenses

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in sorted(DATA.glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    yield con
    con.close()


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))


def shingles(text):
    words = tokens(text)
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_one_query_for_each_operator():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in catalog.QUERIES)
    assert numbers == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    ours = sorted(tuple(comparable(row[c]) for c in columns) for row in df.collect())
    result = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert ours == sorted(tuple(comparable(row[i]) for i in order) for row in result.fetchall())


def test_op1_finds_every_whole_template(spark, texts):
    found = {(r.doc_id, r.license) for r in catalog.op1_license_scan(spark, str(DATA)).collect()}
    wanted = set()
    for doc_id, text in texts.items():
        own = shingles(text)
        for name, template in licenses.TEMPLATES.items():
            if shingles(template) <= own and len(tokens(text)) > 4:
                wanted.add((doc_id, name))
    assert wanted and wanted <= found


def test_op3_counts_and_base_score(spark, texts):
    rows = catalog.op3_lm_scores(spark, str(DATA)).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = collections.Counter()
    for i, text in texts.items():
        if i not in held:
            counts.update(tokens(text))
            counts[None] += 1
    total, kinds = sum(counts.values()), len(counts)
    for r in rows:
        own = [*tokens(texts[r.doc_id]), None]
        assert (r.n_tokens, r.train_tokens, r.held_out) == (len(own), total, r.doc_id in held)
        assert r.n_known == sum(counts[t] > 0 for t in own)
        base = sum(np.log10((counts[t] + 1) / (total + kinds + 1)) for t in own)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    unseen = [r for r in rows if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_op5_labels_held_out_documents(spark, duck):
    rows = catalog.op5_language_id(spark, str(DATA)).collect()
    langs = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    assert sorted(r.doc_id for r in rows) == sorted(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    unseen = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in unseen) >= 0.95 * len(unseen)


def test_op6_gives_the_ids_of_the_usual_reader(spark, texts):
    import tiktoken

    path, pattern = catalog.public_tokenizer()
    usual = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rows = catalog.op6_byte_bpe(spark, str(DATA)).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = usual.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def classes_of(texts):
    """{document: smallest of its class} by comparing all pairs."""
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            shared = len(sets[a] & sets[b])
            if shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def test_op8_classes(spark, texts):
    rows = catalog.op8_near_duplicates(spark, str(DATA)).collect()
    assert {r.doc_id: r.class_id for r in rows} == classes_of(texts) and len(rows) == len(texts)


def test_op10_recall(spark, duck):
    rows = catalog.op10_nearest_neighbours(spark, str(DATA)).collect()
    ids, vectors = zip(*duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY 1").fetchall())
    matrix, hits, wanted = np.array(vectors, float), 0, 0
    for row, i in enumerate(ids):
        if i % 20 == 0:
            scores = matrix @ matrix[row]
            scores[row] = -np.inf
            best = {ids[n] for n in np.argsort(-scores)[:20]}
            own = sorted((r for r in rows if r.query_id == i), key=lambda r: r.rank)
            assert [r.rank for r in own] == list(range(1, 21))
            assert all(r.score == pytest.approx(scores[ids.index(r.vec_id)], abs=1e-12) for r in own)
            hits, wanted = hits + len(best & {r.vec_id for r in own}), wanted + 20
    assert hits >= 0.95 * wanted
