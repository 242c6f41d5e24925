"""Compression classifier, Merkle manifest and vector codes, against plain versions and on odd tables."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from txrisk.llm import catalog, codes, merkle, quality

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(150_000))


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows, arity):
    """{row: (leaf, subroot, root, siblings from the leaf to the root)} of (id, group, text) rows."""
    def climb(nodes):
        """(root, siblings of each node)"""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i:i + arity] for i in range(0, len(nodes), arity)]
            for path, place in zip(paths, at):
                run, slot = runs[place // arity], place % arity
                path.append(("".join(run[:slot]), "".join(run[slot + 1:])))
            nodes, at = [sha(*run) for run in runs], [place // arity for place in at]
        return nodes[0], paths

    def text_of(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row, sha(*map(text_of, row))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    inside = {}
    for name, members in groups.items():
        members.sort(key=lambda m: (m[0][0] is not None, m[0][0] or 0, m[1]))
        inside[name] = climb([leaf for _, leaf in members])
    root, upper = climb([inside[g][0] for g in order])
    found = []
    for place, name in enumerate(order):
        for (row, leaf), path in zip(groups[name], inside[name][1]):
            found.append((row[0], leaf, inside[name][0], root, tuple(path + upper[place])))
    return sorted(found, key=repr)


ROWS = [(i, "a", f"text {i}") for i in range(37)] + [(i, "é", None) for i in range(100, 109)] + [
    (500, "z", ""), (None, "b", "no id"), (7, "b", LONG), (7, "b", "same id"), (8, "b", "twice"), (8, "b", "twice"),
    (9, None, "no group"), (10, None, "é"), (11, "", "empty group"), (12, "Z", "alone"),
]


@pytest.mark.parametrize("arity, levels", [(2, 10), (2, 3), (3, 2)])
def test_manifest_equals_a_plain_one(spark, arity, levels):
    table = spark.createDataFrame(ROWS, "id BIGINT, tree STRING, pos STRING")  # named like inner columns
    found = merkle.manifest(
        table, ("id", "tree", "pos"), "tree", "id", arity, levels, id=F.col("id")
    ).withColumn("folded", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    ours = [(r.id, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.path)) for r in found]
    assert sorted(ours, key=repr) == plain_manifest(ROWS, arity)
    assert all(r.folded == r.root for r in found)


def test_manifest_of_few_rows(spark):
    table = spark.createDataFrame([(1, "a", "x")], "id BIGINT, lang STRING, text STRING")
    one = merkle.manifest(table, ("text",), "lang", "id").head()
    assert one.leaf == one.subroot == one.root == sha("1:x") and one.path == []
    assert merkle.manifest(table.limit(0), ("text",), "lang", "id", n=F.col("id")).collect() == []


def test_manifest_finds_tampering(spark):
    rows = catalog.op12_merkle_manifest(spark, str(DATA)).collect()
    kept = {r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if r.n_chars is not None}
    touched = {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and r.doc_id in kept}
    assert touched and {r.doc_id for r in rows if not r.verified} == touched


def test_manifest_tasks_hold_a_block_each(spark):
    """No window but those over small tables goes by less than (tree, block)."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plan = merkle.manifest(docs, ("text",), "lang", "doc_id")._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window " in line]
    assert windows and all("tree#" in line and "block#" in line for line in windows)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_transform_keeps_distances():
    rng = np.random.default_rng(5)
    for width in (1, 3, 8, 13):
        a, b = (rng.integers(-5000, 5000, (40, width)) for _ in range(2))
        x, y = codes.transformed(a), codes.transformed(b)
        assert (((x - y) ** 2).sum(axis=1) == x.shape[1] * ((a - b) ** 2).sum(axis=1)).all()
    signs = codes.transformed(np.eye(8, dtype=np.int64)).T  # rows are the transform's functions
    assert [(np.diff(row) != 0).sum() for row in signs] == list(range(8))


@pytest.mark.parametrize("kind", [np.int64, object])
def test_nearest_is_exact_with_ties(kind):
    rng = np.random.default_rng(7)
    for width, spread in itertools.product((1, 2, 5, 8), (1, 3, 4000)):
        parts = rng.integers(-spread, spread + 1, (300, width)).astype(kind)
        entries = rng.integers(-spread, spread + 1, (16, width)).astype(kind)
        entries[9] = entries[4]
        found, least = codes.nearest(codes.transformed(parts), codes.transformed(entries))
        plain = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (found == plain.argmin(axis=1)).all() and (least == plain.min(axis=1)).all()


def plain_codes(vectors, parts=8, entries=16, rounds=6):
    """{position: (code, error)} and all final entries, in Python's integers; vectors are in id order."""
    width = -(-max(map(len, vectors)) // parts)
    cut = [[tuple(([*v] + [0] * (parts * width - len(v)))[p * width:(p + 1) * width]) for p in range(parts)] for v in vectors]
    books = [[row[p] for row in cut[:entries]] for p in range(parts)]

    def near(part, own):
        return min((sum((x - y) ** 2 for x, y in zip(part, e)), n) for n, e in enumerate(own))

    for _ in range(rounds):
        for p, own in enumerate(books):
            members = [[] for _ in own]
            for row in cut:
                members[near(row[p], own)[1]].append(row[p])
            books[p] = [tuple(sum(c) // len(m) for c in zip(*m)) if m else e for m, e in zip(members, own)]
    pairs = [[near(row[p], books[p]) for p in range(parts)] for row in cut]
    return [("".join(f"{e:02x}" for _, e in row), sum(d for d, _ in row)) for row in pairs], books


@pytest.mark.parametrize("scale", [1.0, 2.0**31.5])
def test_codes_equal_plain_ones(spark, scale):
    rng = random.Random(11)
    data = [(i, [rng.gauss(0, 1) * scale / 64 for _ in range(rng.choice((9, 20)))], i % 3 or None) for i in range(60)]
    data += [(60 + i, data[i % 4][1], 5) for i in range(20)]  # repeated vectors
    odd = [(900, None, 1), (901, [1.0, None], 1), (902, [float("nan")], 1), (903, [float("inf")], None)]
    table = spark.createDataFrame(data + odd, "id BIGINT, error ARRAY<DOUBLE>, code INT").repartition(5)
    coded, books = codes.compress(table, "id", "error", "code", scale=4)
    assert books.kind == ("int" if scale == 1.0 else "object")
    plain, entries = plain_codes([[int(np.floor(4 * x)) for x in v] for _, v, _ in data])
    rows = {r.id: r for r in codes.with_label_errors(coded).collect()}
    assert {i: (r.code, r.error) for i, r in rows.items()} == {i: p for (i, _, _), p in zip(data, plain)}
    flat = ",".join(str(x) for own in entries for e in own for x in e)
    assert books.sha256() == hashlib.sha256(flat.encode()).hexdigest()
    sums = {}
    for (_, _, label), (_, error) in zip(data, plain):
        sums[label] = sums.get(label, 0) + error
    assert all(rows[i].label_error == sums[label] for i, _, label in data)


def test_codes_of_few_rows(spark):
    table = spark.createDataFrame([(1, [0.5, -0.5], 1), (1, [0.5, -0.5], 1), (None, [9.0, 9.0], 1)], "vec_id INT, embedding ARRAY<FLOAT>, label INT")
    coded, books = codes.compress(table)
    assert len(books.entries[0]) == 3 and sorted(r.error for r in coded.collect()) == [0, 0, 0]
    none, books = codes.compress(table.where("false"))
    assert books is None and codes.with_label_errors(none).collect() == []
    bare, books = codes.compress(spark.createDataFrame([(1, [], None)], "vec_id INT, embedding ARRAY<FLOAT>, label INT"))
    assert [(r.code, r.error) for r in bare.collect()] == [("00" * 8, 0)]


def test_quality_of_held_out_documents(spark):
    # The smallest tables hold a handful of bad texts to learn from; the next ones hold enough.
    folder = DATA.parent / "sf0.01"
    if not folder.exists():
        pytest.skip("needs the tables at sf0.01")
    rows = {r.doc_id: r for r in catalog.op11_quality_scores(spark, str(folder)).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()
    assert sorted(rows) == sorted(r.doc_id for r in docs)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("quality IS NOT NULL").collect()
    unseen = [r for r in labels if rows[r.doc_id].held_out]
    assert np.mean([rows[r.doc_id].predicted == r.quality for r in unseen]) >= 0.93
    good, bad = ([rows[r.doc_id].score for r in unseen if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) >= 0.95


def plain_texts(rng, n):
    words = "the river runs past old stone mills where people once made paper and cloth for towns".split()
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(60, 200))) for _ in range(n)]


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(3)
    good = plain_texts(rng, 120)
    bad = [" | ".join(t.upper().split()) + " !!!" for t in plain_texts(rng, 60)]
    texts = good + bad + [LONG, "", None, good[0], good[0]]
    table = spark.createDataFrame(list(enumerate(texts)), "id BIGINT, score STRING").unionByName(
        spark.createDataFrame([(None, good[1]), (3, good[3])], "id BIGINT, score STRING"))
    marks = [(i, 1) for i in range(120)] + [(i, 0) for i in range(120, 180)] + [(5, 5), (6, None), (7, 1), (None, 1), (181, 1), (182, 0), (9999, 0)]
    return table, spark.createDataFrame(marks, "id BIGINT, quality INT")


NAMES = {"id_column": "id", "text_column": "score"}


def test_quality_edges(judged, spark):
    table, marks = judged
    model = quality.fit(table, marks, **NAMES)
    found = quality.predict(table, model, **NAMES).toDF("id", "difference", "p").collect()
    assert len(found) == table.count() and all(0 <= r.p <= 1 for r in found)
    by_id = {r.id: r for r in found}
    assert min(by_id[i].p for i in range(120)) > 0.7 > 0.3 > max(by_id[i].p for i in range(120, 180))
    assert by_id[181].p == by_id[182].p and by_id[181].difference == 0 and by_id[0].p == by_id[183].p == by_id[184].p
    again = quality.fit(table.repartition(3), marks.repartition(2), **NAMES)
    assert again == model  # the sample does not depend on where rows lie
    for some, share in ((marks.where("quality = 1"), 1.0), (marks.where("quality = 0"), 0.0), (marks.limit(0), 0.5)):
        bare = quality.predict(table, quality.fit(table, some, **NAMES), **NAMES).toDF("id", "d", "p").collect()
        assert {r.p for r in bare} == {share}
    assert quality.predict(table.limit(0), model, **NAMES).count() == 0
    assert quality.fit(table.limit(0), marks, **NAMES).score(0.0) == 0.5


def test_differences_are_those_of_the_whole_text(judged):
    import pyarrow as pa
    import zstandard

    texts = [r[1] for r in judged[0].collect()]
    stretches = [t.encode() for t in texts[:60]], [t.encode() for t in texts[120:170]]
    dictionaries = tuple(quality.train_dictionary(list(s)) for s in reversed(stretches))
    found = quality.differences(dictionaries, pa.array(texts))
    for text, value in zip(texts, found):
        raw, sizes = (text or "").encode(), []
        for dictionary in dictionaries:
            tool = zstandard.ZstdCompressor(level=quality.LEVEL, write_content_size=False, write_checksum=False,
                                            write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(dictionary))
            sizes.append(sum(len(tool.compress(raw[i:i + quality.SEGMENT])) for i in range(0, len(raw), quality.SEGMENT)))
        assert value == pytest.approx((sizes[0] - sizes[1]) / max(len(raw), 1))


def test_curve_has_the_highest_likelihood():
    rng = np.random.default_rng(2)
    values = rng.normal(size=400)
    labels = (rng.random(400) < 1 / (1 + np.exp(-(2 * values - 1)))).astype(int)
    slope, height = quality.fit_curve(values, labels, np.ones(400))
    assert slope == pytest.approx(2, abs=0.6) and height == pytest.approx(-1, abs=0.5)
    slope, height = quality.fit_curve(np.array([-1.0, -0.5, 0.5, 1.0]), np.array([0, 0, 1, 1]), np.ones(4))
    assert slope > 0 and np.isfinite([slope, height]).all()
    assert np.isfinite(quality.fit_curve(np.zeros(4), np.array([0, 0, 1, 1]), np.ones(4))).all()
