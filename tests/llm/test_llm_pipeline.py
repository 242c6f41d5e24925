"""The pipeline's stages on a small corpus, each against what it must keep."""

import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import DATA
from tests.llm.test_llm_queries import classes_of
from txrisk.llm import bpe, catalog


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame(
        [(90001, None, "en", "src1", 0), (90002, "123 456 !!", "en", "src1", 10), (90003, "", None, None, 0)], docs.schema
    )
    docs = docs.unionByName(odd).unionByName(docs.where("doc_id < 5"))
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "MinHash near-dedup", "mixing to target weights", "byte-level BPE"]

    known = corpus_pipeline.recognised(spark, docs, str(DATA)).persist()
    assert known.columns == docs.columns
    gone = {r.doc_id for r in docs.select("doc_id").subtract(known.select("doc_id")).collect()}
    assert {90001, 90002, 90003} <= gone and len(gone) <= 5

    single = corpus_pipeline.deduplicated(spark, known, str(DATA)).persist()
    rows = known.collect()
    classes = classes_of({r.doc_id: r.text for r in rows})
    assert single.columns == docs.columns
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(classes.values()))

    mixture = corpus_pipeline.mixed(spark, single, str(DATA)).persist()
    assert mixture.columns == docs.columns and 0 < mixture.count()
    wanted = catalog.mix_documents(single).groupBy("doc_id").agg(F.max("copy").alias("n"))
    assert {(r.doc_id, r["count"]) for r in mixture.groupBy("doc_id").count().collect()} == {(r.doc_id, r.n) for r in wanted.collect()}

    ids = corpus_pipeline.tokenized(spark, mixture, str(DATA))
    digests = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in mixture.collect()}
    assert all(r.decoded_sha256 == digests[r.doc_id] for r in ids.collect())
    texts = {r.doc_id: r.text for r in mixture.collect()}
    own = bpe.Codec(*catalog.public_tokenizer())
    found = ids.collect()
    assert len(found) == mixture.count()
    assert all(own.decode(r.ids).decode() == texts[r.doc_id] for r in found)


def test_run_gives_the_last_stage(spark):
    found = corpus_pipeline.run(spark, str(DATA))
    assert found.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and found.count() > 0


def test_an_empty_corpus_passes(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(DATA))
    assert docs.count() == 0


def test_documents_are_ids_with_texts(spark):
    """Repeated ids with other texts, rows without an id, and columns named like the stage's own."""
    def words(k):
        return " ".join(f"{k}w{i}" for i in range(60))

    near = words("a").replace("aw30", "other")
    data = [
        (0, words("a")), (0, words("b")), (0, words("c")), (0, words("c")), (1, near), (None, words("d")),
        (None, words("d")), (None, words("b")), (5, words("d")), (6, ""), (6, None), (None, None), (7, words("e").upper()),
        (8, words("e")),
    ]
    docs = spark.createDataFrame([(*row, "x", "y", "z", 1) for row in data], "doc_id BIGINT, text STRING, key STRING, own STRING, __bucket STRING, n INT")
    found = corpus_pipeline.deduplicated(spark, docs, str(DATA))
    assert found.columns == docs.columns
    rows = found.collect()
    kept = sorted(((r.doc_id, r.text) for r in rows), key=repr)
    assert kept == sorted([
        (0, words("a")), (0, words("b")), (0, words("c")), (5, words("d")), (6, ""), (6, None), (None, None),
        (7, words("e").upper()),
    ], key=repr)
    assert {r[2:] for r in rows} == {("x", "y", "z", 1)}
    flagged = docs.withColumn("lettered", F.lit("mine")).withColumn("lang", F.lit("en"))
    known = corpus_pipeline.recognised(spark, flagged, str(DATA))
    assert known.columns == flagged.columns and {r.lettered for r in known.collect()} == {"mine"}
