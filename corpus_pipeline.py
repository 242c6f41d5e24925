"""A corpus pipeline: language ID, near-duplicates, mixing to target weights, byte-level BPE.

Every stage takes documents and gives documents with the columns they came with; only the last
gives token ids.
"""

from pyspark.sql import functions as F

from txrisk.llm import bpe, langid
from txrisk.llm.catalog import mix_documents, public_tokenizer
from txrisk.llm.near_dedup import near_duplicates, with_maybe
from txrisk.session import written

ORACLE_SQL = None  # the language model and the similarity classes have no SQL form
LEAST_SCORE = 0.3  # a text of four languages in equal parts would have 0.25


def recognised(spark, docs, sf_dir):
    """Documents in a language that the labelled ones teach; null and letterless texts go.

    Without any labelled document there is nothing to reject by, so all documents stay.
    """
    model = langid.fit(docs)
    return langid.recognised(docs, model, LEAST_SCORE) if model[0] else docs


def deduplicated(spark, docs, sf_dir):
    """One document of each class of near-duplicates, the one with the smallest id.

    A document is an id with a text: rows equal in both are one, of which the smallest row stays;
    different texts under one id, and rows without an id, are documents each. An id comes before none.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.xxhash64("doc_id", "text").alias("key")
    )
    classes = near_duplicates(rows.select("key", F.col("own.text").alias("text")), "key")
    ids = rows.groupBy("key").agg(F.min("own.doc_id").alias("id"), F.count(F.lit(1)).alias("n"))
    known = written(classes.select("key", "class_id").join(ids, "key"), "document-classes")
    first = known.groupBy("class_id").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).getField("key").alias("kept")
    )
    gone = known.join(first, "class_id").withColumn("gone", F.col("key") != F.col("kept"))
    marks = written(gone.where(F.col("gone") | (F.col("n") > 1)).select(F.col("key").alias("id"), "gone"), "marked-keys")
    # Only rows that the bitmap cannot clear meet the marks, so few texts are shuffled.
    marked = with_maybe(rows, marks.select("id"), "key")
    clear = marked.where(~F.col("__maybe")).select("own")
    unsure = marked.where("__maybe").join(marks, F.col("key") == F.col("id"), "left").where(
        ~F.coalesce("gone", F.lit(False))
    )
    # A kept key may be of several rows, and (next to never) of several documents.
    unsure = unsure.withColumn("text", F.sha2(F.col("own.text"), 256))
    once = unsure.groupBy("key", F.col("own.doc_id").alias("id"), "text").agg(F.min("own").alias("own")).select("own")
    return clear.unionByName(once).select("own.*")


def mixed(spark, docs, sf_dir):
    """Documents to the target weights; one that is used in several epochs stands there as often."""
    return mix_documents(docs).select(*docs.columns)


def tokenized(spark, docs, sf_dir):
    """(doc_id, n_tokens, ids, decoded_sha256) of every document, once for each time it stands there.

    The digest is that of the text decoded from the ids, which must be the text itself.
    """
    path, pattern = public_tokenizer()
    return bpe.round_trips(docs, path, pattern)


STAGES = [
    ("language ID", recognised),
    ("MinHash near-dedup", deduplicated),
    ("mixing to target weights", mixed),
    ("byte-level BPE", tokenized),
]


def run(spark, sf_dir):
    """The stages in turn over ``documents``, each stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
