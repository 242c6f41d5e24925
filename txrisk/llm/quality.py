"""A compression classifier of quality: which of two zstandard dictionaries packs a text better?

One dictionary is trained on good and one on bad labelled text. A text is cut into segments of
``SEGMENT`` bytes, each compressed with either dictionary; the difference of the two total sizes, divided by
the text's length, is its ``difference``: positive if the good dictionary serves it better. A logistic
curve, fitted on labelled texts that the dictionaries have not seen, turns it into the probability
of label 1.

Dictionaries and curve are fitted on a bounded sample: per label up to ``DICTIONARY_TEXTS`` different
texts, one stretch of ``STRETCH`` characters of each, and up to ``CURVE_TEXTS`` others, which are scored
whole where they lie; only their differences reach the driver. Texts are drawn by hash, so copies
count once; the curve weighs both labels as all labelled texts stand. Scores read every byte of
every text, and nothing but the text.

Null and empty texts have difference 0 and the score of that. Labels other than 0 and 1, null
labels and null or empty texts are not learned from. Without a text of either label all scores are
0.5; with texts of one label only they are 1 or 0. Repeated rows get equal scores, an id with
several labels or texts counts for each pair. An empty table gives no rows. Other columns are ignored.
"""

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Window, functions as F

from txrisk.llm import words as W
from txrisk.session import written

register_pickle_by_value(sys.modules[__name__])

DICTIONARY_TEXTS, CURVE_TEXTS, STRETCH = 4000, 4000, 1024
DICTIONARY_BYTES, SEGMENT, LEVEL = 110 * 1024, 1024, 3
_OPEN = {}


@dataclass(frozen=True)
class Model:
    """``dictionaries`` of bad and good text; the curve is 1 / (1 + exp(-(slope * difference + height)))."""

    dictionaries: tuple
    slope: float = 0.0
    height: float = 0.0

    def score(self, differences):
        return 1 / (1 + np.exp(-np.clip(self.slope * np.asarray(differences) + self.height, -700, 700)))


def train_dictionary(stretches):
    """The bytes of a dictionary; too few samples for training are used as they are."""
    size = min(DICTIONARY_BYTES, sum(map(len, stretches)) // 4)
    try:
        return zstandard.train_dictionary(max(size, 256), stretches).as_bytes()
    except zstandard.ZstdError:
        return b"".join(stretches)[:DICTIONARY_BYTES]


def _compressors(dictionaries):
    """One compressor per dictionary, opened once in a worker."""
    if dictionaries not in _OPEN:
        _OPEN.clear()
        made = []
        for raw in dictionaries:
            opened = zstandard.ZstdCompressionDict(raw)
            opened.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(
                dict_data=opened, write_content_size=False, write_checksum=False, write_dict_id=False
            ))
        _OPEN[dictionaries] = made
    return _OPEN[dictionaries]


def differences(dictionaries, column):
    """(size with the bad dictionary - size with the good one) / bytes, of an Arrow text column."""
    bad, good = _compressors(dictionaries)
    out = np.zeros(len(column))
    for row, data, offsets in W.batches(column):
        raw = memoryview(data)
        for n, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            gain = 0
            for at in range(begin, end, SEGMENT):
                segment = raw[at:min(at + SEGMENT, end)]
                gain += len(bad.compress(segment)) - len(good.compress(segment))
            out[row + n] = gain / max(end - begin, 1)
    return out


def fit_curve(values, labels, weights, rounds=50):
    """(slope, height) of the logistic curve of highest weighted likelihood, by Newton's method.

    Labels are drawn in by one imagined text each, and the slope by a slight penalty, so that labels
    which a border separates have a finite curve too.
    """
    center, spread = values.mean(), values.std() or 1.0
    x = np.stack([(values - center) / spread, np.ones(len(values))])
    ones, zeros = weights[labels == 1].sum(), weights[labels == 0].sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    penalty = np.array([1e-3 * weights.sum() / len(values), 0.0])

    def loss(curve):
        z = curve @ x
        return (weights * (np.logaddexp(0, z) - target * z)).sum() + (penalty * curve * curve).sum() / 2

    curve = np.array([0.0, np.log(ones / zeros)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(curve @ x, -30, 30)))
        slope = x @ (weights * (p - target)) + penalty * curve
        bend = (x * (weights * p * (1 - p))) @ x.T + np.diag(penalty + 1e-9)
        step = np.linalg.solve(bend, slope)
        while loss(curve - step) > loss(curve) and np.abs(step).max() > 1e-12:
            step = step / 2
        curve = curve - step
        if np.abs(step).max() < 1e-10:
            break
    return curve[0] / spread, curve[1] - curve[0] * center / spread


def _drawn(docs, labels, most):
    """(h, label, n, texts): the ``most`` different texts of each label with the smallest hashes.

    Texts are told by hash, and hashes fold in the map tasks; of the pairs, whose number may be
    large, a share by hash is kept that holds the wanted number, whatever the label's size.
    """
    pairs = docs.select("id", "h").distinct().join(labels.distinct(), "id").select("label", "h").distinct()
    pairs = written(pairs, "quality-pairs")
    counts = dict(pairs.groupBy("label").count().collect())
    texts = F.coalesce(*[F.when(F.col("label") == k, F.lit(n)) for k, n in counts.items()], F.lit(0))
    place = F.col("h").cast("double") / F.lit(2.0**64) + 0.5
    order = Window.partitionBy("label").orderBy("h")
    near = pairs.withColumn("texts", texts).where(place * F.col("texts") < 3.0 * most)
    picked = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    return written(picked, "quality-picked"), counts


def fit(docs, labels, id_column="doc_id", text_column="text", label_column="quality",
        dictionary_texts=DICTIONARY_TEXTS, curve_texts=CURVE_TEXTS):
    """A :class:`Model` from documents and labels by id."""
    text = F.col(f"`{text_column}`")
    known = docs.where(text.isNotNull() & (text != "")).select(
        F.col(f"`{id_column}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("h")
    )
    label = F.col(f"`{label_column}`")
    marks = labels.where(label.isin(0, 1)).select(F.col(f"`{id_column}`").alias("id"), label.cast("int").alias("label"))
    picked, counts = _drawn(known, marks, dictionary_texts + curve_texts)
    if len(counts) < 2:
        return Model((), height=0.0 if not counts else np.inf if 1 in counts else -np.inf)
    # Texts alternate between dictionaries and curve; both sorts reach their bound together.
    cut = (dictionary_texts + curve_texts) / dictionary_texts
    for_dictionary = F.floor(F.col("n") / cut) != F.floor((F.col("n") - 1) / cut)
    start = F.pmod("h", F.greatest(F.lit(1), F.length("text") - STRETCH + 1)).cast("int") + 1
    stretches = (
        known.join(F.broadcast(picked.where(for_dictionary)), "h").groupBy("label", "h")
        .agg(F.min(F.substring("text", start, F.lit(STRETCH))).alias("stretch"))
    )
    rows = sorted(stretches.toArrow().to_pylist(), key=lambda r: (r["label"], r["h"]))
    by_label = [[r["stretch"].encode() for r in rows if r["label"] == k] for k in (0, 1)]
    if not all(by_label):
        share = counts[1] / sum(counts.values())
        return Model((), height=float(np.log(share / (1 - share))))
    model = Model(tuple(map(train_dictionary, by_label)))
    unseen = (
        known.join(F.broadcast(picked.where(~for_dictionary)), "h")
        .select(F.struct("label", "h").alias("key"), "text")
    )
    scored = _differences(unseen, model).groupBy("key").agg(F.min("difference").alias("difference"))
    table = scored.select("key.label", "key.h", "difference").toArrow().to_pandas().sort_values(["label", "h"])
    found, own = table["difference"].to_numpy(), table["label"].to_numpy()
    drawn = {k: int((own == k).sum()) for k in counts}
    if not all(drawn.values()):
        share = counts[1] / sum(counts.values())
        return Model((), height=float(np.log(share / (1 - share))))
    total = sum(counts.values())
    weight = {k: counts[k] / drawn[k] * len(own) / total for k in counts}
    slope, height = fit_curve(found, own, np.array([weight[k] for k in own]))
    return Model(model.dictionaries, float(slope), float(height))


def _differences(rows, model):
    """(key, difference) of rows (key, text)."""
    dictionaries = model.dictionaries

    def measure(tables):
        for table in tables:
            found = differences(dictionaries, table.column(1)) if dictionaries else np.zeros(table.num_rows)
            yield pa.RecordBatch.from_arrays([table.column(0), pa.array(found)], names=["key", "difference"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(measure, f"key {kind}, difference DOUBLE")


def predict(docs, model, id_column="doc_id", text_column="text"):
    """(id, difference, score) of every row."""
    rows = docs.select(F.col(f"`{id_column}`").alias("key"), F.col(f"`{text_column}`").alias("text"))
    line = F.lit(model.slope) * F.col("difference") + F.lit(model.height)
    return _differences(rows, model).select(
        F.col("key").alias(id_column), "difference", (1 / (1 + F.exp(-line))).alias("score")
    )
