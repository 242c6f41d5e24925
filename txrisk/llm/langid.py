"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent networks read windows of bytes, one forwards and one backwards; every position
gets a probability for each language, and a document's probability is the mean over all its bytes.
Gates are hard (clipped straight lines), the candidate state is a tanh. Training is plain numpy:
backpropagation through time over windows of ``WINDOW`` bytes, with Adam, all languages equally
often.

The network learns from a bounded sample: per language up to ``DOCS_PER_LANGUAGE`` different labelled
texts, those with the smallest hashes, and of each one stretch of ``STRETCH`` characters. Prediction
reads every byte of every text and looks at nothing but the text.

Null texts and texts without a letter are ``und`` with score 0, and so is everything when there is
no labelled document to learn from. Rows with a null text or language are not learned from.
Repeated texts get equal predictions; an empty table gives no rows. Columns other than id, text and
language are ignored.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Window, functions as F

from txrisk.llm import words as W

register_pickle_by_value(sys.modules[__name__])

HIDDEN, WINDOW, AT_ONCE = 8, 64, 4096
DOCS_PER_LANGUAGE, STRETCH, MAX_LANGUAGES = 1500, 512, 200
STEPS, BATCH, RATE, SEED = 450, 192, 0.02, 3
UNDECIDED = "und"


def windows_of(data, offsets, size=WINDOW):
    """(bytes, lengths, text of each window): texts cut into windows that cover every byte once."""
    lengths = np.diff(offsets)
    counts = -(-lengths // size)
    text = np.repeat(np.arange(len(lengths)), counts)
    start = offsets[text] + (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)) * size
    sizes = np.minimum(size, offsets[text + 1] - start)
    padded = np.concatenate([data, np.zeros(size, np.uint8)])
    cut = padded[start[:, None] + np.arange(size)[None, :]]
    cut[np.arange(size)[None, :] >= sizes[:, None]] = 0
    return cut, sizes, text


def new_network(languages, rng, hidden=HIDDEN):
    def part(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    network = {}
    for side in "fb":
        network[f"x{side}"] = part(3 * hidden, 256, scale=0.3)
        network[f"x{side}"][:2 * hidden] += 0.5  # hard gates are half open at first
        network[f"u{side}"] = part(3 * hidden, hidden, scale=0.3)
        network[f"o{side}"] = part(languages, hidden, scale=0.3)
    network["bias"] = np.zeros((languages, 1), np.float32)
    return network


def run_side(cut, table, recurrent, trace=None):
    """Yields the state after each byte; with ``trace`` it notes what training needs.

    Without a trace the work space is used again in each step: a state holds until the next is drawn.
    """
    hidden = recurrent.shape[1]
    shape, kind = (hidden, cut.shape[1]), recurrent.dtype
    state, inner, given = np.zeros(shape, kind), np.empty((3 * hidden, shape[1]), kind), None
    for symbols in cut:
        if trace is not None:
            inner, given, state = np.empty_like(inner), None, state.copy()
        np.matmul(recurrent, state, out=inner)
        given = np.take(table, symbols, axis=1, out=given, mode="clip")
        gates, candidate = given[:2 * hidden], given[2 * hidden:]
        gates += inner[:2 * hidden]
        inside = (gates > 0) & (gates < 1) if trace is not None else None
        np.maximum(gates, 0, out=gates)
        np.minimum(gates, 1, out=gates)
        reset, keep = gates[:hidden], gates[hidden:]
        candidate += reset * inner[2 * hidden:]
        np.tanh(candidate, out=candidate)
        if trace is not None:
            trace.append((symbols, state.copy(), inside, reset, keep, candidate, inner[2 * hidden:]))
        state -= candidate
        state *= keep
        state += candidate
        yield state


def position_probabilities(network, cut):
    """For each position from the last to the first: probabilities (language, window)."""
    turned = np.ascontiguousarray(cut.T)
    ahead = [network["of"] @ s + network["bias"] for s in run_side(turned, network["xf"], network["uf"])]
    for place, state in zip(range(len(turned) - 1, -1, -1), run_side(turned[::-1], network["xb"], network["ub"])):
        shares = network["ob"] @ state
        shares += ahead[place]
        np.exp(shares, out=shares)
        shares /= shares.sum(axis=0)
        yield place, shares


def pooled(network, data, offsets):
    """Mean probabilities (text, language) over all bytes of each text."""
    texts, languages = len(offsets) - 1, len(network["bias"])
    cut, sizes, text = windows_of(data, offsets)
    sums = np.zeros((texts, languages))
    for first in range(0, len(cut), AT_ONCE):
        part, size = cut[first:first + AT_ONCE], sizes[first:first + AT_ONCE]
        total = np.zeros((languages, len(part)), np.float32)
        full = int(size.min(initial=WINDOW))
        for place, shares in position_probabilities(network, part):
            total += shares if place < full else shares * (place < size)
        np.add.at(sums, text[first:first + AT_ONCE], total.T)
    return sums / np.maximum(np.diff(offsets), 1)[:, None]


def _gradients(network, cut, sizes, target):
    """Gradients of the mean cross-entropy over all positions, by backpropagation through time."""
    turned = np.ascontiguousarray(cut.T)
    traces = {"f": [], "b": []}
    ahead = [s.copy() for s in run_side(turned, network["xf"], network["uf"], traces["f"])]
    back = [s.copy() for s in run_side(turned[::-1], network["xb"], network["ub"], traces["b"])]
    slope = {name: np.zeros_like(value) for name, value in network.items()}
    share = 1.0 / sizes.sum()
    pushed = {"f": [], "b": []}
    columns = np.arange(len(target))
    for place in range(len(turned)):
        behind = back[len(turned) - 1 - place]
        logits = network["of"] @ ahead[place] + network["ob"] @ behind + network["bias"]
        error = np.exp(logits - logits.max(axis=0))
        error /= error.sum(axis=0)
        error[target, columns] -= 1
        error *= (place < sizes) * np.float32(share)
        slope["of"] += error @ ahead[place].T
        slope["ob"] += error @ behind.T
        slope["bias"] += error.sum(axis=1, keepdims=True)
        pushed["f"].append(network["of"].T @ error)
        pushed["b"].append(network["ob"].T @ error)
    pushed["b"].reverse()
    for side in "fb":
        recurrent = network[f"u{side}"]
        hidden = recurrent.shape[1]
        flow = 0
        by_symbol = []
        for step in range(len(turned) - 1, -1, -1):
            symbols, before, inside, reset, keep, candidate, inner = traces[side][step]
            flow = flow + pushed[side][step]
            d_candidate = flow * (1 - keep) * (1 - candidate * candidate)
            d_gates = np.concatenate([d_candidate * inner, flow * (before - candidate)]) * inside
            d_given = np.concatenate([d_gates, d_candidate])
            d_inner = np.concatenate([d_gates, d_candidate * reset])
            slope[f"u{side}"] += d_inner @ before.T
            by_symbol.append((symbols, d_given))
            flow = flow * keep + recurrent.T @ d_inner
        symbols = np.concatenate([s for s, _ in by_symbol])
        given = np.concatenate([g for _, g in by_symbol], axis=1)
        for row in range(3 * hidden):
            slope[f"x{side}"][row] = np.bincount(symbols, given[row], minlength=256)
    return slope


def train_network(stretches, labels, languages, steps=STEPS, batch=BATCH, rate=RATE, seed=SEED):
    """A network fitted to byte strings with the numbers of their languages."""
    rng = np.random.default_rng(seed)
    data = np.frombuffer(b"".join(stretches), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in stretches])]).astype(np.int64)
    cut, sizes, text = windows_of(data, offsets)
    of_window = np.asarray(labels)[text]
    pools = [np.flatnonzero(of_window == language) for language in range(languages)]
    network = new_network(languages, rng)
    first = {name: np.zeros_like(value) for name, value in network.items()}
    second = {name: np.zeros_like(value) for name, value in network.items()}
    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(pool, -(-batch // languages)) for pool in pools])
        slope = _gradients(network, cut[chosen], sizes[chosen], of_window[chosen])
        norm = np.sqrt(sum(float((g * g).sum()) for g in slope.values()))
        now = rate * (1 - step / (steps + 1)) * min(1.0, 1.0 / max(norm, 1e-9))
        for name, gradient in slope.items():
            first[name] = 0.9 * first[name] + 0.1 * gradient
            second[name] = 0.99 * second[name] + 0.01 * gradient * gradient
            ahead, spread = first[name] / (1 - 0.9**step), second[name] / (1 - 0.99**step)
            network[name] -= (now * ahead / (np.sqrt(spread) + 1e-8)).astype(np.float32)
    return network


def fit(labelled, text_column="text", lang_column="lang", docs_per_language=DOCS_PER_LANGUAGE):
    """(languages, network) from a bounded sample of labelled rows; (empty, None) without any."""
    text, lang = F.col(f"`{text_column}`"), F.col(f"`{lang_column}`")
    known = labelled.where(text.isNotNull() & lang.isNotNull() & (text != "")).select(
        lang.cast("string").alias("lang"), text.alias("text")
    )
    known = known.withColumn("h", F.xxhash64("text"))
    # Different texts, as copies are drawn once: a page copied often takes no other page's place.
    # Pairs of language and hash are narrow, and copies fold in the map tasks.
    counts = known.select("lang", "h").distinct().groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages are more than one network can learn")
    if not counts:
        return [], None
    held = F.create_map(*[F.lit(part) for row in counts for part in row])
    # About three times the wanted share of each language's hashes, whatever its size; the exact
    # number is taken from these few.
    place = F.col("h").cast("double") / F.lit(2.0**64) + 0.5
    start = F.pmod("h", F.greatest(F.lit(1), F.length("text") - STRETCH + 1)).cast("int") + 1
    drawn = (
        known.where(place * held[F.col("lang")] < 3.0 * docs_per_language)
        .groupBy("lang", "h").agg(F.min(F.substring("text", start, F.lit(STRETCH))).alias("stretch"))
    )
    order = Window.partitionBy("lang").orderBy("h")
    picked = drawn.withColumn("n", F.row_number().over(order)).where(F.col("n") <= docs_per_language)
    picked = picked.select("lang", "n", "stretch")
    rows = sorted(picked.toArrow().to_pylist(), key=lambda r: (r["lang"], r["n"]))
    languages = sorted({r["lang"] for r in rows})
    number = {lang: i for i, lang in enumerate(languages)}
    return languages, train_network(
        [r["stretch"].encode() for r in rows], [number[r["lang"]] for r in rows], len(languages)
    )


def _labels(model, column, lettered):
    """(languages, scores) of an Arrow text column."""
    languages, network = model
    names, scores = [], []
    if network is None:
        return [UNDECIDED] * len(column), [0.0] * len(column)
    for row, data, offsets in W.batches(column):
        shares = pooled(network, data, offsets)
        best = shares.argmax(axis=1)
        names += [languages[i] for i in best]
        scores += np.clip(shares[np.arange(len(best)), best], 0, 1).tolist()
    for row, decided in enumerate(lettered):
        if not decided:
            names[row], scores[row] = UNDECIDED, 0.0
    return names, scores


def has_letter(text):
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs, model, id_column="doc_id", text_column="text"):
    """(id, lang_pred, score) of every row."""
    def label(tables):
        for table in tables:
            names, scores = _labels(model, table.column(1), table.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [table.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["id", "lang_pred", "score"],
            )

    text = F.col(f"`{text_column}`")
    rows = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), text.alias("text"), has_letter(text).alias("l"))
    return rows.mapInArrow(label, "id BIGINT, lang_pred STRING, score DOUBLE").withColumnRenamed("id", id_column)


def recognised(docs, model, least_score, text_column="text"):
    """The rows whose language is recognised with at least ``least_score``, with all their columns."""
    place, flag = docs.columns.index(text_column), "lettered"
    while flag in docs.columns:
        flag += "_"

    def keep(tables):
        for table in tables:
            names, scores = _labels(model, table.column(place), table.column(table.num_columns - 1).to_pylist())
            kept = [n != UNDECIDED and s >= least_score for n, s in zip(names, scores)]
            own = table.select(range(table.num_columns - 1))
            yield own.filter(pa.array(kept, pa.bool_()))
        W.release()

    flagged = docs.withColumn(flag, has_letter(F.col(f"`{text_column}`")))
    return flagged.mapInArrow(keep, docs.schema)
