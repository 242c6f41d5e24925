"""Byte-level BPE with the merges of a rank file, run by sentencepiece.

The rank file's byte strings become pieces of a sentencepiece BPE model, each byte written as one
printable character, each piece scored by its negative rank, with identity normalisation. The
model is serialised here from the vocabulary; nothing is trained. Merging the best-scored pair
first is then the same as merging the pair of lowest rank first. A pre-token that is in the
vocabulary as a whole is its own id, as in the rank file's usual reader.

Null and empty texts have no ids. Repeated texts, and texts of any length, give the same ids
wherever they stand. Other columns are carried along by the caller.
"""

import base64
import hashlib
import struct
import sys

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F

from txrisk.llm.words import release

register_pickle_by_value(sys.modules[__name__])

MEMO = 150_000  # pre-tokens a task remembers before it starts afresh
_LOADED = {}


def read_ranks(path):
    """{bytes: rank} of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_characters():
    """One character per byte: printable Latin-1 bytes stand for themselves, others for U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(others)}}


def _field(number, value):
    """One protobuf field: bytes by length, float by four bytes, int as varint."""
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value & (1 << 64) - 1)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _varint(value):
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def model_bytes(ranks):
    """A serialised sentencepiece model; piece ids are ranks, the unknown piece comes last."""
    names, model = byte_characters(), bytearray()
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2 and so on without gaps")
    for token in sorted(ranks, key=ranks.get):
        piece = "".join(names[b] for b in token).encode()
        model += _field(1, _field(1, piece) + _field(2, -float(ranks[token])))
    model += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, len(ranks))
    trainer += b"".join(_field(n, -1) for n in (41, 42, 43))
    model += _field(2, trainer)
    model += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(model)


class Codec:
    """Encodes texts to ids and ids back to bytes."""

    def __init__(self, path, pattern):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(model_bytes(self.ranks))
        self.shown = byte_characters()
        tokens = sorted(self.ranks, key=self.ranks.get)
        self.lengths = np.array([len(t) for t in tokens])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.vocabulary = np.frombuffer(b"".join(tokens), np.uint8)
        self.memo = {}

    def learn(self, pieces):
        """Puts the ids of new pre-tokens into the memo, as little-endian 32-bit integers."""
        if len(self.memo) + len(pieces) > MEMO:
            self.memo = {}
        hard = []
        for piece in pieces:
            raw = piece.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self.memo[piece] = struct.pack("<I", rank)
            else:
                hard.append((piece, raw.decode("latin-1").translate(self.shown)))
        found = self.model.encode([shown for _, shown in hard], num_threads=1)
        for (piece, _), ids in zip(hard, found):
            self.memo[piece] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text):
        """The ids of a text as little-endian 32-bit integers."""
        pieces = self.split(text)
        try:
            return b"".join(map(self.memo.__getitem__, pieces))
        except KeyError:
            wanted = set(pieces)
            new = [piece for piece in wanted if piece not in self.memo]
            if len(self.memo) + len(new) > MEMO:
                new = wanted  # the memo starts afresh
            self.learn(new)
            return b"".join(map(self.memo.__getitem__, pieces))

    def decode(self, ids):
        """The bytes that an array of ids stands for."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if len(ends) == 0:
            return b""
        place = np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends + lengths, lengths)
        return self.vocabulary[place].tobytes()


def codec(path, pattern):
    """One codec per Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED.clear()
        _LOADED[path, pattern] = Codec(path, pattern)
    return _LOADED[path, pattern]


def encode_texts(docs, path, pattern, id_column="doc_id", text_column="text"):
    """(id, n_tokens, ids) of every text; ``path`` must exist on every executor."""
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def encode(tables):
        own = codec(path, pattern)
        for table in tables:
            keys, texts = table.column(0), table.column(1)
            for first in range(0, len(texts), 256):
                found = [own.encode(t or "") for t in texts.slice(first, 256).to_pylist()]
                sizes = np.array([len(f) // 4 for f in found], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                ids = np.frombuffer(b"".join(found), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(first, 256).cast(pa.int64()), pa.array(sizes), pa.ListArray.from_arrays(offsets, ids)],
                    schema=schema,
                )

    chosen = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), F.col(f"`{text_column}`").alias("text"))
    return chosen.mapInArrow(encode, "id BIGINT, n_tokens BIGINT, ids ARRAY<INT>").withColumnRenamed("id", id_column)


def round_trips(docs, path, pattern, id_column="doc_id", text_column="text"):
    """(id, n_tokens, ids, decoded_sha256) of every text: its ids, and the digest of what they decode to.

    Encoding and decoding are one pass of one worker. A text that its ids would not give back is an error.
    """
    names = ["id", "n_tokens", "ids", "decoded_sha256"]

    def turn(tables):
        own = codec(path, pattern)
        for table in tables:
            keys, texts = table.column(0), table.column(1)
            for first in range(0, len(texts), 64):
                raw = [t or "" for t in texts.slice(first, 64).to_pylist()]
                lists = [np.frombuffer(own.encode(t), np.int32) for t in raw]
                decoded = [own.decode(ids) for ids in lists]
                if decoded != [t.encode() for t in raw]:
                    raise ValueError("decoded ids are not the text that was encoded")
                sizes = np.array([len(ids) for ids in lists], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    keys.slice(first, 64).cast(pa.int64()), pa.array(sizes),
                    pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.int32), *lists])),
                    pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
                ], names=names)
        own.memo = {}
        release()

    chosen = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), F.col(f"`{text_column}`").alias("text"))
    fields = "id BIGINT, n_tokens BIGINT, ids ARRAY<INT>, decoded_sha256 STRING"
    return chosen.mapInArrow(turn, fields).withColumnRenamed("id", id_column)


def decode_ids(encoded, path, pattern, id_column="doc_id"):
    """(id, n_tokens, ids_sha256, decoded_sha256, decoded) of tables made by :func:`encode_texts`.

    ``decoded`` is the byte string; it need not be valid UTF-8 if the ids were cut somewhere.
    """
    schema = pa.schema([
        ("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
        ("decoded_sha256", pa.string()), ("decoded", pa.binary()),
    ])

    def decode(tables):
        own = codec(path, pattern)
        for table in tables:
            keys = table.column(0)
            for first in range(0, len(keys), 256):
                lists = table.column(2).slice(first, 256)
                offsets, ids = lists.offsets.to_numpy(), lists.values.to_numpy()
                parts = [ids[a:b] for a, b in zip(offsets, offsets[1:])]
                decoded = [own.decode(part) for part in parts]
                yield pa.RecordBatch.from_arrays([
                    keys.slice(first, 256), pa.array([len(p) for p in parts], pa.int64()),
                    pa.array([hashlib.sha256(p.astype("<u4").tobytes()).hexdigest() for p in parts]),
                    pa.array([hashlib.sha256(d).hexdigest() for d in decoded]), pa.array(decoded, pa.binary()),
                ], schema=schema)

    chosen = encoded.select(F.col(f"`{id_column}`").alias("id"), "n_tokens", "ids")
    fields = "id BIGINT, n_tokens BIGINT, ids_sha256 STRING, decoded_sha256 STRING, decoded BINARY"
    return chosen.mapInArrow(decode, fields).withColumnRenamed("id", id_column)
