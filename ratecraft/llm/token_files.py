"""Token files: id arrays with Elias-Fano coded document boundaries.

Documents are range-partitioned by id, tokenised in that order, and written as
segments: the ids of some documents, end to end, in 2 or 4 bytes each, and their
end offsets as an Elias-Fano sequence (about 2 + log2(ids / documents) bits a
document instead of 64) with the place of every ``STRIDE``-th set bit, so one
boundary is found without decoding the rest. A segment is a row of a Parquet
table below the shared folder. Global offsets are sums of the segments' id
counts, first by writing task, then by segment; no 64-bit table is stored.

The tokenizer is the library's. Byte-level BPE first cuts a text by a pattern and
then encodes each piece for itself, so a worker encodes a piece once and remembers
its ids from task to task. ``PIECE`` is that pattern for ASCII and Latin letters; a text that it
doesn't cover, with a run of white space, or with the content of an added token
is encoded whole. Such content (``<|endoftext|>``) becomes the token's own id, as
in the library's plain ``encode(text, add_special_tokens=False)``.

Defined results: null and empty texts hold the end id alone; rows with a null id
come first; rows that share an id are ordered by text hash and equal rows are
interchangeable; an empty table gives no rows; other columns are not read. A
text above ``SEGMENT_IDS`` ids makes a segment of its own.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratecraft.llm.common import ship_by_value
from ratecraft.session import scratch_path

END_ID = 2
#: Ids and documents after which a segment is written.
SEGMENT_IDS = 1 << 20
SEGMENT_DOCS = 4096
#: Set bits between two samples of the select structure.
STRIDE = 64
#: Pieces whose ids a worker remembers.
REMEMBERED = 250_000
SCHEMA = ("part int, seq int, n_docs int, n_ids long, id_bytes int, doc_ids array<bigint>, low_bits int,"
          " low binary, high binary, samples binary, ids binary")


class EliasFano:
    """A rising sequence of ``n`` numbers up to ``top``."""

    def __init__(self, n, low_bits, low, high, samples):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray, top: int) -> EliasFano:
        n = len(values)
        v = values.astype(np.uint64)
        bits = max(0, (int(top) // max(n, 1)).bit_length() - 1)
        low = v & np.uint64((1 << bits) - 1)
        planes = ((low[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(n + (int(top) >> bits) + 1, np.uint8)
        unary[ones] = 1
        return cls(n, bits, np.packbits(planes.ravel(), bitorder="little").tobytes(),
                   np.packbits(unary, bitorder="little").tobytes(), ones[::STRIDE].astype(np.uint32).tobytes())

    def _select(self, i: int) -> int:
        """Place of set bit ``i``: from the sample before it, byte by byte."""
        at = int(np.frombuffer(self.samples, np.uint32)[i // STRIDE])
        left, byte = i % STRIDE, at // 8
        word = self.high[byte] >> (at % 8) << (at % 8)
        while (c := word.bit_count()) <= left:
            left -= c
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        return byte * 8 + (word & -word).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        at = i * self.low_bits
        span = int.from_bytes(self.low[at // 8:(at + self.low_bits + 7) // 8], "little") >> (at % 8)
        return ((self._select(i) - i) << self.low_bits) | (span & ((1 << self.low_bits) - 1))

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))
        high = (ones[:self.n] - np.arange(self.n)) << self.low_bits
        planes = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[:self.n * self.low_bits]
        return high + planes.reshape(self.n, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits))


#: What the tokenizer's own pattern gives on texts of these characters, as long
#: as no white space is next to another, except a space after a line end.
PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+|\n")


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's letters: printable bytes stand for themselves, the
    others for the characters from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Pieces(dict):
    """Piece -> its ids, asked of ``learn`` once."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, piece):
        ids = self[piece] = self.learn(piece)
        return ids


class _Encoder:
    """Ids of whole texts, as bytes, remembering pieces."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(tokenizer_json)
        self.added = [t["content"] for t in json.loads(tokenizer_json).get("added_tokens") or []]
        self.model = self.tok.model
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.kind = "H" if self.width == 2 else "I"
        self.alphabet = _byte_alphabet()
        self.known = _Pieces(self._ids)

    def _ids(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(self.alphabet)
        return array(self.kind, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def __call__(self, text: str) -> bytes:
        pieces = PIECE.findall(text)
        if len("".join(pieces)) != len(text) or "\n\n" in text or any(a in text for a in self.added):
            return array(self.kind, self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, pieces))


def _segment(part, seq, held, width):
    ends = np.cumsum([len(x) // width for _, x in held])
    ef = EliasFano.of(ends, int(ends[-1]))
    return (part, seq, len(held), int(ends[-1]), width, [d for d, _ in held], ef.low_bits, ef.low, ef.high,
            ef.samples, b"".join(x for _, x in held))


_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32(),
          *[pa.binary()] * 4]
_NAMES = [x.split()[0] for x in SCHEMA.replace("array<bigint>", "a").split(", ")]


def _encoder(shipped):
    """The encoder of a broadcast tokenizer. It is kept on the variable, which a
    worker holds from task to task: a task then neither loads the tokenizer nor
    learns its pieces anew."""
    if not hasattr(shipped, "encoder"):
        shipped.encoder = _Encoder(shipped.value)
    return shipped.encoder


def _encode(tokenizer_json):
    def run(batches):
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
        encoder = None
        for b in batches:
            encoder = encoder or _encoder(tokenizer_json)
            width, end = encoder.width, END_ID.to_bytes(encoder.width, "little")
            for lo in range(0, b.num_rows, 128):
                piece = b.slice(lo, 128)
                for d, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True):
                    ids = encoder(text or "")
                    n = len(ids) // width + 1
                    if held and (size + n > SEGMENT_IDS or len(held) >= SEGMENT_DOCS):
                        yield _batch(_segment(part, seq, held, width))
                        held, size, seq = [], 0, seq + 1
                    held.append((d, ids + end))
                    size += n
        if held:
            yield _batch(_segment(part, seq, held, width))

    def _batch(row):
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _KINDS, strict=True)], names=_NAMES)

    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Tokenise ``docs`` with the tokenizer file and write its segments."""
    with open(tokenizer, encoding="utf-8") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.mapInArrow(_encode(shipped), SCHEMA).write.parquet(path)


def boundaries(row) -> np.ndarray:
    """End offsets of a segment's documents."""
    return EliasFano(row["n_docs"], row["low_bits"], row["low"], row["high"], row["samples"]).all()


def _decode(batches):
    names = ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"]
    for b in batches:
        for r in b.to_pylist():
            ends = boundaries(r)
            starts = np.concatenate([[0], ends[:-1]])
            ids = np.frombuffer(r["ids"], "<u2" if r["id_bytes"] == 2 else "<u4").astype("<u4")
            crc = [zlib.crc32(ids[a:z]) for a, z in zip(starts, ends, strict=True)]
            n = r["n_docs"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["part"]] * n, pa.int32()), pa.array([r["seq"]] * n, pa.int32()),
                 pa.array(r["doc_ids"], pa.int64()), pa.array(starts), pa.array(ends - starts),
                 pa.array(crc, pa.int64())], names=names)


def read_documents(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document in the files."""
    files = spark.read.schema(SCHEMA).parquet(path)
    sizes = files.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row a writing task
    first = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("part_start"))
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("seq_start", F.coalesce(F.sum("n_ids").over(inner), F.lit(0))).join(parts, "part") \
        .select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("base"))
    docs = files.mapInArrow(_decode, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(base, ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, path)
    return read_documents(docs.sparkSession, path)


ship_by_value(__name__)
