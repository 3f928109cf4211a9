"""Quartile bucket digests of documents and a bounded difference between digests.

Three kinds of byte triplets out of each window of four bytes are hashed by tabulation into
128 buckets.  A digest holds, for each bucket, in which quartile of all bucket counts its
count lies (two bits), and a header of 4 bytes: the length's logarithm, two quartile ratios, and
a check byte of the text.  The difference adds, bucket by bucket, 0, 1, 2 or 6 for quartiles that are
0 to 3 steps apart, and bounded header terms; it is cut off at ``BOUND`` (near what unrelated
texts reach).  Likeness is 1 minus difference over bound: 1 for equal digests, 0 at the bound.

``with_next`` pairs each document with the next one in descending key order without a global
window: rows are range-partitioned and sorted, each task hands on its first and last row, and
those few are joined afterwards.

Defined results: a null text counts as empty; the empty text has a digest; equal keys are
ordered by a hash of the text, nulls of the key come last; a single row is its own next; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pactlake.llm._batches import SLICE_BYTES, bounded_batches, cut, slices

BUCKETS, BOUND = 128, 256
#: Offsets in the window of four bytes of each kind of triplet.
KINDS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
_STEP = np.array([0, 1, 2, 6], np.int64)


def _tables() -> np.ndarray:
    """A hashed byte for each kind, place and byte value."""
    one = lambda k, p: [hashlib.sha256(f"triplet/{k}/{p}/{v}".encode()).digest()[0] % BUCKETS for v in range(256)]
    return np.array([[one(k, p) for p in range(3)] for k in range(len(KINDS))], np.uint8)


_T = _tables()


def counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bucket counts, a row for each text of the concatenated bytes; a long text goes by pieces."""
    n = len(offsets) - 1
    out = np.zeros((n, BUCKETS), np.int64)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        a, b = int(offsets[at]), int(offsets[end])
        if b - a <= SLICE_BYTES:
            out[at:end] = _counts(raw[a:b], offsets[at : end + 1] - a, b - a)
        else:
            for p in range(a, b, SLICE_BYTES):
                part = raw[p : min(b, p + SLICE_BYTES + KINDS[-1][-1])]
                out[at] += _counts(part, np.array([0, len(part)]), SLICE_BYTES)[0]
        at = end
    return out


def _counts(raw: np.ndarray, offsets: np.ndarray, stop: int) -> np.ndarray:
    """Of triplets that begin before ``stop``."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    out = np.zeros(n * BUCKETS, np.int64)
    doc = np.repeat(np.arange(n, dtype=np.int32) * BUCKETS, sizes)
    left = np.repeat(offsets[1:], sizes) - np.arange(len(raw)) if len(raw) else np.zeros(0, np.int64)
    left = left[:stop]
    for kind, places in enumerate(KINDS):
        width = places[-1] + 1
        at = np.flatnonzero(left >= width)
        h = _T[kind, 0][raw[at]]
        for p in (1, 2):
            h = h ^ _T[kind, p][raw[at + places[p]]]
        out += np.bincount(doc[at] + h, minlength=n * BUCKETS)
    return out.reshape(n, BUCKETS)


def digest(texts: list[bytes]) -> np.ndarray:
    """Digests as rows of 132 small integers: 128 quartile codes, then the header."""
    if not texts:
        return np.zeros((0, BUCKETS + 4), np.int64)
    sizes = np.array([len(t) for t in texts])
    c = counts(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(sizes)]))
    q = np.sort(c, axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (c[:, :, None] > q[:, None, :]).sum(2)
    length = np.minimum(255, np.floor(np.log1p(sizes) * 8)).astype(np.int64)
    top = np.maximum(q[:, 2], 1)
    check = np.array([hashlib.sha256(t).digest()[0] for t in texts])
    return np.column_stack([codes, length, q[:, 0] * 100 // top % 16, q[:, 1] * 100 // top % 16, check])


def to_hex(digests: np.ndarray) -> list[str]:
    codes = digests[:, :BUCKETS].reshape(-1, BUCKETS // 4, 4) @ np.array([64, 16, 4, 1])
    return [bytes(r).hex() for r in np.column_stack([digests[:, BUCKETS:], codes]).astype(np.uint8)]


def from_hex(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).astype(np.int64)
    return np.concatenate([(raw[4:, None] >> np.array([6, 4, 2, 0]) & 3).ravel(), raw[:4]])


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, between 0 (equal digests) and ``BOUND``."""
    body = _STEP[np.abs(a[:, :BUCKETS] - b[:, :BUCKETS])].sum(1)
    head = np.abs(a[:, BUCKETS:] - b[:, BUCKETS:])
    ring = np.minimum(head[:, 1:3], 16 - head[:, 1:3])
    return np.minimum(BOUND, body + np.minimum(head[:, 0], 12) + ring.sum(1) + (head[:, 3] > 0))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 - difference(a, b) / BOUND


def edit(own: str, following: str) -> str:
    """The last third of a text replaced by the beginning of the next."""
    k = len(own) // 3
    return own[: len(own) - k] + following[:k]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(keys: list, texts: list[str], own: np.ndarray, following: list[str], after: np.ndarray) -> list:
    edited = [edit(t, f).encode() for t, f in zip(texts, following, strict=True)]
    d = digest(edited)
    return [keys, [len(t) for t in texts], [hashlib.sha256(e).hexdigest() for e in edited], to_hex(own), to_hex(d), likeness(own, d), likeness(own, after)]


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the digest of each text as a hex string, other columns untouched."""
    from pyspark.sql import types as T

    if out in docs.columns:
        raise ValueError(f"documents already have a column {out}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                got = to_hex(digest([(t or "").encode() for t in part.column(text).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.string())], names=[*part.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())]))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and likeness to both it and the next text."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("tie"))
    ordered = rows.repartitionByRange(*order, "tie").sortWithinPartitions(*order, "text").drop("tie")  # equal rows part, too
    kind = rows.schema["doc_id"].dataType
    out = pa.schema([pa.field("doc_id", to_arrow_type(kind)), *list(_OUT)[1:]])
    ddl = f"doc_id {kind.simpleString()}, " + _DDL.split(", ", 1)[1]
    full = pa.schema([*out, ("role", pa.int32()), ("part", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        edge = lambda role, k, t: pa.RecordBatch.from_pydict({n: [v] for n, v in zip(full.names, [k, *[None] * 6, role, part, t], strict=True)}, schema=full)
        for batch in batches:
            for s in slices(batch, "text", SLICE_BYTES // 2):
                keys, texts = s.column("doc_id").to_pylist(), s.column("text").to_pylist()
                own = digest([t.encode() for t in texts])
                if held is None:
                    yield edge(1, keys[0], texts[0])
                else:
                    keys, texts, own = [held[0], *keys], [held[1], *texts], np.vstack([held[2], own])
                held = (keys[-1], texts[-1], own[-1:])
                if len(keys) > 1:
                    got = _compare(keys[:-1], texts[:-1], own[:-1], texts[1:], own[1:])
                    n = len(keys) - 1
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip([*got, [0] * n, [part] * n, [None] * n], full, strict=True)], schema=full)
        if held:
            yield edge(2, held[0], held[1])

    # Narrow rows, and two texts for each task.
    made = cut(ordered.mapInArrow(run, f"{ddl}, role int, part int, text string"))
    parts = sorted(r.part for r in made.where("role = 1").select("part").collect())  # one for each task
    if not parts:
        return spark.createDataFrame([], ddl)
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next_part int")
    last = made.where("role = 2").select("doc_id", "part", "text").join(F.broadcast(following), "part")
    first = made.where("role = 1").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    ends = last.join(first, "next_part").select("doc_id", "text", "next_text")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, "text"):
                keys, texts, following = (c.to_pylist() for c in s.columns)
                own, after = (digest([t.encode() for t in x]) for x in (texts, following))
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(_compare(keys, texts, own, following, after), out, strict=True)], schema=out)

    return made.where("role = 0").select(*_OUT.names).unionByName(ends.mapInArrow(finish, ddl))
