"""Packing into length buckets that minimise padding, and token-budget batches inside them.

The exact histogram of lengths over all rows goes through a dynamic programme that picks the
bucket boundaries with the least padding in total.  Distinct lengths that add up to T tokens are
at most sqrt(2 T), which bounds the histogram: 7 million pairs for 25 trillion tokens.  Inside a
bucket rows are numbered by (length, key) and every ``budget // boundary`` of them, at least one,
make a batch.  Numbering is global without gathering a bucket anywhere: rows are range-partitioned
and numbered locally, and each task's count for each bucket shifts the numbers of the tasks after it.

``tokenised`` gives lengths and ids of whole texts by a byte-level tokenizer; ``pack`` takes those or
any other lengths, and carries further columns along; ``padded`` puts a batch's rows together as
equally long lists with masks.

Defined results: a null or empty text has length 0 and is packed like any other; rows longer
than the budget form batches of one; equal rows keep separate places; null keys come first in
their length; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlake.llm._batches import SLICE_BYTES, bounded_batches, cut, release, slices
from pactlake.llm.token_files import MEMO, encoder, forget

BUCKETS, BUDGET = 8, 16_384


def tokenised(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", ids: bool = False, memo: int = MEMO, keep: bool = True) -> DataFrame:
    """key, n_tokens and, if asked for, ids: little-endian unsigned integers of 2 bytes, or 4 where
    the vocabulary needs them.

    memo: words that a worker remembers, some 300 bytes each; fewer cost time only.  keep: as long as
    the worker lives, else to the end of a task, which leaves the memory to what else it runs.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, memo)
        small = "<u2" if bpe.size <= 1 << 16 else "<u4"
        for b in batches:
            for s in slices(b, "_text", SLICE_BYTES // 4):
                got = [np.frombuffer(x, "<u4")[:-1] for x in bpe.encode([t or "" for t in s.column("_text").to_pylist()], 0)]
                columns = [s.column(0), pa.array([len(x) for x in got], pa.int64())]
                if ids:
                    columns.append(pa.array([x.astype(small).tobytes() for x in got], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n_tokens", "ids"][: len(columns)])
        if not keep:
            del bpe
            forget(path, memo)
        release()

    return docs.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, n_tokens long" + ", ids binary" * ids)


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """At most ``buckets`` rising boundaries, the last the longest length, with least padding.

    ``lengths`` rise; each boundary is one of them, and a length belongs to the first boundary
    that is not below it.
    """
    n = len(lengths)
    if not n:
        return np.zeros(0, np.int64)
    top = [int(x) for x in lengths]
    before = [0, *accumulate(int(x) for x in counts)]  # exact: Python's integers
    best = [t * b for t, b in zip(top, before[1:], strict=True)]  # padded size with one bucket for the first j + 1 lengths
    choice: list[list[int]] = []
    for _ in range(1, min(buckets, n)):
        # With the last bucket after length i the size is best[i] + top[j] * (before[j + 1] - before[i + 1]):
        # lines in top[j] whose slopes fall with i, of which the lowest is kept at hand.
        new, took, hull, at = best.copy(), [-1] * n, [], 0
        for j in range(1, n):
            i = j - 1
            while len(hull) >= 2 and _above(hull[-2], hull[-1], i, best, before):
                hull.pop()
            hull.append(i)
            at = min(at, len(hull) - 1)
            value = lambda i, x=top[j]: best[i] - x * before[i + 1]
            while at + 1 < len(hull) and value(hull[at + 1]) <= value(hull[at]):
                at += 1
            if (cost := value(hull[at]) + top[j] * before[j + 1]) < new[j]:
                new[j], took[j] = cost, hull[at]
        choice.append(took)
        best = new
    out, j = [], n - 1
    for took in reversed(choice):
        if took[j] >= 0:
            out.append(top[j])
            j = took[j]
    return np.array([*out, top[j]][::-1], np.int64)


def _above(a: int, b: int, c: int, best: list[int], before: list[int]) -> bool:
    """Whether line b is nowhere below both a and c; slopes are -before[i + 1]."""
    return (best[c] - best[a]) * (before[b + 1] - before[a + 1]) <= (best[b] - best[a]) * (before[c + 1] - before[a + 1])


def histogram(rows: DataFrame, length: str = "n_tokens") -> tuple[np.ndarray, np.ndarray]:
    """Distinct lengths, rising, and how many rows have each."""
    got = sorted(rows.groupBy(F.col(length).alias("length")).agg(F.count(F.lit(1)).alias("n")).collect())
    return np.array([r.length for r in got], np.int64), np.array([r.n for r in got], np.int64)


def pack(rows: DataFrame, *, key: str = "doc_id", length: str = "n_tokens", carry: tuple[str, ...] = (), buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """key, length, bucket, bucket_len, batch_id of each row and the columns to ``carry``.

    Batch ids are bucket * 2**40 + number.
    """
    spark = rows.sparkSession
    carried = [F.col(c).alias(f"_carried{i}") for i, c in enumerate(carry)]
    # A copy, as lengths may be costly; the row numbers part rows that agree in key and length.
    rows = cut(rows.select(F.col(key).alias("_key"), F.coalesce(F.col(length), F.lit(0)).cast("long").alias("_n"), F.monotonically_increasing_id().alias("_row"), *carried))
    tops = boundaries(*histogram(rows, "_n"), buckets)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    order = ["_n", "_key", "_row"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(len(tops), np.int64)
        for b in batches:
            bucket = np.searchsorted(tops, b.column(1).to_numpy(), "left")
            count = np.bincount(bucket, minlength=len(tops))
            rank = np.arange(len(bucket)) - (np.cumsum(count) - count)[bucket] + seen[bucket]  # bucket numbers rise
            seen += count
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bucket.astype(np.int32)), pa.array(np.full(len(bucket), part, np.int32)), pa.array(rank)], names=[*b.schema.names, "bucket", "part", "rank"])

    # The partitioning draws samples; the shared copy fixes it before counts are taken from it.
    placed = cut(ordered.mapInArrow(number, f"{kinds}, bucket int, part int, rank long"))
    shift, total = [], np.zeros(len(tops), np.int64)
    for r in sorted(placed.groupBy("part", "bucket").count().collect()):  # tasks plus buckets at most
        shift.append((r.part, r.bucket, int(total[r.bucket])))
        total[r.bucket] += r["count"]
    shifts = spark.createDataFrame(shift, "part int, bucket int, shift long")
    of = spark.createDataFrame([(i, int(t), max(1, budget // max(1, int(t)))) for i, t in enumerate(tops)], "bucket int, bucket_len long, room long")
    made = placed.join(F.broadcast(shifts), ["part", "bucket"]).join(F.broadcast(of), "bucket")
    batch = F.col("bucket").cast("long") * F.lit(1 << 40) + F.floor((F.col("rank") + F.col("shift")) / F.col("room")).cast("long")
    return made.select(F.col("_key").alias(key), F.col("_n").alias(length), "bucket", "bucket_len", batch.alias("batch_id"), *(F.col(f"_carried{i}").alias(c) for i, c in enumerate(carry)))


def padded(packed: DataFrame, *, ids: str = "ids", key: str = "doc_id", length: str = "n_tokens", width: int = 2, pad: int = 0) -> DataFrame:
    """A row for each batch: batch_id, bucket_len, keys, tokens and masks, lists of equal lengths.

    A batch holds ``budget`` tokens with its padding, or one row, so a group is bounded.
    """
    kind = packed.schema[key].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, masks = [], []
            for to, blobs in zip(b.column("bucket_len").to_pylist(), b.column("blobs").to_pylist(), strict=True):
                own = [np.frombuffer(x, f"<u{width}").astype(np.int64) for x in blobs]
                tokens.append([np.pad(x, (0, to - len(x)), constant_values=pad).tolist() for x in own])
                masks.append([(np.arange(to) < len(x)).tolist() for x in own])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column("keys"), pa.array(tokens, pa.list_(pa.list_(pa.int64()))), pa.array(masks, pa.list_(pa.list_(pa.bool_())))], names=["batch_id", "bucket_len", "keys", "tokens", "masks"])

    entry = F.struct(F.col(length).alias("n"), F.col(key).alias("k"), F.col(ids).alias("b"))
    whole = packed.groupBy("batch_id", "bucket_len").agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    whole = whole.select("batch_id", "bucket_len", F.transform("rows", lambda r: r["k"]).alias("keys"), F.transform("rows", lambda r: r["b"]).alias("blobs"))
    return whole.mapInArrow(build, f"batch_id long, bucket_len long, keys array<{kind}>, tokens array<array<long>>, masks array<array<boolean>>")
