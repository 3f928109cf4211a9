"""Exact n-gram Jaccard self-join of documents by set-relation skipping.

Two documents link when 100 * intersection >= 75 * union of their sets of word shingles.

1.  Equal sets are one class, known by a signature; a bounded sketch counts shingles.
2.  Each set's prefix, its first shingles in one order of all, is long enough for linked sets to
    share a tenth of their sizes there.  Tasks for buckets of shingles tell which of these more
    sets have, and how many.  A set with too few shared ones can have no link and is left out;
    of the others' prefixes the rarest are index entries, as many as a link cannot miss.  The
    connected groups of classes that share entries are *families*: every link lies inside one.
    Hot shingles, by the sketch, come last in the order and are never gathered: each task joins
    its own sets that have one and hands on one entry.
3.  Inside a family (large ones: each pair of blocks on its own) all links are found exactly.
    Index lists are sorted by set size, so the blocks of a list outside a set's size window are
    skipped by position; and a set that differs little from one whose overlaps are known takes
    them over, corrected by the lists of the few shingles in which the two differ.

Defined results: null or empty texts and texts without words have an empty set, n_shingles 0, no
link, and are their own component; rows with a null key link like any other but lend no
component id (null if a component has none else); rows that repeat a key count as documents of
their own; keys may be of any type that has an order; very long texts are hashed piece by piece;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlake.llm._batches import SLICE_BYTES, bounded_batches, cut, release, slices, text_bytes
from pactlake.llm.components import connected, local_roots
from pactlake.llm.shingles import shingle_sets, signature

#: Per cent of the union that the intersection has to reach.
PERCENT = 75
#: Counters of the sketch, and the slices that it is added up in.
SKETCH, SKETCH_SLICES = 1 << 20, 64
#: Per cent of a set by which its prefix is extended.
EXTRA = 10
#: A shingle is hot if its counter exceeds both the floor and so many times the mean counter.
HOT_FLOOR, HOT_TIMES = 2000, 4
#: Index entries that a task hands on together; entries of a bucket of shingles.
FLUSH, BUCKET = 1 << 20, 2 << 20
#: A block of a family: sets and shingles at most.  Shingles of a unit of small families.
BLOCK, BLOCK_SHINGLES, UNIT_SHINGLES = 1024, 1 << 19, 1 << 19


def _sets(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in slices(batch, text, SLICE_BYTES // 2):
        yield part, shingle_sets(*text_bytes(part.column(text)))


def _survey(docs: DataFrame) -> DataFrame:
    """Kind 0: key, n, sig of each row.  Kind 1: the slices of a task's sketch."""

    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = np.zeros(SKETCH, np.uint32), set()
        for b in batches:
            schema = pa.schema([("kind", pa.int32()), ("key", b.schema.field("key").type), ("fetch", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), ("blob", pa.binary())])
            for part, sets in _sets(b, "text"):
                sigs = [signature(s) if len(s) else None for s in sets]
                new = [s for s, sig in zip(sets, sigs, strict=True) if sig is not None and not (sig in seen or seen.add(sig))]
                if new:
                    sketch += np.bincount((np.concatenate(new) >> np.uint64(44)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
                rows = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(rows, np.int32)), part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.int64()), pa.nulls(rows, pa.binary())], schema=schema)
        release()
        if seen:
            blobs = [x.tobytes() for x in np.minimum(sketch, 65535).astype("<u2").reshape(SKETCH_SLICES, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(blobs), np.int32)), pa.nulls(len(blobs), schema.field("key").type), pa.nulls(len(blobs), pa.int64()), pa.array(range(len(blobs)), pa.int64()), pa.nulls(len(blobs), pa.int64()), pa.array(blobs, pa.binary())], schema=schema)

    return docs.mapInArrow(run, f"kind int, key {kind}, fetch long, n long, sig long, blob binary")


def _counts(survey: DataFrame) -> np.ndarray:
    """The sketch over all rows: SKETCH counters, whatever the number of rows."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH // SKETCH_SLICES, np.int64)
        for blob in table.column("blob"):
            total += np.frombuffer(blob.as_buffer(), "<u2")
        return pa.table({"n": [table.column("n")[0].as_py()], "blob": [np.minimum(total, (1 << 24) - 1).astype("<u4").tobytes()]}, schema=pa.schema([("n", pa.int64()), ("blob", pa.binary())]))

    out = np.zeros((SKETCH_SLICES, SKETCH // SKETCH_SLICES), np.uint64)
    for r in survey.where("kind = 1").select("n", "blob").groupBy("n").applyInArrow(add, "n long, blob binary").collect():
        out[r.n] = np.frombuffer(r.blob, "<u4")
    return out.ravel()


def _extended(n: int) -> tuple[int, int]:
    """Size of a set's extended prefix, and how many of its entries any linked set's prefix has too.

    With c = the least overlap of a link, sets that agree on c shingles share the first l of those
    in any order within their first n - c + l.  A partner has 75 % of the size at least, and
    its own l is in proportion.
    """
    c = (PERCENT * n + 99) // 100
    more = max(1, n * EXTRA // 100)
    return n - c + more, max(1, min(more, c * EXTRA // 100))


def _blob(values: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


_ROW = pa.schema([("bucket", pa.int32()), ("flush", pa.int64()), ("kind", pa.int32()), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary())])
_ROW_DDL = "bucket int, flush long, kind int, x binary, y binary, z binary"


def _entries(docs: DataFrame, counts: np.ndarray, buckets: int) -> DataFrame:
    """Extended prefixes in the order (hot, hash), a flush of many sets at a time.

    Kind 0, by bucket of shingles: shingles and the set's place in its flush.  Kind 1, once a
    flush: signatures, prefix sizes and shares; kind 2: its entries with hot shingles, which are
    not sent anywhere, as they are known to be shared.
    """
    hot = counts > max(HOT_FLOOR, HOT_TIMES * counts.mean())
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: set[int] = set()
        chosen: list[np.ndarray] = []
        sigs: list[int] = []
        need: list[int] = []
        turn = held = 0

        def flush() -> pa.RecordBatch:
            nonlocal turn
            number = part << 24 | turn
            sizes = np.array([len(c) for c in chosen], np.int64)
            h, own = np.concatenate(chosen), np.repeat(np.arange(len(chosen), dtype=np.uint16), sizes)
            burning = shared.value[(h >> np.uint64(44)).astype(np.int64)]
            rows = [(turn % buckets, number, 1, _blob(sigs, "<i8"), _blob(sizes, "<i4"), _blob(need, "<i4"))]
            if burning.any():
                rows.append((turn % buckets, number, 2, _blob(h[burning], "<u8"), _blob(own[burning], "<u2"), None))
                h, own = h[~burning], own[~burning]
            where = (h % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            h, own = h[order], own[order]
            ends = np.searchsorted(where[order], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(ends)):
                rows.append((int(k), number, 0, _blob(h[ends[k] : ends[k + 1]], "<u8"), _blob(own[ends[k] : ends[k + 1]], "<u2"), None))
            turn += 1
            for held_list in (chosen, sigs, need):
                held_list.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)

        for b in batches:
            for _, sets in _sets(b, "text"):
                for s in sets:
                    if not len(s) or (sig := signature(s)) in seen:
                        continue
                    seen.add(sig)
                    p, m = _extended(len(s))
                    rank = s >> np.uint64(1) | shared.value[(s >> np.uint64(44)).astype(np.int64)].astype(np.uint64) << np.uint64(63)
                    own = s[rank <= np.partition(rank, p - 1)[p - 1]]  # with all ties
                    chosen.append(own)
                    sigs.append(sig)
                    need.append(m)
                    held += len(own)
                if held >= FLUSH or len(chosen) >= 1 << 15:
                    yield flush()
                    held = 0
        if chosen:
            yield flush()
        release()

    return docs.select("text").mapInArrow(run, _ROW_DDL)


def _arrays(table: pa.Table, kind: int, *columns: tuple[str, str]) -> list[list[np.ndarray]]:
    """The blobs of the rows of a kind as arrays, column by column."""
    kinds = table.column("kind").to_numpy()
    return [[np.frombuffer(v.as_buffer(), t) for v, k in zip(table.column(c), kinds, strict=True) if k == kind] for c, t in columns]


def _shared(table: pa.Table) -> pa.Table:
    """Of a bucket's entries those whose shingle more sets have, with its count, back by flush."""
    kinds, flushes = table.column("kind").to_numpy(), table.column("flush").to_numpy()
    out = [r for r in zip(*(c.to_pylist() for c in table.filter(pa.array(kinds != 0)).columns), strict=True)]
    h, own = _arrays(table, 0, ("x", "<u8"), ("y", "<u2"))
    if h:
        of = np.repeat(flushes[kinds == 0], [len(x) for x in h])
        h, own = np.concatenate(h), np.concatenate(own)
        order = np.argsort(h)
        sorted_h = h[order]
        starts = np.flatnonzero(np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]]))
        n = np.diff(np.append(starts, len(h)))
        common = np.repeat(n > 1, n)
        n, order = np.repeat(n, n)[common], order[common]
        h, own, of = h[order], own[order], of[order]
        order = np.argsort(of, kind="stable")
        h, own, of, n = h[order], own[order], of[order], n[order]
        ends = np.flatnonzero(np.concatenate([of[:1] == of[:1], of[1:] != of[:-1], [True]])) if len(of) else np.zeros(1, np.int64)
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            out.append((0, int(of[a]), 0, _blob(h[a:b], "<u8"), _blob(own[a:b], "<u2"), _blob(n[a:b], "<u4")))
    return pa.table([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_ROW)], schema=_ROW)


def _selector(buckets: int):
    def select(table: pa.Table) -> pa.Table:
        """The index entries of a flush: of each set's prefix the rarest that a link cannot miss.

        A set whose prefix has too few shared shingles can have no link and is left out.
        """
        sigs, sizes, need = (np.concatenate(v) for v in _arrays(table, 1, ("x", "<i8"), ("y", "<i4"), ("z", "<i4")))
        h, own, n = _arrays(table, 0, ("x", "<u8"), ("y", "<u2"), ("z", "<u4"))
        hot_h, hot_own = _arrays(table, 2, ("x", "<u8"), ("y", "<u2"))
        n = [x.astype(np.int64) for x in n] + [np.full(len(x), 1 << 40, np.int64) for x in hot_h]
        none = np.zeros(0, np.int64)
        h, own, n = (np.concatenate(v) if v else none for v in ([*h, *hot_h], [*own, *hot_own], n))
        own = own.astype(np.int64)
        order = np.lexsort((h, n, own))
        h, own = h[order], own[order]
        count = np.bincount(own, minlength=len(sigs))
        take = sizes - need + 1 - (sizes - count)  # beside the entries that no other set has
        keep = np.arange(len(own)) - (np.cumsum(count) - count)[own] < take[own]
        h, sig = h[keep].astype(np.uint64), sigs[own[keep]]
        # Sets of this flush that share an entry are joined here; the entry goes on once.
        order = np.argsort(h, kind="stable")
        h, sig = h[order], sig[order]
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        leader = sig[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(h) else sig
        tie = leader != sig
        rows = [(int(table.column("flush")[0].as_py() % buckets), 1, _blob(sig[tie], "<i8"), _blob(leader[tie], "<i8"))] if tie.any() else []
        h, sig = h[new], sig[new]
        where = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        h, sig = h[order], sig[order]
        ends = np.searchsorted(where[order], np.arange(buckets + 1))
        rows += [(int(k), 0, _blob(h[ends[k] : ends[k + 1]], "<u8"), _blob(sig[ends[k] : ends[k + 1]], "<i8")) for k in np.flatnonzero(np.diff(ends))]
        schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("x", pa.binary()), ("y", pa.binary())])
        return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return select


def _meet(table: pa.Table) -> pa.Table:
    """A spanning forest of the classes that share an entry in a bucket."""
    both = [*_arrays(table, 0, ("x", "<u8"), ("y", "<i8")), *_arrays(table, 1, ("x", "<i8"), ("y", "<i8"))]
    h, own, a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in both)
    if len(h):
        order = np.argsort(h, kind="stable")
        h, own = h[order], own[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        leader = own[np.flatnonzero(new)[np.cumsum(new) - 1]]
        tie = leader != own
        a, b = np.concatenate([a, own[tie]]), np.concatenate([b, leader[tie]])
    nodes, roots = local_roots(a, b) if len(a) else (a, b)
    far = nodes != roots
    return pa.table({"a": pa.array(nodes[far], pa.int64()), "b": pa.array(roots[far], pa.int64())})


class Family:
    """Sets that may link, in order of size, with index lists sorted by that order."""

    def __init__(self, sets: list[np.ndarray]):
        self.m = m = len(sets)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        assert (np.diff(self.sizes) >= 0).all()
        owner = np.repeat(np.arange(m), self.sizes)
        _, tid = np.unique(np.concatenate(sets), return_inverse=True)
        shared = np.bincount(tid)[tid] > 1  # a shingle of one set adds to no overlap
        tid, owner = tid[shared], owner[shared]
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=m))])
        self.own = [tid[ends[i] : ends[i + 1]] for i in range(m)]  # rising in each set
        self.keys = np.sort(tid * m + owner)
        self.posts = self.keys % m
        # Sets whose sizes allow a link: 100 * smaller >= 75 * larger.
        self.low = np.searchsorted(100 * self.sizes, PERCENT * self.sizes, "left")
        self.high = np.searchsorted(PERCENT * self.sizes, 100 * self.sizes, "right")

    def scan(self, shingles: np.ndarray, low: int, high: int) -> np.ndarray:
        """How many of these shingles each set has, for sets low .. high - 1 only.

        In each list the entries before and after that range are skipped by position.
        """
        if low >= high or not len(shingles):
            return np.zeros(self.m, np.int64)
        at = np.searchsorted(self.keys, shingles * self.m + low)
        to = np.searchsorted(self.keys, shingles * self.m + high)
        size = to - at
        idx = np.arange(size.sum()) + np.repeat(at - (np.cumsum(size) - size), size)
        return np.bincount(self.posts[idx], minlength=self.m)

    def overlaps(self) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(set, low, high, overlaps with all sets in that range), each set once.

        The next set is the one nearest to a set already answered.
        """
        m = self.m
        known: list[np.ndarray | None] = [None] * m
        best, base = np.full(m, np.iinfo(np.int64).max), np.full(m, -1)
        left = np.ones(m, bool)
        weight = np.array([len(o) for o in self.own], np.int64)
        for _ in range(m):
            todo = np.flatnonzero(left)
            i = int(todo[best[todo].argmin()])
            low, high, x = int(self.low[i]), int(self.high[i]), int(base[i])
            if x >= 0 and 2 * best[i] < weight[i]:
                a, b = max(low, int(self.low[x])), min(high, int(self.high[x]))
                more = np.setdiff1d(self.own[i], self.own[x], assume_unique=True)
                less = np.setdiff1d(self.own[x], self.own[i], assume_unique=True)
                got = self.scan(more, a, b) - self.scan(less, a, b)
                got[a:b] += known[x][a:b]
                got += self.scan(self.own[i], low, a) + self.scan(self.own[i], b, high)
            else:
                got = self.scan(self.own[i], low, high)
            known[i], left[i] = got.astype(np.int32), False
            apart = weight[i] + weight[low:high] - 2 * got[low:high]
            nearer = apart < best[low:high]
            best[low:high][nearer] = apart[nearer]
            base[low:high][nearer] = i
            yield i, low, high, got

    def links(self, weight: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each set the weight of the sets that link with it, and the first set it reaches.

        side: with it, only links between sets of different sides count.
        """
        count, root = np.zeros(self.m, np.int64), np.arange(self.m)
        for i, low, high, got in self.overlaps():
            o = got[low:high]
            hit = 100 * o >= PERCENT * (self.sizes[i] + self.sizes[low:high] - o)
            if side is not None:
                hit &= side[low:high] != side[i]
            z = np.flatnonzero(hit) + low
            z = z[z != i]
            count[i] = weight[z].sum()
            joined = np.unique(root[np.append(z, i)])
            if len(joined) > 1:
                root[np.isin(root, joined)] = joined[0]
        return count, root


def _join_unit(table: pa.Table) -> pa.Table:
    """All links inside the families of a unit, or between two blocks of one family."""
    sets: dict[int, np.ndarray] = {}
    about: dict[int, tuple[int, int, int]] = {}
    table = table.select(["sig", "family", "weight", "block", "lo", "hi", "text"])
    for batch in table.to_batches():
        for part, found in _sets(batch, "text"):
            for s, sig, family, weight, block in zip(found, *(part.column(c).to_pylist() for c in ("sig", "family", "weight", "block")), strict=True):
                if sig not in sets and len(s) and signature(s) == sig:
                    sets[sig], about[sig] = s, (family, weight, block)
    lo, hi = (table.column(c)[0].as_py() for c in ("lo", "hi"))
    del table
    by: dict[int, list[int]] = {}
    for sig in sorted(sets):
        by.setdefault(about[sig][0], []).append(sig)
    out: list[list] = [[], [], []]
    for sigs in by.values():
        if len(sigs) > 1:
            sigs.sort(key=lambda s: (len(sets[s]), s))
            side = np.array([about[s][2] for s in sigs]) if lo != hi else None
            count, root = Family([sets[s] for s in sigs]).links(np.array([about[s][1] for s in sigs]), side)
            for i in np.flatnonzero((count > 0) | (root != np.arange(len(sigs)))):
                for column, value in zip(out, (sigs[i], sigs[root[i]], int(count[i])), strict=True):
                    column.append(value)
    sets.clear()
    release()
    return pa.table([pa.array(v, pa.int64()) for v in out], names=["sig", "root", "links"])


def _solve(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, fetch, n, component_id, n_links of each row, and whether it stands for its component.

    ``fetch`` is a hash of key and text: rows that agree in both share it.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).alias("key"), fetch_of(key, text).alias("fetch"), F.col(text).alias("text"))
    survey = cut(_survey(rows))
    total = survey.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    narrow = survey.where("kind = 0").select("key", "fetch", "n", "sig")
    counts = _counts(survey)
    buckets = max(parts, math.ceil(total * (100 - PERCENT + EXTRA) / 100 / BUCKET))
    back = _entries(rows, counts, buckets).groupBy("bucket").applyInArrow(_shared, _ROW_DDL)
    chosen = back.groupBy("flush").applyInArrow(_selector(buckets), "bucket int, kind int, x binary, y binary")
    # A copy, as tasks that meet and contract at once would need a second Python worker each, which stays.
    edges = cut(chosen.groupBy("bucket").applyInArrow(_meet, "a long, b long"))
    family = connected(edges)

    # A class is known by its first row: keys before nulls, by key, then by hash.
    first = F.min(F.struct(F.col("key").isNull().alias("keyless"), "key", "fetch")).alias("first")
    classes = cut(narrow.where("sig is not null").groupBy("sig").agg(first, F.max("n").alias("n"), F.count(F.lit(1)).alias("weight")))
    member = cut(family.select(F.col("node").alias("sig"), F.col("component").alias("family")).join(classes, "sig").select("sig", "family", "first.fetch", "n", "weight"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    large = cut(member.groupBy("family").agg(blocks.alias("blocks"), F.sum("n").alias("shingles")))
    units = max(parts, math.ceil((large.agg(F.sum("shingles")).first()[0] or 0) / UNIT_SHINGLES))
    placed = member.join(large.where("blocks > 1").select("family", "blocks"), "family", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(
        "sig", "family", "fetch", "weight", "block",
        F.when(F.col("blocks") > 1, F.col("family")).otherwise(F.pmod(F.xxhash64("family"), F.lit(units))).alias("unit"),
        F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
    )
    texts = rows.select("fetch", "text").join(placed, "fetch")
    found = cut(texts.groupBy("unit", "lo", "hi").applyInArrow(_join_unit, "sig long, root long, links long"))
    links = found.groupBy("sig").agg(F.sum("links").alias("links"))
    reached = connected(found.where("sig != root"), "sig", "root").withColumnRenamed("node", "sig")
    joined = cut(classes.join(reached, "sig", "left").join(links, "sig", "left"))
    # The copy lets the join on a large component be split.
    smallest = cut(joined.where("component is not null").groupBy("component").agg(F.min("first").alias("least")))
    several = joined.join(smallest, "component").select("sig", "least", "links", "weight")
    alone = joined.where("component is null").select("sig", F.col("first").alias("least"), "links", "weight")
    known = several.unionByName(alone).select("sig", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    made = narrow.join(known, "sig", "left")
    component = F.when(F.col("sig").isNull(), F.col("key")).otherwise(F.col("least.key"))
    stands = F.col("sig").isNull() | (F.col("fetch") == F.col("least.fetch"))
    return made.select("key", "fetch", "n", "sig", component.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), stands.alias("stands"))


def fetch_of(key: str, text: str) -> F.Column:
    """A hash of a row's key and text."""
    return F.xxhash64(F.col(key), F.col(text))


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: key, n_shingles, component_id, n_links."""
    return _solve(docs, key, text).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", "n_links")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of links, as it was: the one with the smallest key.

    Among rows that share that key the one with the smallest hash of key and text stays, of rows
    that repeat both any one; a group without a key is represented by the smallest hash.  Rows
    without words are linked with nothing, so all of them stay.
    """
    standing = cut(_solve(docs, key, text).where("stands").groupBy("fetch").agg(F.count("sig").alias("_linked")))
    own = docs.withColumn("_fetch_of_row", fetch_of(key, text))
    pick = lambda which: own.join(standing.where(which).select(F.col("fetch").alias("_fetch_of_row")), "_fetch_of_row", "left_semi")
    kept = pick("_linked <= 1")
    # Rows that repeat key and text are rare: a second pass finds them only if there are any.
    if not standing.where("_linked > 1").isEmpty():
        kept = kept.unionByName(pick("_linked > 1").dropDuplicates(["_fetch_of_row"]))
    return kept.drop("_fetch_of_row")
