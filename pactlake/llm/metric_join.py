"""Exact metric range join of vectors: near-duplicates by cosine within equal labels.

Pivots, farthest-first from a bounded sample, partition the vectors of a label by the nearest one,
a pivot for each ``BLOCK`` vectors of the label; cells of more than ``BLOCK`` vectors are cut into blocks by a
hash.  On the unit sphere distance is Euclidean, so the triangle inequality bounds how far a
vector is from any vector of another cell, in two ways: its distance to the cell's pivot less the
cell's radius, and its distance to the plane half-way between the two pivots.  A vector is sent to
a pair of blocks only if neither bound exceeds the range, and each pair of blocks is joined on its
own, by exact cosines in double precision.  Equal vectors of a label are one class until the end.

What goes to every task is bounded: ``PIVOTS`` vectors of each length, and four numbers for each of
2 * ``CELLS`` cells at most; with more than ``BLOCK * CELLS`` vectors cells get larger in proportion.

Defined results: vectors are scaled by a power of two before they are multiplied, so those of any
finite magnitude link alike; vectors that are null, empty, zero, hold a null or a non-finite
component, or have a null label link with nothing; vectors of different lengths do not link; rows
that repeat a key count as separate vectors, whatever their vectors and labels; rows with a null
key link like any other but lend no component id (null, and all of them kept, where a component has no
key); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlake.llm._batches import cut
from pactlake.llm.components import connected, local_roots

#: Vectors of a block; pivots of a length and cells of all labels at most; rows that pivots are drawn from.
BLOCK, PIVOTS, CELLS, SAMPLE = 4096, 2048, 1 << 18, 8192
#: Cosines this near the limit are taken again by exact sums; slack of the bounds, for rounding.
CLOSE, SLACK = 1e-9, 1e-7


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows scaled by a power of two, so that their largest component is between 0.5 and 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first pivots of unit vectors; the first k of them are the k that it would choose."""
    if not len(sample) or n <= 0:
        return np.zeros((0, sample.shape[1] if sample.ndim == 2 else 0))
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < min(n, len(sample)):
        k = int(near.argmin())
        if near[k] > 1 - 1e-12:
            break
        chosen.append(k)
        near = np.maximum(near, sample @ sample[k])
    return sample[chosen]


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def links_of(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which rows of x and y reach the cosine, in double precision."""
    x, y = scaled(x), scaled(y)
    s = _unit(x) @ _unit(y).T
    hit = s >= least
    for i, j in zip(*np.nonzero(np.abs(s - least) < CLOSE), strict=True):
        hit[i, j] = _cosine(x[i], y[j]) >= least
    return hit


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (_unit(x) @ pivots.T)))


class Cells:
    """The cells of a label and length: where each one's blocks begin, how many, its radius."""

    def __init__(self, cell: tuple[int, ...], blocks: tuple[int, ...], radius: tuple[float, ...]):
        self.cell, self.blocks, self.radius = np.array(cell, np.int32), np.array(blocks, np.int32), np.array(radius)
        self.first = np.cumsum(self.blocks, dtype=np.int64) - self.blocks

    def near(self, x: np.ndarray, own: np.ndarray, pivots: np.ndarray, reach: float) -> np.ndarray:
        """Which cells each vector may have a link in; own: places of the vectors' own cells."""
        p, at = pivots[self.cell], np.arange(len(x))
        d = _distances(x, p)
        home = d[at, own][:, None]
        apart = np.sqrt(np.maximum(1e-12, 2 - 2 * (p[own] @ p.T)))
        ok = (d - self.radius <= reach) & ((d * d - home * home) / (2 * apart) <= reach)
        ok[at, own] = True
        return ok


def near_duplicates(vectors: DataFrame, *, least: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK, pivots: int = PIVOTS, most_cells: int = CELLS) -> DataFrame:
    """One row for each vector: key, n_links, component_id, kept."""
    spark = vectors.sparkSession
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce(F.col(label).isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(key).alias("_key"), F.col(label).alias("label"), F.when(usable, F.transform(v, lambda x: x + F.lit(0.0))).alias("v"))
    good = rows.where("v is not null")
    # Equal vectors of a label are one class with a number of its own; the shared copy fixes the numbers.
    classes = cut(good.groupBy("label", "v").agg(F.min("_key").alias("rep"), F.count(F.lit(1)).alias("n")).select("label", "v", "rep", "n", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("id")))
    sizes = cut(classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("size")))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    room = max(block, math.ceil(total / most_cells))  # vectors of a cell, about
    large = sizes.groupBy("dim").agg(F.max("size").alias("largest"), F.sum("size").alias("of")).where(F.col("largest") > room)
    chosen: dict[int, np.ndarray] = {}
    for r in large.orderBy(F.desc("largest"), "dim").limit(64).collect():  # vectors of other lengths are joined by blocks alone
        draw = F.pmod(F.xxhash64("id", F.lit("pivot")), F.lit(1 << 40))
        some = classes.where((F.col("dim") == r.dim) & (draw < int((1 << 40) * min(1.0, 2 * SAMPLE / r.of))))
        sample = some.orderBy(draw, "id").select("v").limit(SAMPLE).collect()
        chosen[r.dim] = choose_pivots(_unit(np.array([x.v for x in sample])), min(pivots, math.ceil(r.largest / room)))
    shared = spark.sparkContext.broadcast(chosen)  # PIVOTS vectors of each of 64 lengths at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim, size = (b.column(c).to_numpy() for c in ("dim", "size"))
            lists = b.column("v").to_numpy(zero_copy_only=False)
            cell, own = np.zeros(len(dim), np.int32), np.zeros(len(dim))
            for d, p in shared.value.items():
                for k in np.unique(size[dim == d]):
                    use = min(len(p), math.ceil(k / room))
                    if use > 1:
                        at = np.flatnonzero((dim == d) & (size == k))
                        for part in np.array_split(at, -(-len(at) // 512)):
                            dist = _distances(np.stack(lists[part]), p[:use])
                            cell[part] = dist.argmin(1)
                            own[part] = dist.min(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(own)], names=[*b.schema.names, "cell", "own"])

    kind = classes.schema["rep"].dataType.simpleString()
    lab = classes.schema["label"].dataType.simpleString()
    ddl = f"label {lab}, dim int, v array<double>, id long, n long, size long, cell int, own double"
    placed = cut(classes.join(sizes, ["label", "dim"]).select("label", "dim", "v", "id", "n", "size").mapInArrow(assign, ddl))
    blocks = F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")
    listed = placed.where(F.col("size") > room).groupBy("label", "dim", "cell").agg(blocks, F.max("own").alias("radius")).orderBy("label", "dim", "cell")
    plans: dict[tuple, list] = {}
    for r in listed.collect():  # 2 * most_cells rows at most
        plans.setdefault((r.label, r.dim), []).append((r.cell, r.blocks, r.radius))
    cells = {k: Cells(*zip(*own, strict=True)) for k, own in plans.items() if k[1] in chosen}
    told = spark.sparkContext.broadcast(cells)
    reach = math.sqrt(2 - 2 * least) + SLACK
    names = ["label", "dim", "v", "id", "n", "lo", "hi", "home"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, dim = (b.column(c).to_pylist() for c in ("label", "dim"))
            size, cell, number = (b.column(c).to_numpy() for c in ("size", "cell", "id"))
            lists = b.column("v").to_numpy(zero_copy_only=False)
            spread = number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            groups: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(labels, dim, strict=True)):
                groups.setdefault(k, []).append(i)
            for k, at in groups.items():
                plan = told.value.get(k)
                for part in np.array_split(np.array(at), -(-len(at) // 512)):
                    if plan is None:
                        n_blocks = -(-int(size[part[0]]) // block)
                        home = (spread[part] % np.uint64(n_blocks)).astype(np.int64)
                        i, other = np.repeat(np.arange(len(part)), n_blocks), np.tile(np.arange(n_blocks), len(part))
                    else:
                        own = np.searchsorted(plan.cell, cell[part])
                        home = plan.first[own] + (spread[part] % plan.blocks[own].astype(np.uint64)).astype(np.int64)
                        i, c = np.nonzero(plan.near(np.stack(lists[part]), own, shared.value[dim[part[0]]], reach))
                        many = plan.blocks[c]
                        other = np.repeat(plan.first[c] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                        i = np.repeat(i, many)
                    for rows_at in range(0, len(i), 1 << 16):
                        take, to = i[rows_at : rows_at + (1 << 16)], other[rows_at : rows_at + (1 << 16)]
                        from_ = home[take]
                        ends = (np.minimum(from_, to), np.maximum(from_, to), from_)
                        yield pa.RecordBatch.from_arrays([*(b.column(x).take(pa.array(part[take])) for x in names[:5]), *(pa.array(e.astype(np.int32)) for e in ends)], names=names)

    sent = placed.mapInArrow(send, f"label {lab}, dim int, v array<double>, id long, n long, lo int, hi int, home int")

    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        x, number, n = np.stack(group.v.to_numpy()), group.id.to_numpy(), group.n.to_numpy()
        lo, hi = int(group.lo.iloc[0]), int(group.hi.iloc[0])
        a = np.flatnonzero(group.home == lo)
        b = np.flatnonzero(group.home == hi)
        count = np.zeros(len(number), np.int64)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        if len(a) and len(b):
            for at in range(0, len(a), 1024):
                rows = a[at : at + 1024]
                hit = links_of(x[rows], x[b], least)
                if lo == hi:
                    hit[np.arange(len(rows)), np.arange(at, at + len(rows))] = False
                count[rows] += hit @ n[b]
                if lo != hi:
                    count[b] += n[rows] @ hit
                i, j = np.nonzero(hit)
                if len(i):
                    ends.append(local_roots(rows[i], b[j]))
        out = pd.DataFrame({"id": number, "links": count, "root": number})
        if ends:
            nodes, roots = local_roots(np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends]))
            out.loc[nodes, "root"] = number[roots]
        return out[(out.links > 0) | (out.root != out.id)]

    found = cut(sent.groupBy("label", "dim", "lo", "hi").applyInPandas(join, "id long, links long, root long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = connected(found.where("id != root"), "id", "root").withColumnRenamed("node", "id")
    joined = cut(classes.select("label", "v", "id", "rep", "n").join(links, "id", "left").join(groups, "id", "left"))
    smallest = cut(joined.where("component is not null").groupBy("component").agg(F.min("rep").alias("least")))
    several = joined.join(smallest, "component").select("label", "v", "links", "n", "least")
    alone = joined.where("component is null").select("label", "v", "links", "n", F.col("rep").alias("least"))
    of = several.unionByName(alone).select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "least")
    made = rows.where("v is not null").join(of, ["label", "v"], "left").select("_key", "n_links", F.col("least").alias("component_id"))
    lone = rows.where("v is null").select("_key", F.lit(0).cast("long").alias("n_links"), F.col("_key").alias("component_id"))
    made = made.unionByName(lone)
    return made.select(F.col("_key").alias(key), "n_links", "component_id", F.coalesce(F.col("_key") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
