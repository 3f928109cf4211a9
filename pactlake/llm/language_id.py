"""Language identification by bit-sliced Bloom filters of character n-grams.

Each language has a Bloom filter of its n-grams.  The filters are stored sliced: one 64-bit word
(one more for each further 64 languages) for each bit position, holding that bit of every language's filter, so that the AND of a
gram's words is the mask of all languages that contain it.  A text's grams are looked up
together; the popcount of each language, less the hits that its filter's fill makes by chance,
decides.  Counts cover the whole text.

A language's filter holds the grams seen at least ``MIN_COUNT`` times whose relative frequency there is
at least ``SHARE`` of the highest in any language.  It is learned from at most ``SAMPLE`` labelled
rows of each language, chosen by a hash of the key.

Defined results: ``und`` with score 0 for a text that is null or has no letter; ties go to the
first language in alphabetical order; with nothing to learn from, every text is ``und``; rows
with a null key count as held out, and repeated rows get the same answer each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlake.llm._batches import SLICE_BYTES, bounded_batches, release, slices

#: Lengths of grams; bit positions and hashes of a filter.
ORDERS, BITS, HASHES = (2, 3, 4), 20, 2
#: Labelled rows of a language that are learned from at most; grams a language keeps at most.
SAMPLE, KEEP = 2000, 60_000
#: Languages that are learned at most; characters of a longer text that are looked at together.
MOST, PIECE = 1024, 1 << 20
#: Grams that a task counts together when it learns.
FLUSH = 1 << 20
MIN_COUNT, SHARE = 3, 0.25
_LETTER: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def _hashed(code: np.ndarray, stop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the hashes of the grams that begin before ``stop``, and where they begin."""
    letter = letters()[code]
    code = np.where(letter, code, np.uint32(32))
    seen = np.cumsum(np.concatenate([[0], letter]), dtype=np.int64)
    h = code * np.uint32(0x9E3779B1)
    for n in range(2, max(ORDERS) + 1):
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + code[n - 1 :] * np.uint32(0xC2B2AE3D)
        if n in ORDERS:
            good = np.flatnonzero(seen[n:] - seen[:-n] >= n - 1)
            good = good[good < stop]
            yield h[good] ^ np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF), good


def _code(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of all grams and the text each belongs to, some at a time.

    Case is folded and whatever is no letter counts as a space; a gram holds at most one.  A
    text's gap stands before it, so that grams that start in the gap are the text's own.  A text
    of over ``PIECE`` characters goes piece by piece; pieces share the characters that grams need.
    """
    gap = " " * max(ORDERS)
    lowered = [(t or "").lower() for t in texts]
    short = [i for i, t in enumerate(lowered) if len(t) <= PIECE]
    if short:
        code = _code(gap.join(["", *(lowered[i] for i in short), ""]))
        of = np.repeat(np.array(short, np.int32), [len(lowered[i]) + len(gap) for i in short])
        for h, at in _hashed(code, len(of)):
            yield h, of[at]
    for i, t in enumerate(lowered):
        if len(t) > PIECE:
            t = gap + t + gap
            for p in range(0, len(t) - len(gap), PIECE):
                stop = min(PIECE, len(t) - len(gap) - p)
                for h, at in _hashed(_code(t[p : p + stop + max(ORDERS) - 1]), stop):
                    yield h, np.full(len(at), i, np.int32)


def lettered(texts: list[str]) -> np.ndarray:
    """Which texts have a letter."""
    return np.array([any(map(str.isalpha, t or "")) for t in texts], bool)


def positions(h: np.ndarray) -> list[np.ndarray]:
    """The bit positions of grams."""
    out = []
    for seed in range(HASHES):
        x = (h ^ (h >> np.uint32(16))) * np.uint32((0x7FEB352D, 0x846CA68B)[seed % 2])
        out.append((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * seed) >> np.uint32(32 - BITS))
    return out


@dataclass(frozen=True)
class SlicedFilters:
    """The languages, the sliced filters and each filter's chance of a false hit."""

    languages: list[str]
    words: np.ndarray
    chance: np.ndarray

    @staticmethod
    def build(profiles: dict[str, np.ndarray]) -> SlicedFilters:
        names = sorted(profiles)
        words = np.zeros((-(-len(names) // 64), 1 << BITS), np.uint64)
        fill = np.zeros(len(names))
        for k, lang in enumerate(names):
            for at in positions(profiles[lang].astype(np.uint32)):
                np.bitwise_or.at(words[k // 64], at, np.uint64(1 << k % 64))
            fill[k] = np.mean(words[k // 64] >> np.uint64(k % 64) & np.uint64(1))
        return SlicedFilters(names, words, fill**HASHES)

    def corrected(self, texts: list[str]) -> np.ndarray:
        """Hits of each text in each language, less those expected by chance."""
        hits, total = np.zeros((len(self.languages), len(texts))), np.zeros(len(texts))
        for h, owners in grams(texts):
            at = positions(h)
            total += np.bincount(owners, minlength=len(texts))
            for group, words in enumerate(self.words):  # 64 languages each
                mask = words[at[0]]
                for more in at[1:]:
                    mask &= words[more]
                some = np.flatnonzero(mask)
                mask, of = mask[some], owners[some]
                for k in range(64 * group, min(64 * group + 64, len(self.languages))):
                    hits[k] += np.bincount(of[(mask >> np.uint64(k % 64) & np.uint64(1)).astype(bool)], minlength=len(texts))
        free = np.maximum(1 - self.chance, 1e-9)[:, None]
        return np.maximum(0, (hits - self.chance[:, None] * total) / free).T

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Languages, and the share of the winner in all corrected hits."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        own, known = self.corrected(texts), lettered(texts)
        best, whole = own.argmax(1), own.sum(1)
        score = np.where(known & (whole > 0), own[np.arange(len(texts)), best] / np.maximum(whole, 1e-9), 0.0)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, known, strict=True)], np.clip(score, 0, 1)


def held_out(key: str = "doc_id") -> F.Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, most: int = MOST) -> SlicedFilters:
    """Filters from labelled rows that are not held out.

    At most ``sample`` rows a language, chosen by a hash of the key, then of the text, whatever keys repeat;
    of more than ``most`` languages the rarest are not learned.
    """
    from pyspark.sql import Window

    known = docs.where(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    known = known.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.lit("sample")).alias("draw"))
    part = F.pmod("draw", F.lit(1_000_000)) / 1_000_000
    found = known.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.min(part).alias("first")).orderBy(F.desc("rows"), "lang").limit(most).collect()
    if not found:
        return SlicedFilters.build({})
    # Somewhat more than the sample, and the first key in any case: keys may repeat.
    wanted = F.create_map(*[F.lit(x) for r in found for x in (r.lang, max(1.5 * sample / r.rows, r.first + 1e-9))])
    drawn = known.where(part < F.element_at(wanted, F.col("lang")))
    order = Window.partitionBy("lang").orderBy("draw", F.xxhash64("text"))
    rows = drawn.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        n = 0

        def sums() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                gram, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": [name] * len(gram), "gram": gram.astype(np.int64), "n": n})
            held.clear()

        for b in batches:
            for s in slices(b, "text", FLUSH // 8):
                names = np.array(s.column("lang").to_pylist(), object)
                for h, of in grams(s.column("text").to_pylist()):
                    n += len(h)
                    for name in set(names):
                        held.setdefault(name, []).append(h[(names == name)[of]])
                    if n >= FLUSH:
                        yield from sums()
                        n = 0
        yield from sums()
        release()

    # The sample is bounded; a language keeps its most frequent grams, a bounded number too.
    sums = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)
    ranked = sums.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= KEEP)
    got = ranked.select("lang", "gram", "n").toPandas()
    got["f"] = got.n / got.groupby("lang").n.transform("sum")
    got = got[got.f >= SHARE * got.groupby("gram").f.transform("max")]
    return SlicedFilters.build({name: g.gram.to_numpy() for name, g in got.groupby("lang")})


def predict(docs: DataFrame, filters: SlicedFilters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: key, held_out, lang_pred, score."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(filters)  # 8 MB for each 64 languages
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), held_out(key).alias("held_out"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, "_text", SLICE_BYTES // 8):
                lang, score = shared.value.predict(s.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(lang, pa.string()), pa.array(score)], names=[key, "held_out", "lang_pred", "score"])
        release()

    return rows.mapInArrow(run, f"`{key}` {kind}, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, filters: SlicedFilters, text: str = "text", least: float = 0.0) -> DataFrame:
    """Drops the documents whose language can't be told: ``und``, none of whose grams a language
    holds beyond chance, or that score below ``least``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, text, SLICE_BYTES // 8):
                lang, score = shared.value.predict(s.column(text).to_pylist())
                yield s.filter(pa.array([x != "und" and p > 0 and p >= least for x, p in zip(lang, score, strict=True)], pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)
