"""Toxicity scores: boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of a fixed and a learned lexicon (words, and word
beginnings for inflected languages), how near second-person words stand to lexicon words,
rates of capitals, punctuation, digits and repeated signs, and the rate of obfuscated spellings
(letters replaced by digits or signs, or broken up by them).

The lexicon and the trees are learned from at most ``SAMPLE`` labelled rows chosen by a hash
of the key; a quarter of them fits the calibration only.  Rows held out (``held_out``) are never learned
from.

Defined results: a null or empty text has all features 0 and a score like any other; several
labels of one key count as their maximum; null labels are ignored; without both labels to
learn from, every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactlake.llm._batches import SLICE_BYTES, TwoGenerationCache, bounded_batches, cut, release, slices
from pactlake.llm.boosting import Isotonic, Trees, fit_isotonic, fit_trees

#: Labelled rows that are learned from at most; terms of the learned lexicon at most.
SAMPLE, TERMS = 20_000, 4000
#: A learned term occurs in so many toxic rows at least, and its smoothed log-odds reach so much.
TERM_ROWS, TERM_ODDS = 5, 2.0
#: Characters of a longer text that are looked at together; characters of a lexicon word at most.
PIECE, LONGEST = 1 << 20, 1000
#: Lengths of word beginnings; words between a lexicon word and a second-person word at most.
STEMS, NEAR = (4, 5, 6), 4
#: Words of insult and threat, second-person words in five languages.
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash worthless pathetic disgusting clown imbecile retard bastard bitch bastards fool vermin kill hate ugly shut damn crap".split())
YOU = frozenset("you your yours yourself youre ya u ur thou thee du dich dir dein deine ihr euch tu toi te vous votre vos ton ta tes tú ti tuyo usted ustedes vosotros tus lei voi".split())
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"})
_SPELT = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?![^\W\d_])")
_RUN = re.compile(r"(\w)\1{2,}")
NAMES = ("fixed", "learned", "weight", "strongest", "stem", "near_you", "you", "capitals", "shouted", "punctuation", "exclaims", "digits", "signs", "obfuscated", "hits", "words")
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
for _c in b".,;:'\"()-":
    _CLASS[_c] = 4
for _c in b"!?":
    _CLASS[_c] = 5
for _c in b"*#@$%&^~_+=|<>\\/[]{}`":
    _CLASS[_c] = 6


def plain(word: str) -> str:
    """A lower-case word without signs at its ends."""
    return word.strip(".,;:!?\"'()[]{}*%&$#@|<>-_~`^+=/\\…«»“”’")


def undo(word: str) -> str:
    """A word with look-alike signs read as letters, other signs and repeats removed."""
    return _RUN.sub(r"\1", "".join(c for c in word.translate(_LEET) if c.isalpha()))


@dataclass
class Lexicon:
    """Learned terms with their weights: whole words and, led by ``^``, beginnings of words."""

    terms: dict[str, float] = field(default_factory=dict)
    memo: TwoGenerationCache = field(default_factory=lambda: TwoGenerationCache(200_000), repr=False)

    def look(self, word: str) -> tuple | None:
        """(fixed, learned weight, stem weight, second person, obfuscated), or None for none of these."""
        p = plain(word)
        fixed, obfuscated = p in INSULTS, False
        weight = self.terms.get(p, 0.0)
        stem = max((self.terms.get("^" + p[:n], 0.0) for n in STEMS if len(p) >= n), default=0.0)
        if not p.isalpha() and p:
            inner = undo(p)
            if inner != p and len(inner) >= 4 and any(c.isalpha() for c in p) and (inner in INSULTS or self.terms.get(inner, 0.0) > 0):
                fixed, obfuscated, weight = inner in INSULTS, True, max(weight, self.terms.get(inner, 0.0))
        you = p in YOU or p.partition("'")[0] in YOU
        return (fixed, weight, stem, you, obfuscated) if fixed or weight or stem or you or obfuscated else None

    def __getstate__(self):
        return {"terms": self.terms}

    def __setstate__(self, state):
        self.terms, self.memo = state["terms"], TwoGenerationCache(200_000)

    def features(self, texts: list[str]) -> np.ndarray:
        """A row of ``NAMES`` for each text; a text of over ``PIECE`` characters goes by pieces."""
        out = np.zeros((len(texts), len(NAMES)))
        short = [i for i, t in enumerate(texts) if len(t) <= PIECE]
        split = [words_of(texts[i]) for i in short]
        known = self._known({w for words in split for w in words})
        for i, words in zip(short, split, strict=True):
            if words:
                out[i] = self._count(texts[i], words, known, 3).row()
        for i, text in enumerate(texts):
            if len(text) > PIECE:
                tally = Tally()
                for piece in pieces(text, PIECE):
                    words = words_of(piece)
                    self._count(piece, words, self._known(set(words)), 1, tally)
                out[i] = tally.row()
        return out

    def _known(self, words: set[str]) -> dict[str, tuple]:
        for w in self.memo.settle(words):
            self.memo.young[w] = self.look(w) or ()
        return self.memo.young

    def _count(self, text: str, words: list[str], known: dict[str, tuple], spaced: int, tally: Tally | None = None) -> Tally:
        """Adds a text or a piece of one; spaced: single letters in a row without which none is spelt out in it."""
        t = tally or Tally()
        found = [(t.words + at, hit) for at, w in enumerate(words) if (hit := known[w])]
        t.toxic += [(at, h) for at, h in found if h[0] or h[1] or h[2]]
        t.you += [at for at, h in found if h[3]]
        t.words += len(words)
        t.chars += len(text)
        n = len(_SPACED.findall(text))
        t.spaced += n
        if n >= spaced:
            t.spelt += sum(undo(m.lower()) in INSULTS or undo(m.lower()) in self.terms for m in _SPELT.findall(text))
        t.signs += np.bincount(_CLASS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)], minlength=7)
        t.shouted += len(_SHOUT.findall(text))
        return t


@dataclass
class Tally:
    """Counts of one text."""

    words: int = 0
    chars: int = 0
    shouted: int = 0
    spaced: int = 0
    spelt: int = 0
    signs: np.ndarray = field(default_factory=lambda: np.zeros(7, np.int64))
    toxic: list[tuple[int, tuple]] = field(default_factory=list)
    you: list[int] = field(default_factory=list)

    def row(self) -> tuple:
        n, chars, c, toxic = self.words, self.chars, self.signs, [h for _, h in self.toxic]
        if not n:
            return (0.0,) * len(NAMES)
        you, near = np.array(self.you), 0
        if len(you) and toxic:
            at = np.array([a for a, _ in self.toxic])
            k = np.searchsorted(you, at)
            gap = np.minimum(np.abs(you[np.minimum(k, len(you) - 1)] - at), np.abs(you[np.maximum(k - 1, 0)] - at))
            near = int((gap <= NEAR).sum())
        spelt = self.spelt if self.spaced >= 3 else 0
        fixed, learned = sum(h[0] for h in toxic) + spelt, sum(h[1] > 0 for h in toxic)
        weights = [max(h[1], h[2]) for h in toxic]
        return (
            100 * fixed / n, 100 * learned / n, 100 * sum(weights) / n, max(weights, default=0.0), 100 * sum(h[2] > 0 for h in toxic) / n,
            100 * near / n, 100 * len(you) / n, c[1] / chars, 100 * self.shouted / n, c[4] / chars, 100 * c[5] / chars, c[3] / chars, c[6] / chars,
            100 * (sum(h[4] for h in toxic) + spelt) / n, min(len(toxic) + spelt, 50), np.log1p(n),
        )


def words_of(text: str) -> list[str]:
    """The words; one of over ``LONGEST`` characters counts, but is no lexicon word."""
    words = text.lower().split()
    if words and max(map(len, words)) > LONGEST:
        return [w if len(w) <= LONGEST else "" for w in words]
    return words


def pieces(text: str, size: int) -> Iterator[str]:
    """A long text cut at white space after two letters, where it cuts no word and no word that is
    spelt out; a piece is longer than ``size`` where there is no such place."""
    at = 0
    while at < len(text):
        found = _BREAK.search(text, at + size)
        end = found.end() if found else len(text)
        yield text[at:end]
        at = end


_BREAK = re.compile(r"[^\W\d_]{2}\s")
_SHOUT = re.compile(r"\b[A-Z]{3,}\b")
_SPACED = re.compile(r"\b[^\W\d_][ .\-_*](?=[^\W\d_]\b)")


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    trees: Trees
    calibration: Isotonic

    def score(self, texts: list[str]) -> np.ndarray:
        return self.calibration(self.trees.raw(self.lexicon.features(texts)))


def held_out(key: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _learn_terms(rows: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, "text", SLICE_BYTES // 4):
                by: tuple[Counter, Counter] = (Counter(), Counter())
                for text, label in zip(s.column("text").to_pylist(), s.column("toxic").to_pylist(), strict=True):
                    words = {w for x in set((text or "").lower().split()) if 3 <= len(w := plain(x)) <= 40}
                    by[label].update(words)
                    by[label].update({"^" + w[:n] for w in words for n in STEMS if len(w) > n})
                terms = list(by[0].keys() | by[1].keys())
                yield pa.RecordBatch.from_pydict({"term": terms, "bad": [by[1][t] for t in terms], "good": [by[0][t] for t in terms]})
        release()

    sums = rows.mapInArrow(count, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (toxic + 1)) - F.log((F.col("good") + 0.5) / (clean + 1))
    best = sums.where(F.col("bad") >= TERM_ROWS).withColumn("w", odds).where(F.col("w") >= TERM_ODDS).orderBy(F.desc(F.col("w") * F.log("bad")), "term").limit(TERMS)
    return {r.term: float(r.w) for r in best.select("term", "w").collect()}


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learns from labelled rows that are not held out, ``sample`` of them at most.

    Labels other than 0 count as 1.  Of rows that repeat a key the smallest text is learned from.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where(~held_out(key) & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max((F.col(label) != 0).cast("int")).alias("toxic"))
    # At most ``sample`` narrow rows, so they may be broadcast; a key that repeats gives one text.
    chosen = known.withColumn("draw", F.pmod(F.xxhash64("_key", F.lit("sample")), F.lit(1 << 60))).orderBy("draw", "_key").limit(sample)
    rows = cut(docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(chosen), "_key").groupBy("_key").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"), F.min("draw").alias("draw")))
    share = {r.toxic: r[1] for r in rows.groupBy("toxic").count().collect()}
    if not share.get(0) or not share.get(1):
        p = share.get(1, 0) / max(1, share.get(0, 0) + share.get(1, 0)) if share else 0.5
        return Model(Lexicon(), Trees(0.0, np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2))), Isotonic(np.array([0.0, 1.0]), np.array([p, p])))
    fitted = rows.where("draw % 4 != 0")
    by = {r.toxic: r[1] for r in fitted.groupBy("toxic").count().collect()}
    lexicon = Lexicon(_learn_terms(fitted, by.get(1, 0), by.get(0, 0)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, "text", SLICE_BYTES // 4):
                x = lexicon.features([t or "" for t in s.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([s.column("draw"), s.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))], names=["draw", "toxic", "x"])

    got = rows.mapInArrow(features, "draw long, toxic int, x array<double>").orderBy("draw", "x").toPandas()  # bounded by ``sample``
    x, y, apart = np.stack(got.x), (got.toxic.to_numpy() > 0).astype(float), got.draw.to_numpy() % 4 == 0
    trees = fit_trees(x[~apart], y[~apart]) if 0 < y[~apart].mean() < 1 else Trees(0.0, np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)))
    held = apart if 0 < y[apart].sum() < apart.sum() else np.ones(len(y), bool)
    return Model(lexicon, trees, fit_isotonic(trees.raw(x[held]), y[held]))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: key, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: TERMS terms and the trees
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, "_text", SLICE_BYTES // 4):
                p = shared.value.score([t or "" for t in s.column("_text").to_pylist()])
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[key, "held_out", "score", "predicted"])
        release()

    rows = docs.select(F.col(key), held_out(key).alias("held_out"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"`{key}` {kind}, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: Model, text: str = "text", reject: float = 0.5) -> DataFrame:
    """Drops the documents that score ``reject`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, text, SLICE_BYTES // 4):
                yield s.filter(pa.array(shared.value.score([t or "" for t in s.column(text).to_pylist()]) < reject))
        release()

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
