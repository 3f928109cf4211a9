"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps a score-ordered agenda of adjacent symbol pairs: the pair whose merged piece
scores highest, leftmost among equals, is merged until no adjacent pair forms a piece; what
is no piece falls back to its bytes.  Because a merge can only join two characters that stand
side by side inside some piece, a text may be cut wherever its two neighbours never do, and
each part is encoded once and remembered (a bounded memo).  Every part that is encoded is
checked, in Arrow batches, against the sentencepiece library.

Defined results: a null or empty text has only the begin and end ids and decodes to the empty
text; repeated rows give repeated results; other columns pass through ``encode`` untouched,
and a clash of a column name with an output name raises ``ValueError``.
"""

from __future__ import annotations

import array
import hashlib
import heapq
import re
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactlake.llm._batches import TwoGenerationCache, bounded_batches, slices

SPACE = "▁"
#: Entries in each of the memo's two generations.
MEMO = 300_000
#: Symbols up to which the agenda is an array; a score that no pair has.
ARRAY, NEVER = 48, float("inf")


class PieceModel:
    """A BPE vocabulary read from a model file, with encoder and decoder."""

    def __init__(self, path: str, memo: int = MEMO):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)
        size = lib.vocab_size()
        self.pieces = {lib.id_to_piece(i): i for i in range(size) if not special(i) and not lib.is_unused(i)}
        self.rank = {p: -lib.get_score(i) for p, i in self.pieces.items()}
        self.byte_ids = {int(lib.id_to_piece(i)[1:-1], 16): i for i in range(size) if lib.is_byte(i)}
        self.bytes_of = [b"" if lib.is_control(i) else bytes([int(lib.id_to_piece(i)[1:-1], 16)]) if lib.is_byte(i) else b" \xe2\x81\x87 " if lib.is_unknown(i) else lib.id_to_piece(i).replace(SPACE, " ").encode() for i in range(size)]
        self.unknown, self.begin, self.end = lib.unk_id(), lib.bos_id(), lib.eos_id()
        self.pairs = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        if any(pair[1] == SPACE and pair[0] != SPACE for pair in self.pairs):
            raise ValueError("the vocabulary has pieces that run across a space")
        self.memo, self.parts = TwoGenerationCache(memo), TwoGenerationCache(memo)

    def merge(self, part: str) -> list[int]:
        """Ids of one part's pieces; the agenda is an array of pair scores, or a heap for long parts."""
        return self._ids(self._merge_long(part) if len(part) > ARRAY else self._merge_short(part))

    def _merge_short(self, part: str) -> list[str]:
        get, symbols = self.rank.get, list(part)
        agenda = [get(a + b, NEVER) for a, b in zip(part, part[1:], strict=False)]
        while agenda and (best := min(agenda)) < NEVER:
            i = agenda.index(best)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = get(symbols[i] + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = get(symbols[i - 1] + symbols[i], NEVER)
        return symbols

    def _merge_long(self, part: str) -> list[str]:
        rank, n = self.rank, len(part)
        symbols: list = list(part)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = []
        for i in range(n - 1):
            if (r := rank.get(joined := part[i : i + 2])) is not None:
                agenda.append((r, i, joined))
        heapq.heapify(agenda)
        while agenda:
            _, i, joined = heapq.heappop(agenda)
            left = symbols[i]
            if left is None or (j := after[i]) < 0 or len(left) + len(symbols[j]) != len(joined):
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = joined, None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank.get(pair := joined + symbols[k])) is not None:
                    heapq.heappush(agenda, (r, i, pair))
            if (h := before[i]) >= 0 and (r := rank.get(pair := symbols[h] + joined)) is not None:
                heapq.heappush(agenda, (r, h, pair))
        return [s for s in symbols if s is not None]

    def _ids(self, symbols: list[str]) -> list[int]:
        ids: list[int] = []
        for symbol in symbols:
            if (piece := self.pieces.get(symbol)) is not None:
                ids.append(piece)
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in symbol.encode()]
            else:
                ids.append(self.unknown)
        return ids

    def _cut(self, word: str) -> list[str]:
        pairs, at, out = self.pairs, 0, []
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in pairs:
                out.append(word[at:i])
                at = i
        out.append(word[at:])
        return out

    def _learn(self, words: set[str]) -> None:
        """Encodes words not in the memo, checks them against the library, remembers them."""
        unknown = self.memo.settle(words)
        if not unknown:
            return
        cuts = [self._cut(SPACE + w) for w in unknown]
        for part in self.parts.settle({p for c in cuts for p in c}):
            self.parts.young[part] = array.array("I", self.merge(part)).tobytes()
        known, young = self.parts.young, self.memo.young
        for word, c, theirs in zip(unknown, cuts, self.library.encode(unknown, num_threads=1), strict=True):
            own = b"".join([known[p] for p in c])
            if word and own != array.array("I", theirs).tobytes():
                raise ValueError(f"encoding differs from the library's for {word!r}")
            young[word] = own

    def words(self, text: str) -> list[str]:
        """The space-led parts of a text, each without its first space mark."""
        if not text:
            return []
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            return [w[1:] for w in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def pack(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, with begin and end ids, as unsigned 32-bit integers."""
        split = [self.words(t) for t in texts]
        self._learn({w for words in split for w in words})
        known = self.memo.young
        head, tail = (array.array("I", [i]).tobytes() for i in (self.begin, self.end))
        return [b"".join([head, *map(known.__getitem__, words), tail]) for words in split]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, with begin and end ids."""
        return [array.array("I", ids).tolist() for ids in self.pack(texts)]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of a list of ids: control ids vanish, bytes join, the leading space goes.

        A run of byte ids is read as UTF-8, each byte that is not valid there becoming U+FFFD.
        """
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            return self.library.decode(list(ids))
        return text[1:] if text[:1] == " " else text


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The model of this worker process; its memo outlives a task."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the array column ``ids``; a null text counts as empty."""
    if ids in docs.columns:
        raise ValueError(f"documents already have a column {ids}")
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for part in slices(batch, text):
                got = m.encode([t or "" for t in part.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.list_(pa.int32()))], names=[*part.schema.names, ids])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the string column ``text``, decoded from the array column ``ids`` (null: empty)."""
    if text in encoded.columns:
        raise ValueError(f"the rows already have a column {text}")
    schema = T.StructType([*encoded.schema.fields, T.StructField(text, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            got = pa.array([m.decode(i or []) for i in batch.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, text])

    return encoded.mapInArrow(run, schema)


def _swapped(ids: array.array) -> bytes:
    (other := array.array("I", ids)).byteswap()
    return other.tobytes()


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes each text in one pass: key, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for part in slices(batch, text):
                n, of_ids, of_text = [], [], []
                for raw in m.pack([t or "" for t in part.column(text).to_pylist()]):
                    n.append(len(ids := array.array("I", raw)))
                    of_ids.append(hashlib.sha256(raw if sys.byteorder == "little" else _swapped(ids)).hexdigest())
                    of_text.append(hashlib.sha256(m.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
