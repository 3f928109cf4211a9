"""Token ids in Arrow files of equal-length sequences, for zero-copy random access.

Each file is an Arrow IPC file whose record batches hold fixed-size lists: ``tokens`` (uint16
where the vocabulary fits, else uint32) and ``mask`` (bit-packed booleans, false for padding
after a file's last id), each of ``sequence`` entries.  Sequence k of a file is found by
arithmetic, and a memory map reads it without a copy.  A second Arrow file beside it holds the
file's documents: key, first position, number of tokens.  Files are numbered in ascending key
order (nulls first; equal keys by a hash of the text), so the ids of all documents run through them in that
order.

Defined results: ids are the library's without special tokens put around a text; an added token
written out in a text is that token's id; a null or empty text holds the end id alone; an empty table writes no file
and reads back as no rows; repeated rows stay, in order; keys may be of any type that has an order.
What a task writes is deterministic, under names of that attempt; the manifest names the files of
the attempts that counted and is written last, so files that it does not name are no result.
"""

from __future__ import annotations

import array
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlake.llm._batches import TwoGenerationCache, bounded_batches, shared_dir, slices

#: Tokens in a sequence, sequences in a record batch, entries in a generation of the memo.
SEQUENCE, BATCH, MEMO = 2048, 64, 1_000_000


class ByteBpe:
    """A tokenizers-library encoder that remembers what single words encode to.

    A single space that a visible character follows always begins a pre-token of the byte-level
    pattern, so texts are cut there; unknown parts are cut by that pattern and encoded by the
    library's model.  A tokenizer file that has a normalizer, or cuts texts otherwise, is left
    to the library altogether.
    """

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder()
        #: Added tokens are matched before all else; the longest of those at a place counts.
        self.added = {t.content: array.array("I", [i]).tobytes() for i, t in added.items()}
        self.find_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        #: Tokens that take spaces, mind word ends or go through the normalizer are left to the library.
        self.plain_added = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        self.size = self.library.get_vocab_size()
        lib, cuts, model = self.library, self.library.pre_tokenizer, self.library.model
        self.byte_level = lib.normalizer is None and lib.truncation is None and lib.padding is None and type(cuts).__name__ == "ByteLevel" and not cuts.add_prefix_space and cuts.use_regex
        self.byte_level = self.byte_level and type(model).__name__ == "BPE" and not model.dropout and not model.end_of_word_suffix and not model.continuing_subword_prefix
        self.memo, self.parts = TwoGenerationCache(memo), TwoGenerationCache(memo // 4)
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in plain]
        #: Byte-level vocabularies write a byte as a letter: itself if it prints, else one from 256 on.
        self.letters = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}
        self.odd_space = re.compile(r" (?=\s|$)")

    def words(self, text: str) -> list[str]:
        """Parts of the text; all but the first stand for themselves with a space before."""
        words = text.split(" ")
        if not self.odd_space.search(text):
            return words
        out = [words[0]]
        for w in words[1:]:
            if not w or w[0].isspace() or not w[0].isprintable():
                out[-1] += " " + w  # the space belongs to a run of white space
            else:
                out.append(w)
        return out

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        """Ids of each text and the end id, as little-endian unsigned 32-bit integers."""
        tail = array.array("I", [end]).tobytes()
        if not self.byte_level:
            return [array.array("I", e.ids).tobytes() + tail for e in self.library.encode_batch(texts, add_special_tokens=False)]
        holding = [i for i, t in enumerate(texts) if self.find_added.search(t)]
        if not holding:
            return [ids + tail for ids in self._plain(texts)]
        if not self.plain_added:
            own = {i: array.array("I", self.library.encode(texts[i], add_special_tokens=False).ids).tobytes() for i in holding}
            rest = iter(self._plain([t for i, t in enumerate(texts) if i not in own]))
            return [(own[i] if i in own else next(rest)) + tail for i in range(len(texts))]
        # Each piece between added tokens is cut into pre-tokens on its own.
        pieces = {i: self.find_added.split(texts[i]) for i in holding}
        marks = {i: self.find_added.findall(texts[i]) for i in holding}
        flat = iter(self._plain([x for i, t in enumerate(texts) for x in pieces.get(i, (t,))]))
        out = []
        for i in range(len(texts)):
            parts = [next(flat)]
            for mark in marks.get(i, ()):
                parts += [self.added[mark], next(flat)]
            out.append(b"".join([*parts, tail]))
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without added tokens."""
        split = [self.words(t) for t in texts]
        heads = [PRETOKEN.findall(words[0]) for words in split]
        self._learn_parts({p for parts in heads for p in parts})
        parts = self.parts.young
        first = [b"".join(map(parts.__getitem__, own)) for own in heads]
        self._learn(set().union(*split))  # with the heads: a few words more
        known = self.memo.young
        return [b"".join([h, *map(known.__getitem__, words[1:])]) for h, words in zip(first, split, strict=True)]

    def _ids(self, parts: list[str]) -> list[bytes]:
        """Ids of single pre-tokens, by the tokenizer's model on their bytes' letters."""
        tokenize, letters = self.library.model.tokenize, self.letters
        return [array.array("I", [t.id for t in tokenize(p.encode().decode("latin-1").translate(letters))]).tobytes() for p in parts]

    def _learn_parts(self, parts: set[str]) -> None:
        new = self.parts.settle(parts)
        self.parts.young.update(zip(new, self._ids(new), strict=True))

    def _learn(self, words: set[str]) -> None:
        unknown = self.memo.settle(words)
        if not unknown:
            return
        # A word of letters alone is one pre-token with its space; others are cut, and their
        # pre-tokens of that kind are remembered as words too.
        whole = [w for w in unknown if w.isalpha()]
        find, odd = PRETOKEN.findall, [w for w in unknown if not w.isalpha()]
        cuts = [find(" " + w) for w in odd]
        inner = {p[1:] for c in cuts for p in c if p[0] == " " and p[1:].isalpha()}
        inner.difference_update(whole)
        new = whole + [w for w in inner if w not in self.memo.young and self.memo.recall(w) is None]
        young = self.memo.young
        young.update(zip(new, self._ids([" " + w for w in new]), strict=True))
        self._learn_parts({p for c in cuts for p in c if p[0] != " " or not p[1:].isalpha()})
        parts = self.parts.young
        for w, c in zip(odd, cuts, strict=True):
            young[w] = b"".join([young[p[1:]] if p[0] == " " and p[1:].isalpha() else parts[p] for p in c])


#: Fixed value: the pattern that byte-level vocabularies of this kind cut texts with.
PRETOKEN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class _Lazy:
    """Compiles the pattern at first use, in the worker."""

    def findall(self, text: str) -> list[str]:
        import regex

        self.findall = regex.compile(PRETOKEN_PATTERN).findall
        return self.findall(text)


PRETOKEN = _Lazy()
_ENCODERS: dict[tuple[str, int], ByteBpe] = {}


def encoder(path: str, memo: int = MEMO) -> ByteBpe:
    """The encoder of this worker process; its memo outlives a task."""
    if (path, memo) not in _ENCODERS:
        _ENCODERS[path, memo] = ByteBpe(path, memo)
    return _ENCODERS[path, memo]


def forget(path: str, memo: int = MEMO) -> None:
    """Drops an encoder of this worker process with its memo."""
    _ENCODERS.pop((path, memo), None)


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class SequenceWriter:
    """Cuts a run of ids into sequences and writes them, batch by batch."""

    def __init__(self, sink, kind: np.dtype, sequence: int, batch: int):
        self.kind, self.sequence, self.room = kind, sequence, sequence * batch
        item = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("tokens", pa.list_(item, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.n_held += len(ids)
        self.total += len(ids)
        if self.n_held >= self.room:
            run = np.concatenate(self.held)
            full = len(run) // self.room * self.room
            for at in range(0, full, self.room):
                self._write(run[at : at + self.room], self.room)
            self.held, self.n_held = [run[full:]], len(run) - full

    def _write(self, run: np.ndarray, used: int) -> None:
        lists = lambda values: pa.FixedSizeListArray.from_arrays(values, self.sequence)
        mask = np.arange(len(run)) < used
        self.out.write_batch(pa.RecordBatch.from_arrays([lists(pa.array(run)), lists(pa.array(mask))], schema=self.schema))

    def close(self) -> None:
        run = np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        if len(run):
            self._write(np.pad(run, (0, -len(run) % self.sequence)), len(run))
        self.out.close()


def write(docs: DataFrame, path: str, folder: str, *, end: int, key: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, batch: int = BATCH) -> DataFrame:
    """Tokenises and writes all documents; returns the manifest: part, uri, n_docs, n_tokens.

    The manifest is made by the run that writes, so it has been materialised already; it is also
    written to ``folder``/manifest.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("tie"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order, "tie").sortWithinPartitions(*order, "text").drop("tie")  # equal rows part, too

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        kind = np.dtype("<u2" if max(bpe.size, end + 1) <= 1 << 16 else "<u4")
        part = TaskContext.get().partitionId()
        fs, root = _fs(folder)
        out, keys, counts = None, [], []
        for b in batches:
            for s in slices(b, "text"):
                if out is None and s.num_rows:
                    fs.create_dir(root, recursive=True)
                    own = f"part-{part:06d}-{uuid.uuid4().hex}"  # of this attempt
                    sink = fs.open_output_stream(f"{root}/{own}.tokens")
                    out = SequenceWriter(sink, kind, sequence, batch)
                for ids in bpe.encode(s.column("text").to_pylist(), end):
                    ids = np.frombuffer(ids, "<u4")
                    counts.append(len(ids))
                    out.add(ids)
                keys.append(s.column("key"))
        if out is None:
            return
        out.close()
        sink.close()
        n = np.array(counts, np.int64)
        index = pa.table([pa.chunked_array(keys), pa.array(np.cumsum(n) - n), pa.array(n)], names=["key", "start", "n_tokens"])
        with fs.open_output_stream(f"{root}/{own}.index") as f, pa.ipc.new_file(f, index.schema) as w:
            w.write_table(index)
        yield pa.RecordBatch.from_pydict({"part": [part], "uri": [f"{folder}/{own}"], "n_docs": [len(n)], "n_tokens": [int(n.sum())]}, schema=MANIFEST)

    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    schema = "part int, uri string, n_docs long, n_tokens long"
    # One row for each file: bounded by the number of partitions.
    manifest = spark.createDataFrame(sorted(ordered.mapInArrow(run, schema).collect()), schema)
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    return manifest


MANIFEST = pa.schema([("part", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


class TokenFile:
    """Random access to one file: ``sequence(k)`` and ``ids(start, n)`` are views where they can be."""

    def __init__(self, uri: str):
        fs, path = _fs(uri)
        local = type(fs).__name__ == "LocalFileSystem"
        self.source = pa.memory_map(f"{path}.tokens") if local else fs.open_input_file(f"{path}.tokens")
        self.reader = pa.ipc.open_file(self.source)
        self.size = self.reader.schema.field("tokens").type.list_size
        self.per_batch = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0
        with fs.open_input_file(f"{path}.index") as f:
            self.index = pa.ipc.open_file(f).read_all()
        self._held: tuple[int, np.ndarray] = (-1, np.zeros(0))

    def _batch(self, k: int) -> np.ndarray:
        if self._held[0] != k:
            self._held = (k, self.reader.get_batch(k).column("tokens").flatten().to_numpy(zero_copy_only=True))
        return self._held[1]

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and mask of the file's k-th sequence."""
        b = self.reader.get_batch(k // self.per_batch)
        at = (k % self.per_batch) * self.size
        mask = b.column("mask").flatten().slice(at, self.size).to_numpy(zero_copy_only=False)
        return self._batch(k // self.per_batch)[at : at + self.size], mask

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from a position of the file; a view unless they span record batches."""
        room, out = self.per_batch * self.size, []
        while n > 0:
            k, at = divmod(start, room)
            part = self._batch(k)[at : at + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out)


def read(manifest: DataFrame, key: str = "doc_id", kind: str = "long") -> DataFrame:
    """Reads files back, a task for each: key (of type ``kind``), start, n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    files = sorted(manifest.select("part", "uri", "n_tokens").collect())  # one row a file
    starts = [0, *accumulate(r.n_tokens for r in files)][: len(files)]
    schema = f"`{key}` {kind}, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    todo = spark.sparkContext.parallelize([(r.uri, s) for r, s in zip(files, starts, strict=True)], len(files)).toDF("uri string, start long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = TokenFile(uri)
                for part in f.index.to_batches(4096):
                    start, n = (part.column(c).to_numpy() for c in (1, 2))
                    crc = [zlib.crc32(f.ids(int(s), int(k)).astype("<u4").tobytes()) for s, k in zip(start, n, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(start + base), part.column(2), pa.array(crc, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    return todo.mapInArrow(run, schema)


def fresh_folder(spark) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
