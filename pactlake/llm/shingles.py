"""Sets of hashed word shingles of many texts at once, in numpy over the texts' bytes.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased.  A word's hash is
taken from prefix sums of a polynomial over hashed bytes, a shingle's from its words' hashes, all
modulo 2**64 and mixed; the chance that two different shingles meet is about 2**-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Words of a shingle; a text of fewer words is one shingle.
WORDS = 5
#: Bytes of a longer text that are hashed at a time.
PIECE = 1 << 20
_M = (1 << 64) - 1
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_BYTE = np.array([int.from_bytes(hashlib.sha256(f"byte/{b + 32 * (65 <= b <= 90)}".encode()).digest()[:8], "little") for b in range(256)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), remembered at the longest length asked for."""
    if base not in _powers or len(_powers[base]) < n:
        room = max(n, 1 << 20)
        steps = np.full(room, base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spans(raw: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; edge: where texts begin and end."""
    ink = ~_SPACE[raw]
    after_gap = np.concatenate([[True], ~ink[:-1]])
    before_gap = np.concatenate([~ink[1:], [True]])
    return np.flatnonzero(ink & (after_gap | edge[:-1])), np.flatnonzero(ink & (before_gap | edge[1:])) + 1


def _polynomials(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * _power(_P, len(raw)), dtype=np.uint64)])
    return (sums[ends] - sums[starts]) * _power(_P_INVERSE, len(raw))[starts]


def _runs(words: np.ndarray) -> np.ndarray:
    """The hash of each run of five words."""
    n = len(words) - WORDS + 1
    run = words[:n].copy()
    for k in range(1, WORDS):
        run += words[k : n + k] * np.uint64(pow(_Q, k, 1 << 64))
    return mix(run)


def _distinct(own: np.ndarray) -> np.ndarray:
    own = np.sort(own)
    return own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def _short(words: np.ndarray) -> np.ndarray:
    """The one shingle of fewer than five words."""
    whole = sum(int(w) * pow(_Q, j + 1, 1 << 64) for j, w in enumerate(words)) + len(words)
    return mix(np.array([whole & _M], np.uint64))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text of the concatenated bytes its distinct shingle hashes, rising."""
    n = len(offsets) - 1
    none = np.zeros(0, np.uint64)
    if not len(raw):
        return [none] * n
    if n == 1 and len(raw) > PIECE:
        return [_long_set(raw)]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts, ends = _spans(raw, edge)
    words = mix(_polynomials(raw, starts, ends) + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, offsets)  # each text's first word
    count = np.diff(first)
    if len(words) >= WORDS:
        run = _runs(words)
    out = []
    for at, k in zip(first.tolist(), count.tolist(), strict=False):
        if k >= WORDS:
            out.append(_distinct(run[at : at + k - WORDS + 1]))
        elif k:
            out.append(_short(words[at : at + k]))
        else:
            out.append(none)
    return out


def _long_words(raw: np.ndarray, piece: int) -> Iterator[np.ndarray]:
    """Word hashes of one text, piece by piece; a word that a piece cuts is carried on."""
    carried, length = 0, 0  # the open word's polynomial and bytes
    for at in range(0, len(raw), piece):
        part = raw[at : at + piece]
        edge = np.zeros(len(part) + 1, bool)
        starts, ends = _spans(part, edge)
        sums, sizes = _polynomials(part, starts, ends), ends - starts
        if length:
            if len(starts) and starts[0] == 0:
                sums[0] = (carried + int(sums[0]) * pow(_P, length, 1 << 64)) & _M
                sizes[0] += length
            else:
                sums, sizes = np.concatenate([np.array([carried], np.uint64), sums]), np.concatenate([[length], sizes])
        carried, length = 0, 0
        if not _SPACE[part[-1]]:
            carried, length = int(sums[-1]), int(sizes[-1])
            sums, sizes = sums[:-1], sizes[:-1]
        yield mix(sums + sizes.astype(np.uint64))
    if length:
        yield mix(np.array([carried + length & _M], np.uint64))


def _long_set(raw: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """The distinct shingle hashes of one text, at most a piece of which is expanded at a time."""
    tail, held, known = np.zeros(0, np.uint64), [], 0
    for words in _long_words(raw, piece):
        tail = np.concatenate([tail, words])
        if len(tail) >= WORDS:
            held.append(_distinct(_runs(tail)))
            tail = tail[1 - WORDS :]
        if sum(map(len, held[1:])) > max(known, 1 << 20):
            held = [_distinct(np.concatenate(held))]
            known = len(held[0])
    return _distinct(np.concatenate(held)) if held else _short(tail) if len(tail) else tail


def signature(own: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    total = (int(mix(own + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)) + len(own) * 0x9E3779B97F4A7C15) & _M
    return total - (1 << 64) if total >> 63 else total
