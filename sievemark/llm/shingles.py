"""Hashed sets of 5-word shingles of whole texts, in numpy over many texts at once.

A-Z are lower-cased; words are runs of characters other than ASCII white space. A text of fewer words
has its whole sequence as one shingle; a text of none has an empty set. Long texts are hashed in pieces
of ``PIECE`` bytes that overlap by four words, so memory goes with a piece (and the longest word).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

WORDS, PIECE = 5, 1 << 21
_SPACE, _WORD = re.compile(rb"[\x20\x09-\x0D]"), re.compile(rb"[^\x20\x09-\x0D]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.random.default_rng(5).integers(1, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    values = np.random.default_rng(17).integers(1, 1 << 63, 256, np.uint64)
    for b in range(65, 91):
        values[b] = values[b + 32]
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return values, space


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def _pieces(raw: bytes, most: int) -> Iterator[bytes]:
    """Parts of a text, cut between words, each with the first four words of what follows."""
    at = 0
    while at < len(raw):
        cut = _SPACE.search(raw, at + most)
        if cut is None:
            yield raw[at:]
            return
        end = cut.start()
        for _ in range(WORDS - 1):
            if (word := _WORD.search(raw, end)) is None:
                break
            end = word.end()
        yield raw[at:end]
        at = cut.start()


def shingle_sets(texts: list[str], piece: int = PIECE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    out = [s for s, _ in _sets([r if len(r) <= piece else b"" for r in raw])]
    for n, r in enumerate(raw):
        if len(r) > piece:
            parts: list[np.ndarray] = []
            for part in _pieces(r, piece):
                own, words = _sets([part])[0]
                if words >= WORDS or not parts:
                    parts.append(own)
            out[n] = np.unique(np.concatenate(parts))
    return out


def _sets(raw: list[bytes]) -> list[tuple[np.ndarray, int]]:
    """(sorted distinct shingle hashes, number of words) of each text."""
    values, space = _tables()
    data = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
    blank = space[data]
    up, down = _power_tables(len(data) + 1)
    starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _BASE)
    edges = np.cumsum([1, *(len(r) + 1 for r in raw)])
    first = np.searchsorted(starts, edges)
    whole = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        whole += words[k : len(words) - WORDS + 1 + k] * _STEPS[k] if len(words) >= WORDS else whole
    whole = mix(whole)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WORDS:
            own = np.unique(whole[a : b - WORDS + 1])
        elif b > a:
            few = words[a:b]
            own = mix(np.array([(few * _STEPS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
        else:
            own = np.zeros(0, np.uint64)
        out.append((own, b - a))
    return out


def set_key(own: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    a = mix(mix(own).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))
    b = mix(mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64, keepdims=True))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])
