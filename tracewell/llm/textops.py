"""Small helpers that run inside Spark tasks: words, word hashes, shingle hashes.

A word is a run of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``);
``bytes.split()`` cuts at exactly those six bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_U = np.uint64
#: A slice of a batch holds about so many bytes of text, so that a task's memory does not follow the batch size.
SLICE_BYTES = 4_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], dtype=_U)


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """The words of a text (none for null); ``lower`` maps A-Z to a-z and nothing else."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


_TERM = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters of a UTF-8 text, A-Z in lower case; none for null."""
    return (text or b"").lower().translate(_TERM).split()


@dataclass
class Words:
    """All words of several texts: hashes in order, text i owning words ``bounds[i]:bounds[i + 1]``."""

    raw: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    def owners(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def room(self) -> np.ndarray:
        """For each word the number of words from it to the end of its text, itself included."""
        return np.repeat(self.bounds[1:], np.diff(self.bounds)) - np.arange(len(self.hashes))

    def of(self, i: int) -> list[bytes]:
        return [self.raw[s:e] for s, e in zip(self.starts[self.bounds[i] : self.bounds[i + 1]].tolist(), self.ends[self.bounds[i] : self.bounds[i + 1]].tolist())]


def word_spans(raw: bytes, more: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    space = _SPACE[np.frombuffer(raw, np.uint8)]
    for b in more:
        space |= np.frombuffer(raw, np.uint8) == b
    space = np.concatenate([[True], space, [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


def hash_spans(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span, eight bytes at a time."""
    padded = np.frombuffer(raw + bytes(8), np.uint8)
    eights = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    size = ends - starts
    out = mix((eights[starts] & _MASK[np.minimum(size, 8)]) + size.astype(_U) * _MULT[2][0])
    at, left = np.flatnonzero(size > 8), 8
    while len(at):
        part = eights[starts[at] + left] & _MASK[np.minimum(size[at] - left, 8)]
        out[at] = mix((out[at] ^ part) * _MULT[2][1] + _U(left))
        left += 8
        at = at[size[at] > left]
    return out


def tokenize(texts: list[str | None], lower: bool = False) -> Words:
    """The words of many texts at once; null and blank texts own none."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = b"\n".join(parts)
    raw = raw.lower() if lower else raw
    starts, ends = word_spans(raw)
    text_starts = np.cumsum(np.r_[0, np.array([len(p) + 1 for p in parts], np.int64)])
    return Words(raw, starts, ends, hash_spans(raw, starts, ends), np.searchsorted(starts, text_starts))


def distinct_words(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct word, and for each word the number of its distinct word; compared by their bytes."""
    order = np.argsort(found.hashes, kind="stable")
    h = found.hashes[order]
    new = np.r_[True, h[1:] != h[:-1]][: len(h)]
    first = order[np.flatnonzero(new)]
    of = np.empty(len(h), np.int64)
    of[order] = np.cumsum(new) - 1
    size = found.ends - found.starts
    padded = np.frombuffer(found.raw + bytes(8), np.uint8)
    eights = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    same = size == size[first][of]
    at, left = np.flatnonzero(same), 0
    while len(at):
        mask = _MASK[np.minimum(size[at] - left, 8)]
        same[at] = (eights[found.starts[at] + left] ^ eights[found.starts[first[of[at]]] + left]) & mask == 0
        left += 8
        at = at[same[at] & (size[at] > left)]
    odd = np.flatnonzero(~same)
    if len(odd):  # equal hashes of different words
        names: dict[bytes, int] = {}
        more = [names.setdefault(found.raw[s:e], len(names)) for s, e in zip(found.starts[odd].tolist(), found.ends[odd].tolist())]
        of[odd] = len(first) + np.array(more)
        first = np.r_[first, odd[np.unique(more, return_index=True)[1]]]
    return first, of


def text_slices(texts: list[str | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    return iter(slices(np.array([len(t or "") for t in texts]), limit))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.int64).astype(_U) * _U(2) + _U(1)


_MULT = {seed: _odd(64, seed) for seed in (1, 2)}


def gram_hashes(h: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of each run of k consecutive words: entry i stands for words i..i+k-1."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, _U)
    out = np.zeros(n, _U)
    for j in range(k):
        out += h[j : j + n] * _MULT[seed][j]
    return mix(out)


def shingle_sets(texts: list[str | None], k: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles; with fewer words the whole sequence is one."""
    found = tokenize(texts, lower=True)
    grams, out = gram_hashes(found.hashes, k), []
    for s, e in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist()):
        n = min(k, e - s)
        out.append(np.empty(0, _U) if not n else np.unique(grams[s : e - k + 1] if n == k else gram_hashes(found.hashes[s:e], n) + _U(n)))
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def slices(sizes: np.ndarray, limit: int = SLICE_BYTES) -> list[tuple[int, int]]:
    """Cut rows 0..n into runs of about ``limit`` bytes; one longer row is a run of its own."""
    out, start, ends = [], 0, np.cumsum(sizes, dtype=np.int64)
    while start < len(ends):
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        out.append((start, end))
        start = end
    return out


def minhash(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """len(a) minima of the shingle hashes under a[i] * x + b[i], as the top 32 bits."""
    best = np.full(len(a), np.iinfo(np.uint64).max, _U)
    for at in range(0, len(shingles), 512):
        block = shingles[at : at + 512, None] * a[None, :]
        block += b[None, :]
        np.minimum(best, block.min(axis=0), out=best)
    return (best >> _U(32)).astype(np.uint32)


def minhash_family(k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    return _odd(k, seed), _odd(k, seed + 1)
