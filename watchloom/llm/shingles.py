"""Word shingles of whole texts as sets of 64-bit hashes, computed for many texts at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
CHUNK_BYTES = 1 << 20


_STEP = np.arange(1, 1000, dtype=np.uint64) * _P


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out) if n else out


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``limit`` bytes (a longer text alone), so that work space stays bounded."""
    start, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(b) > limit:
            yield start, held
            start, held, size = i, [], 0
        held.append(b)
        size += len(b) + 1
    if held:
        yield start, held


def word_hashes(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, A-Z lower-cased, one after another; number of words of each text."""
    raw = _LOWER[np.frombuffer(b" ".join(held) + b" ", dtype=np.uint8)]
    ends = np.cumsum([len(b) + 1 for b in held])
    gap = _GAP[raw]
    word = ~gap
    first = np.flatnonzero(word & np.concatenate(([True], gap[:-1])))
    last = np.flatnonzero(gap & np.concatenate(([False], word[:-1])))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_P, len(raw)))))
    h = mix((sums[last] - sums[first]) * _powers(_INV, len(raw))[first] + (last - first).astype(np.uint64))
    per = np.diff(np.concatenate(([0], np.searchsorted(first, ends))))
    return h, per


def shingle_sets(texts: list[str | None], width: int = 5) -> Iterator[list[np.ndarray]]:
    """For each run of texts, one sorted array of distinct shingle hashes per text.

    A text with fewer words than width has its whole word sequence as its one shingle; without words, none.
    """
    for _, held in chunks(texts):
        h, per = word_hashes(held)
        n = len(h)
        whole = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            whole[: max(n - k, 0)] += mix(h[k:] + _STEP[k : k + 1])
        whole = mix(whole)
        out, at = [], 0
        for m in per:
            if m >= width:
                out.append(np.unique(whole[at : at + m - width + 1]))
            elif m:
                out.append(mix(mix(h[at : at + m] + _STEP[100 : 100 + m]).sum(keepdims=True)))
            else:
                out.append(np.empty(0, dtype=np.uint64))
            at += m
        yield out
