"""Two-stage suffix sorting of a bounded text with numpy, ordered as deep as repeats are long.

First stage: only suffixes smaller than their successors are sorted directly, by their first 56 bytes. Second stage:
scanning buckets of first bytes from the least to the greatest, each suffix puts its predecessor, where that is greater,
at the next place in front of the predecessor's bucket. Suffixes that agree in 56 bytes come in any order.
"""

from __future__ import annotations

import numpy as np

DEPTH = 56
PARTER = 0xFF  # never part of UTF-8


def heads(t: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first 56 bytes of suffixes, one row for each; past the end come zeros."""
    padded = np.concatenate([t, np.zeros(DEPTH, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, DEPTH)[at]


def greater_than_next(t: np.ndarray) -> np.ndarray:
    """Which suffixes are greater than their successors; the end is smaller than all."""
    n = len(t)
    out = np.ones(n, bool)
    if n > 1:
        places = np.arange(n - 1)
        change = np.where(t[1:] != t[:-1], places, n)
        following = np.minimum.accumulate(change[::-1])[::-1]
        some = following < n
        out[:-1][some] = t[following[some]] > t[following[some] + 1]
    return out


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffixes of a byte array, ordered by their first 56 bytes at least."""
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    induced = greater_than_next(t)
    direct = np.flatnonzero(~induced)
    words = heads(t, direct).view(">u8").astype(np.uint64)
    direct = direct[np.lexsort([words[:, k] for k in range(words.shape[1] - 1, -1, -1)])]
    edges = np.searchsorted(t[direct], np.arange(257))
    fronts: list[list[np.ndarray]] = [[] for _ in range(256)]
    fronts[t[n - 1]].append(np.array([n - 1]))
    out = []
    for c in np.flatnonzero(np.bincount(t, minlength=256)):
        whole = [np.concatenate(fronts[c])] if fronts[c] else []
        wave = whole[0] if whole else np.zeros(0, np.int64)
        while len(wave):  # runs of one byte lead back into the same bucket
            before = wave[wave > 0] - 1
            wave = before[induced[before] & (t[before] == c)]
            whole.append(wave)
        whole.append(direct[edges[c] : edges[c + 1]])
        bucket = np.concatenate(whole)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before] & (t[before] > c)]
        before = before[np.argsort(t[before], kind="stable")]
        chars, first = np.unique(t[before], return_index=True)
        for char, part in zip(chars, np.split(before, first[1:]), strict=False):
            fronts[char].append(part)
    return np.concatenate(out)


def common_prefixes(t: np.ndarray, order: np.ndarray, slice_rows: int = 1 << 16) -> np.ndarray:
    """Length of the common prefix of each suffix in the order and the one before, at most 56; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    for at in range(1, len(order), slice_rows):
        rows = heads(t, order[at - 1 : at + slice_rows])
        unlike = rows[1:] != rows[:-1]
        out[at : at + len(unlike)] = np.where(unlike.any(axis=1), unlike.argmax(axis=1), DEPTH)
    return out


def least_owners(contexts: list[bytes], owners: np.ndarray, length: int) -> list[np.ndarray]:
    """For each window of ``length`` (up to 56) bytes in each context, the least owner of a context that has it."""
    t = np.frombuffer(b"".join(c + bytes([PARTER]) for c in contexts), np.uint8)
    sizes = np.array([len(c) + 1 for c in contexts])
    ends = np.cumsum(sizes)
    context = np.repeat(np.arange(len(contexts)), sizes)
    order = suffix_array(t)
    order = order[order + length < ends[context[order]]]
    alike = common_prefixes(t, order) >= length
    first = np.flatnonzero(~alike)
    least = np.minimum.reduceat(owners[context[order]], first)
    found = np.zeros(len(t), np.int64)
    found[order] = least[np.cumsum(~alike) - 1]
    return [found[e - s : e - length] for s, e in zip(sizes, ends, strict=True)]
