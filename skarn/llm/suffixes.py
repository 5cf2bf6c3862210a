"""Suffix arrays by two-stage sorting, in numpy."""

from __future__ import annotations

import numpy as np

from skarn.llm import words

_STEP = 40


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the suffix that follows them; the last one is not (the empty one is smaller)."""
    n = len(text)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    edge = np.flatnonzero(text[1:] != text[:-1]) + 1
    # A run of equal bytes has the type that its last byte has against the byte after the run.
    begin, end = np.concatenate([[0], edge]), np.concatenate([edge, [n]])
    up = np.zeros(len(begin), bool)
    up[:-1] = text[begin[:-1]] < text[begin[1:]]
    return np.repeat(up, end - begin)


def sort_directly(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes that start at `at`, in order of their first `depth` bytes (zeros stand after the end).

    Sorted by 40 bytes at a time; only suffixes that still tie go on."""
    padded = np.concatenate([text, np.zeros(depth + _STEP, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, _STEP)
    order = at.copy()
    tied, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    for done in range(0, depth, _STEP):
        if not len(tied):
            break
        key = np.empty((len(tied), _STEP + 4), np.uint8)
        key[:, :4] = group.astype(">u4").view(np.uint8).reshape(-1, 4)
        key[:, 4:] = view[order[tied] + done]
        flat = key.reshape(-1).view(f"V{_STEP + 4}").view(f"S{_STEP + 4}")
        by = np.argsort(flat, kind="stable")
        order[tied] = order[tied][by]
        flat = flat[by]
        new = np.ones(len(tied), bool)
        new[1:] = flat[1:] != flat[:-1]
        group = np.cumsum(new)
        again = ~new
        again[:-1] |= ~new[1:]
        tied, group = tied[again], group[again]
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of a byte array, in order of at least their first `depth` bytes.

    First stage: the suffixes that are smaller than their successors are sorted directly. Second stage: buckets of equal
    first bytes are scanned in order; each suffix found there puts the one before it, if that is larger than its
    successor, at the next place of its bucket. All entries of a bucket are taken at once, since they only ever reach
    larger buckets; those of a run of equal bytes stay in their bucket and are taken in rounds."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    first = np.flatnonzero(smaller_than_next(text))
    first = sort_directly(text, first, depth)
    cut = np.searchsorted(text[first], np.arange(257)) if len(first) else np.zeros(257, np.int64)
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        found = []
        front = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        waiting[c] = []
        while len(front):
            found.append(front)
            back = front[front > 0] - 1
            front = back[text[back] == c]
        found.append(first[cut[c] : cut[c + 1]])
        bucket = np.concatenate(found)
        if not len(bucket):
            continue
        out.append(bucket)
        back = bucket[bucket > 0] - 1
        back = back[text[back] > c]
        if len(back):
            kind = text[back]
            by = np.argsort(kind, kind="stable")
            back, kind = back[by], kind[by]
            edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
            for part, k in zip(np.split(back, edge), kind[np.concatenate([[0], edge])].tolist(), strict=True):
                waiting[k].append(part)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each suffix of the order but the first, whether it shares `most` bytes with the one before it (both have as
    many): first by 64-bit hashes of these bytes, then byte for byte where the hashes agree."""
    up, down = words._powers(len(text) + 1)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(words._VALUE[text] * up[:-1], out=total[1:])
    h = (total[order + most] - total[order]) * down[order]
    same = h[1:] == h[:-1]
    view = np.lib.stride_tricks.sliding_window_view(text, most) if len(text) >= most else None
    at = np.flatnonzero(same)
    for lo in range(0, len(at), 4096):
        i = at[lo : lo + 4096]
        same[i] = (view[order[i]] == view[order[i + 1]]).all(1)
    return same
