"""Words of many texts at once, in numpy.

Texts are UTF-8 bytes; words are `[^\\x20\\x09-\\x0D]+`. A word's hash takes its bytes eight at a time, each time through
a bijective mix, so words of equal length up to eight bytes never collide; words over 64 bytes take XXH64. It depends on
the word's bytes alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.default_rng(20240917)
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
#: Bytes taken at once; a longer text is cut at white space.
PIECE = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for hashes of substrings from running sums."""
    if len(_POWERS["up"]) < n:
        for k, b in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads each bit over all 64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: ASCII that is neither letter nor digit: between the words where punctuation must not matter.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def split(buf: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array: the runs of bytes that are not `between`."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~between[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One unsigned 64-bit hash for each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    import xxhash

    # Eight bytes from each place on; zeros stand after the end.
    eight = np.ndarray((len(buf) + 1,), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))
    size = ends - starts
    h = mix(size.astype(np.uint64) * np.uint64(_BASE) + np.uint64(1))
    own = slice(None)
    at, left = starts, size
    for _ in range(8):
        h[own] = mix(h[own] ^ ((eight[at] & _KEEP[np.minimum(left, 8)]) * np.uint64(_BASE)))
        more = left > 8
        own = np.flatnonzero(more) if isinstance(own, slice) else own[more]
        if not len(own):
            return h
        at, left = at[more] + 8, left[more] - 8
    for i in own.tolist():
        h[i] = xxhash.xxh64_intdigest(buf[starts[i] : ends[i]].tobytes(), 7)
    return h


def pieces(texts: list[bytes], size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """Byte arrays of at most about `size`, with where each text starts in them and which texts these are.

    A text longer than that comes in several arrays, cut at white space (a longer word stays whole)."""
    held, which, n = [], [], 0

    def joined():
        at = np.zeros(len(held), np.int64)
        np.cumsum([len(x) + 1 for x in held[:-1]], out=at[1:])
        return np.frombuffer(b"\n".join(held) + b"\n", np.uint8), at, list(which)

    for i, text in enumerate(texts):
        pos = 0
        while len(text) - pos > size:
            cut = pos + size
            while cut < len(text) and not SPACE[text[cut]]:
                cut += 1
            part, pos = text[pos:cut], cut
            if held:
                yield joined()
            held, which, n = [part], [i], len(part)
            yield joined()
            held, which, n = [], [], 0
        part = text[pos:] if pos else text
        if held and n + len(part) > size:
            yield joined()
            held, which, n = [], [], 0
        held.append(part)
        which.append(i)
        n += len(part) + 1
    if held:
        yield joined()


def hashed_texts(texts: list[bytes], lower: bool = True, between: np.ndarray = SPACE) -> list[np.ndarray]:
    """For each text the hashes of its words, in order."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for buf, at, which in pieces(texts):
        if lower:
            buf = LOWER[buf]
        starts, ends = split(buf, between)
        h = hashes(buf, starts, ends)
        first = np.append(np.searchsorted(starts, at), len(starts))
        for k, i in enumerate(which):
            out[i].append(h[first[k] : first[k + 1]])
    return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out]


class Direct:
    """Numbers of 64-bit hashes, each at the place that its first bits name: one look instead of a search. Of hashes that
    share a place the last one is kept, so a hash that is not found may still have been put."""

    def __init__(self, bits: int = 20):
        self.bits = np.uint64(64 - bits)
        # No hash at its own place: the first bits differ.
        self.key = ~(np.arange(1 << bits, dtype=np.uint64) << self.bits)
        self.number = np.zeros(1 << bits, np.int64)

    def put(self, h: np.ndarray, number: np.ndarray) -> None:
        at = (h >> self.bits).astype(np.intp)
        self.number[at] = number
        self.key[at] = h

    def get(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, whether each was found); a number that was not found means nothing."""
        at = (h >> self.bits).astype(np.intp)
        return self.number.take(at), self.key.take(at) == h


def trim() -> None:
    """Gives freed memory back to the system: a worker that runs one operator after another else keeps the most that each of
    them has used."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def batches(it, column: str = "text", most: int = 4 << 20):
    """Arrow batches as (batch, list of bytes), cut so that the texts of one are about `most` bytes; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in it:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(text), 0), np.int64)) // most
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a), [x or b"" for x in text.slice(a, b - a).to_pylist()]
    trim()
