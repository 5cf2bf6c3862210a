"""Ids of a public tokenizer for many texts at once.

Each distinct unit of a batch is encoded once, and the ids are gathered for all its places in numpy. A unit is a run
between white space, parted where an ASCII letter meets ASCII punctuation other than an apostrophe. This holds for a
tokenizer that lower-cases and splits at just these places: a unit's ids then do not depend on its neighbours. Units are
told apart by 64-bit hashes."""

from __future__ import annotations

import os

import numpy as np

from skarn.llm import words

_KIND = np.full(256, 3, np.uint8)
_KIND[words.SPACE] = 0
_KIND[[b for b in range(128) if chr(b).isalpha()]] = 1
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = 2


def units(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the units of a byte array."""
    kind = np.zeros(len(buf) + 2, np.uint8)
    kind[1:-1] = _KIND[buf]
    a, b = kind[:-1], kind[1:]
    # 1 and 2 meet exactly where their sum is 3 and neither is 0.
    parted = ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))
    return np.flatnonzero((b != 0) & ((a == 0) | parted)), np.flatnonzero((a != 0) & ((b == 0) | parted))


class Subwords:
    """Texts as UTF-8 bytes to ids. Units met before are kept, at most `most` of them, in flat arrays."""

    def __init__(self, path: str | None = None, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        self.most = most
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        # Whether a word of ASCII letters goes to the model as it is, in lower case: normalizer and splitter leave it whole.
        letters = "abcdefghijklmnopqrstuvwxyz"
        normal, splitter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.plain = bool(normal and splitter) and normal.normalize_str(letters.upper()) == letters and [x for x, _ in splitter.pre_tokenize_str(letters)] == [letters]
        self._forget()

    def _forget(self) -> None:
        self.hash, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)
        # For most units: where its ids begin, and in the lower half how many they are.
        self.direct = words.Direct()

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encode_each(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all in a row, number of ids of each). Units of ASCII letters go to the tokenizer's model, other units of
        letters to the tokenizer in one string; its ids end a unit where the vocabulary says so."""
        text = [w.decode("utf-8", "replace") for w in new]
        size, rest, parts, placed = np.zeros(len(new), np.int32), np.ones(len(new), bool), [], []
        if self.plain:
            model, ids = self.tokenizer.model, []
            own = [i for i, t in enumerate(text) if t.isascii() and t.isalpha()]
            for i in own:
                found = model.tokenize(text[i].lower())
                size[i] = len(found)
                ids += [x.id for x in found]
            rest[own] = False
            parts, placed = [np.array(ids, np.uint32)], [np.array(own, np.int64)]
        # A letter whose lower case is more than a letter (a dotted capital I) ends a unit early.
        joined = [i for i in np.flatnonzero(rest).tolist() if text[i].isalpha() and text[i].lower().isalpha()]
        if joined:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(text[i] for i in joined)], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(joined):
                size[joined] = np.diff(np.concatenate([[0], cut]))
                rest[joined] = False
                parts.append(ids)
                placed.append(np.array(joined))
        if rest.any():
            left = np.flatnonzero(rest)
            found = [x.ids for x in self.tokenizer.encode_batch_fast([text[i] for i in left.tolist()], add_special_tokens=False)]
            size[left] = [len(x) for x in found]
            parts.append(np.array([i for x in found for i in x], np.uint32))
            placed.append(left)
        # Units stand by the way they went: put them back in order.
        order = np.concatenate(placed) if placed else np.zeros(0, np.int64)
        at = np.empty(len(new), np.int64)
        at[order] = np.cumsum(size[order]) - size[order]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return flat[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))], size

    def _learn(self, h: np.ndarray, new: list[bytes]) -> None:
        if len(self.hash) + len(new) > self.most:
            self._forget()
        flat, size = self._encode_each(new)
        start = (np.cumsum(size) - size + len(self.flat)).astype(np.int32)
        at = np.searchsorted(self.hash, h)
        self.hash, self.start, self.size = np.insert(self.hash, at, h), np.insert(self.start, at, start), np.insert(self.size, at, size)
        self.flat = np.concatenate([self.flat, flat])

    def _missing(self, distinct: np.ndarray) -> np.ndarray:
        if not len(self.hash):
            return np.ones(len(distinct), bool)
        at = np.minimum(np.searchsorted(self.hash, distinct), len(self.hash) - 1)
        return self.hash[at] != distinct

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        # A special token's string counts as written, so texts that may hold one are left to the tokenizer whole.
        whole = {i: self.encode(t.decode("utf-8", "replace")) for i, t in enumerate(texts) if b"<|" in t}
        parts, count, owner = [], np.zeros(len(texts), np.int64), []
        for buf, at, which in words.pieces([b"" if i in whole else t for i, t in enumerate(texts)]):
            low = words.LOWER[buf]
            starts, ends = units(low)
            parts.append((low, starts.astype(np.int32), ends.astype(np.int32), words.hashes(low, starts, ends)))
            first = np.append(np.searchsorted(starts, at), len(starts))
            owner.append(np.repeat(np.asarray(which, np.int32), np.diff(first)))
        if not parts:
            return np.zeros(0, np.uint32), count
        h = np.concatenate([p[3] for p in parts])
        number, met = self.direct.get(h)
        # Only units that are not met at their own place are sorted.
        order = np.flatnonzero(~met)
        order = order.take(np.argsort(h.take(order)))
        ranked = h[order]
        new = np.ones(len(order), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        distinct, chosen = ranked[new], order[new]
        del ranked
        lost = self._missing(distinct)
        if len(self.hash) + int(lost.sum()) > self.most:
            self._forget()
            if met.any():  # at a place that is forgotten now
                return self(texts)
            lost[:] = True
        if lost.any():
            begin = np.cumsum([0, *(len(p[1]) for p in parts)])
            want = chosen[lost]
            piece = np.searchsorted(begin, want, side="right") - 1
            text: list[bytes] = [b""] * len(want)
            for k, (low, starts, ends, _) in enumerate(parts):
                at = np.flatnonzero(piece == k)
                j, data = want[at] - begin[k], low.tobytes()
                for i, s, e in zip(at.tolist(), starts[j].tolist(), ends[j].tolist(), strict=True):
                    text[i] = data[s:e]
            self._learn(distinct[lost], text)
        del parts, h
        place = np.searchsorted(self.hash, distinct)
        both = self.start[place].astype(np.int64) << 32 | self.size[place]
        self.direct.put(distinct, both)
        number[order] = both[np.cumsum(new) - 1]
        del order, new, met
        n, start = (number & 0xFFFFFFFF).astype(np.int32), (number >> 32).astype(np.int32)
        count = np.bincount(np.concatenate(owner), weights=n, minlength=len(texts)).astype(np.int64)
        total = int(n.sum())
        out = self.flat[np.repeat(start - (np.cumsum(n) - n).astype(np.int32), n) + np.arange(total, dtype=np.int32)]
        if whole:
            cut = np.split(out, np.cumsum(count)[:-1])
            for i, x in whole.items():
                cut[i], count[i] = x, len(x)
            out = np.concatenate(cut)
        return out, count


_HELD: dict[tuple, Subwords] = {}


def subwords(path: str | None = None, most: int = 1_000_000) -> Subwords:
    """One for each Python worker."""
    if (path, most) not in _HELD:
        _HELD[path, most] = Subwords(path, most)
    return _HELD[path, most]
