"""Personal data: patterns propose spans, boosted trees choose among them.

Four fixed patterns with their checks give the base spans, which always stand. Wider generators propose further spans
(other number layouts, spelled-out addresses, IPv6); trees boosted on format and context features score them, and a
threshold for each kind, calibrated on examples that the trees have not seen, decides. A chosen span never overlaps a
base span or a better-scored one.

Positions are code points. Defined results: null text is an empty text and has no span; repeated rows come back once
for each row; null ids are carried; other columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm import words
from skarn.runtime import dealt, ship, table

KINDS = ("email", "ip", "card", "phone")

# The base patterns.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
#: The same matches in linear time: a leftmost match begins where a run of digits does, and takes whole runs.
_IP_RUNS = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check; (start, end, kind) in order of kind."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            out.append((start, free := m.end(), "email"))
        at = text.find("@", max(at + 1, free))
    if _ANY_DIGIT.search(text):
        for m in _IP_RUNS.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            d = _digits(m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((*m.span(), "card"))
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append((*m.span(), "phone"))
    return out


_ANY_DIGIT = re.compile(r"[0-9]")
_AT = r"(?:@|\(at\)|\[at\]|\{at\})"
_WIDE_EMAIL = re.compile(r"[^\s@<>,;:\"()\[\]{}]{1,64}\x20?" + _AT + r"\x20?[^\s@<>,;:\"()\[\]{}]{1,64}(?:\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?[A-Za-z0-9-]{2,24}){0,3}", re.I)
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20at\x20[A-Za-z0-9-]{1,64}(?:\x20dot\x20[A-Za-z0-9-]{2,24}){1,3}", re.I)
_IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")


#: Groups of digits whose proposals are described and scored at once.
BLOCK = 4096


class Numbers:
    """A text's runs of numbers, in arrays: proposals, and their features for many at once.

    A run is a stretch of digits and the signs that numbers have between them, from its first digit to its last. A
    proposal is a stretch of 7 to 42 characters of a run from the start of a group of digits to the end of one, so that a
    number next to others is proposed alone too."""

    def __init__(self, text: str):
        self.text = text
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n, self.c = len(c), np.concatenate([c, np.zeros(44, np.uint32)])
        self.digit = (self.c >= 48) & (self.c < 58)
        edge = np.diff(np.concatenate([[0], self.digit.view(np.int8)]))
        self.begin, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        inside = self.digit | _IN_RUN[np.minimum(self.c, 127)] & (self.c < 128)
        self.run = np.cumsum(~inside)[self.begin]
        self.place = None

    def proposals(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, kinds) that begin at the groups lo to hi."""
        out = []
        first = np.arange(lo, min(hi, len(self.begin)))
        size = np.concatenate([[0], np.cumsum(self.end - self.begin)])
        s = self.begin[first]
        lead = s - ((s > 0) & (self.c[s - 1] == 40))
        lead = lead - ((lead > 0) & (self.c[lead - 1] == 43))
        dot = np.concatenate([[0], np.cumsum(self.c == 46)])
        for k in range(22):
            own = np.flatnonzero(first + k < len(self.begin))
            if not len(own):
                break
            j = first[own] + k
            e, n = self.end[j], size[j + 1] - size[first[own]]
            fit = (self.run[j] == self.run[first[own]]) & (e - s[own] <= 42) & (n <= 19)
            # No longer stretch from the same group fits, either.
            first_left = own[fit]
            e, n, b = e[fit], n[fit], s[first_left]
            wide, dots = e - b >= 7, dot[e] - dot[b]
            for kind, ok, at in ((3, (n >= 7) & (n <= 15), lead[first_left]), (2, (n >= 13) & (n <= 19), b), (1, (dots == 3) & (n >= 4) & (n <= 12), b)):
                keep = wide & ok
                out.append(np.stack([at[keep], e[keep], np.full(int(keep.sum()), kind)]))
            if len(first_left) < len(first):
                first, s, lead = first[first_left], s[first_left], lead[first_left]
        return tuple(np.concatenate(out, 1)) if out else tuple(np.zeros((3, 0), np.int64))

    def _prepare(self) -> None:
        """Running counts over the text, made when the first proposal is described."""
        up = lambda x: np.concatenate([[0], np.cumsum(x)]).astype(np.int32)
        c = self.c
        self.count = {k: up(c == ord(k)) for k in "(-. /:"}
        self.digits = up(self.digit)
        value = (c[self.digit] - 48).astype(np.int64)
        twice, even = value * 2 - 9 * (value > 4), np.arange(len(value)) % 2 == 0
        self.value = value
        self.odd_last, self.even_last = up(np.where(even, twice, value)), up(np.where(even, value, twice))
        self.each = [up(value == d) for d in range(10)]
        letters, back = np.unique(c[: self.n], return_inverse=True)
        chars = [chr(x) if not 0xD800 <= x < 0xE000 else " " for x in letters.tolist()]
        flags = np.array([(x.isalpha(), x.lower()[-1].isalnum(), x.lower()[0].isalnum()) for x in chars], bool).reshape(-1, 3)[back]
        pad = np.zeros((44, 3), bool)
        alpha, self.alnum_last, self.alnum_first = np.concatenate([flags, pad]).T
        self.alpha = up(alpha)
        low = np.array([ord(x.lower()) if len(x.lower()) == 1 else 0 for x in chars], np.uint32)[back].tobytes().decode("utf-32-le", "replace") if self.n else ""
        # Where each cue begins.
        self.cues = [[(np.array([m.start() for m in re.finditer(re.escape(w), low)], np.int64), len(w)) for w in listed] for listed in (_GOOD, _BAD)]
        double = np.zeros(len(c), bool)
        signs = (c == 46) | (c == 58) | (c == 47) | (c == 45)
        double[:-1] = ((c[:-1] == 32) & (c[1:] == 32)) | (signs[:-1] & signs[1:])
        self.double = up(double)
        closing = (c == 46) | (c == 32) | (c == 93) | (c == 41) | (c == 125)
        self.closing = np.maximum.accumulate(np.where(closing, np.arange(len(c)), -1))
        # Runs of signs between groups, each with a number for its characters.
        sign = signs | (c == 32)
        edge = np.diff(np.concatenate([[0], sign.view(np.int8), [0]]))
        self.sign_begin, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # What stands in a proposal is at most 42 characters long; longer runs of signs differ from all of those.
        h = np.zeros(len(ends), np.uint64)
        for k in range(44):
            own = np.flatnonzero(self.sign_begin + k < ends)
            if not len(own):
                break
            h[own] = (h[own] + c[self.sign_begin[own] + k].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        self.sign_id = np.unique(h, return_inverse=True)[1]
        self.place = True

    def _ahead(self, at: np.ndarray, step: int) -> np.ndarray:
        """How close the next digit stands, from `at` on in steps of 1 or -1: see `_beside`."""
        sign = np.isin(self.c, [ord(x) for x in " ()./:+-"])
        gap = np.zeros(len(at), np.int64)
        open_ = np.ones(len(at), bool)
        for k in range(3):
            p = at + step * k
            open_ &= (p >= 0) & (p < self.n) & sign[np.clip(p, 0, None)]
            gap += open_
        p = at + step * gap
        there = (p >= 0) & (p < self.n) & self.digit[np.clip(p, 0, None)]
        one = np.where(self.c[np.clip(at, 0, None)] == 32, 2.0, 3.0)
        return np.where(there, np.where(gap == 0, 4.0, np.where(gap > 1, 1.0, one)), 0.0)

    def features(self, s: np.ndarray, e: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The rows that `describe` gives for these proposals."""
        if self.place is None:
            self._prepare()
        c, n = self.c, len(s)
        d0, d1 = self.digits[s], self.digits[e]
        count = {k: v[e] - v[s] for k, v in self.count.items()}
        g0 = np.searchsorted(self.begin, s)
        groups = np.searchsorted(self.begin, e) - g0
        wide = int(groups.max(initial=1))
        at = np.minimum(g0[:, None] + np.arange(wide), len(self.begin) - 1)
        there = np.arange(wide) < groups[:, None]
        size = (self.end - self.begin)[at]
        most, least = np.where(there, size, 0).max(1), np.where(there, size, 1 << 20).min(1)
        last = size[np.arange(n), groups - 1]
        total = np.where((d1 - d0 - 1 + d0) % 2 == 0, self.even_last[d1] - self.even_last[d0], self.odd_last[d1] - self.odd_last[d0])
        plain = (d1 - d0 + count["."] == e - s) & (count["."] == 3) & (groups == 4)
        quad = np.zeros(n, bool)
        for i in np.flatnonzero(plain & (most < 5)).tolist():
            quad[i] = all(int(x) < 256 for x in self.text[s[i] : e[i]].split("."))
        tail = e - np.maximum(self.closing[e - 1] + 1, s)
        before, after, after2 = c[s - 1] * (s > 0), c[e], c[e + 1]
        signs = lambda x, of: np.isin(x, [ord(k) for k in of])
        # At the end of a text the padding is neither letter nor digit.
        cues = []
        for own in self.cues:
            v = np.zeros(n, np.int64)
            for begin, length in own:
                i = np.searchsorted(begin, s - length, side="right")
                v += (i > 0) & (begin[np.maximum(i - 1, 0)] >= np.maximum(s - 32, 0)) if len(begin) else 0
            cues.append(v)
        value = np.append(self.value, [0, 0])
        v0, v1 = value[d0], np.where(d1 - d0 > 1, value[d0 + 1], -1)
        distinct = sum((x[d1] > x[d0]).astype(np.int64) for x in self.each)
        a = np.minimum(g0 + 1, len(self.begin) - 1)
        gap1 = self.begin[a] - self.end[g0]
        b = np.minimum(g0 + 2, len(self.begin) - 1)
        gap2 = self.begin[b] - self.end[a]
        dash = signs(c, "-/.")
        date = self.digit[s] & (groups >= 3) & (size[:, 0] <= 4) & (gap1 == 1) & dash[self.end[g0]] & (self.end[a] - self.begin[a] <= 2) & (gap2 == 1) & dash[self.end[a]]
        shape = (groups == 3) & (size[:, 0] == 3) & (size[:, min(1, wide - 1)] == 3) & (size[:, min(2, wide - 1)] == 4)
        r0 = np.searchsorted(self.sign_begin, s)
        runs = np.searchsorted(self.sign_begin, e) - r0
        many = int(runs.max(initial=0))
        kinds = np.zeros(n, np.int64)
        if many:
            ids = np.where(np.arange(many) < runs[:, None], self.sign_id[np.minimum(r0[:, None] + np.arange(many), len(self.sign_id) - 1)], -1)
            ids = np.sort(ids, 1)
            kinds = (ids[:, 0] >= 0) + ((ids[:, 1:] != ids[:, :-1]) & (ids[:, 1:] >= 0)).sum(1)
        none = np.zeros(n)
        return np.stack([
            *(kind == k for k in range(4)),
            e - s, d1 - d0, groups, most, size[:, 0], last,
            total % 10 == 0, c[s] == 43, count["("] > 0, count["-"], count["."], count[" "], count["/"], count[":"],
            quad, self.alpha[e] - self.alpha[s], tail, none, none,
            none, none,
            (s > 0) & self.alnum_last[s - 1], (s > 0) & signs(before, "#-_/=.,$€£"),
            self.alnum_first[e], signs(after, "-_/%.") & self.alnum_first[e + 1], after == 37,
            cues[0], cues[1],
            (v0 >= 3) & (v0 <= 6), distinct <= 2, ((v0 == 1) & (v1 == 9)) | ((v0 == 2) & (v1 == 0)),
            date, self.double[np.maximum(e - 1, s)] > self.double[s], shape,
            self._ahead(s - 1, -1), self._ahead(e, 1), least, most == least, kinds,
        ], 1).astype(np.float64)


_IN_RUN = np.zeros(128, bool)
_IN_RUN[[ord(c) for c in " ()./:-"]] = True


def others(text: str) -> list[Span]:
    """Overlapping proposals that are no plain runs of numbers: addresses in other spellings, and IPv6."""
    out: list[Span] = []
    if "::" in text or text.count(":") >= 3:
        out += [(*m.span(), "ip") for m in _IPV6.finditer(text) if m.end() - m.start() >= 5]
    low = text.lower() if ("(" in text or "[" in text or "{" in text) else ""
    if "@" in text or "(at)" in low or "[at]" in low or "{at}" in low:
        out += [(*m.span(), "email") for m in _WIDE_EMAIL.finditer(text)]
    if " dot " in text or " DOT " in text or " Dot " in text:
        out += [(*m.span(), "email") for m in _SPELLED.finditer(text)]
    return out


def candidates(text: str) -> list[Span]:
    """Overlapping proposals of all kinds, high in recall; a number is proposed as each kind that it may be."""
    out: list[Span] = []
    if _ANY_DIGIT.search(text):
        numbers = Numbers(text)
        s, e, k = numbers.proposals(0, len(numbers.begin))
        order = np.lexsort((-k, e, np.searchsorted(numbers.begin, s)))
        out = [(a, b, KINDS[c]) for a, b, c in zip(s[order].tolist(), e[order].tolist(), k[order].tolist(), strict=True)]
    return out + others(text)


_GOOD = ("tel", "phone", "call", "fax", "mobile", "cell", "contact", "mail", "write", "reach", "ip", "host", "server", "address", "login", "card", "visa", "credit", "debit", "paid", "account")
_BAD = ("order", "isbn", "no.", "id", "version", "ver", "build", "page", "date", "time", "ref", "invoice", "serial", "sku", "token", "password", "hash", "section", "chapter", "ratio", "score", "$", "€", "£")


def _beside(near: str) -> float:
    """How close the next digit stands, past signs that numbers have between them: 0 for none, 1 behind two or more, 2
    behind white space, 3 behind another sign, 4 at once."""
    m = re.match(r"[\x20()./:+-]{0,3}(?=[0-9])", near)
    if not m:
        return 0.0
    return 4.0 if not m.group() else 1.0 if len(m.group()) > 1 else 2.0 if m.group() == " " else 3.0


def describe(text: str, span: Span) -> list[float]:
    """Format and context features of a proposal."""
    start, end, kind = span
    s = text[start:end]
    d = _digits(s)
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    before, after = text[max(0, start - 32) : start].lower(), text[end : end + 12].lower()
    quad = s.split(".")
    tail = re.split(r"[.\x20\])}]+", s.rstrip("."))[-1]
    return [
        *(float(kind == k) for k in KINDS),
        len(s), len(d), len(groups), max(groups, default=0), groups[0] if groups else 0, groups[-1] if groups else 0,
        float(luhn(d)) if d else 0.0, float(s.startswith("+")), float("(" in s), s.count("-"), s.count("."), s.count(" "), s.count("/"), s.count(":"),
        float(len(quad) == 4 and all(q.isdigit() and len(q) < 5 and int(q) < 256 for q in quad)),
        sum(c.isalpha() for c in s), len(tail), float(tail.isalpha()), float(tail in ("com", "org", "net", "edu", "io", "de", "fr", "es", "uk", "info")),
        float("dot" in s.lower()), float("@" in s),
        float(before[-1:].isalnum()), float(before[-1:] in ("#", "-", "_", "/", "=", ".", ",", "$", "€", "£")),
        float(after[:1].isalnum()), float(after[:1] in ("-", "_", "/", "%", ".") and after[1:2].isalnum()), float(after[:1] == "%"),
        sum(w in before for w in _GOOD), sum(w in before for w in _BAD),
        float(d[:1] in "3456") if d else 0.0, float(len(set(d)) <= 2), float(d[:2] in ("19", "20")),
        float(bool(re.fullmatch(r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}.*", s))), float(bool(re.search(r"\x20{2}|[.:/-]{2}", s))), float(sorted(groups) == [3, 3, 4] and groups[-1] == 4),
        _beside(before[::-1]), _beside(after), float(min(groups, default=0)), float(len(set(groups)) == 1), float(len(set(re.findall(r"[^0-9+()]+", s)))),
    ]


def examples(n: int, seed: int) -> list[tuple[str, Span, int]]:
    """Made-up sentences with a personal datum or a look-alike, its proposal and whether it is personal data."""
    g = np.random.default_rng(seed)

    def pick(*x):
        return x[int(g.integers(len(x)))]

    def num(k: int) -> str:
        return "".join(str(int(x)) for x in g.integers(0, 10, k))

    def word() -> str:
        return "".join(pick(*"abcdefghiklmnoprstuvw") for _ in range(int(g.integers(2, 9))))

    def with_luhn(k: int) -> str:
        d = pick("4", "5", "37", "6", num(1)) + num(k)
        d = d[: k - 1]
        return next(d + str(c) for c in range(10) if luhn(d + str(c)))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+{num(2)} {num(2)} {num(4)} {num(4)}", f"0{num(2)}/{num(7)}", f"0{num(3)} {num(3)} {num(3)}", f"1-{a}-{b}-{c}", f"+1 ({a}) {b}-{c}")

    def made(kind: str, good: int) -> str:
        if kind == "phone":
            return phone() if good else pick(f"20{num(2)}-0{num(1)}-{num(2)} {num(2)}:{num(2)}", f"{num(2)}/{num(2)}/20{num(2)}", num(8), f"{num(3)}.{num(3)}.{num(3)}", f"{num(2)}:{num(2)}:{num(2)}", f"{num(1)}.{num(2)}.{num(3)}.{num(4)}", f"{num(4)} {num(4)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{num(6)}-{num(8)}")
        if kind == "card":
            c = with_luhn(16)
            if good:
                return pick(c, " ".join(c[i : i + 4] for i in range(0, 16, 4)), "-".join(c[i : i + 4] for i in range(0, 16, 4)), ".".join(c[i : i + 4] for i in range(0, 16, 4)), with_luhn(13))
            w = c[:-1] + str((int(c[-1]) + int(g.integers(1, 10))) % 10)
            return pick(w, f"{w[:4]} {w[4:8]} {w[8:12]} {w[12:]}", f"978{num(10)}", f"20{num(12)}", f"{num(8)}.{num(6)}")
        if kind == "ip":
            q = [str(int(x)) for x in g.integers(0, 256, 4)]
            six = ":".join(f"{int(x):x}" for x in g.integers(0, 65536, 8))
            return pick(".".join(q), six, six[:14].rstrip(":") + "::" + six[-4:].lstrip(":")) if good else pick(f"{num(1)}.{num(1)}.{num(1)}.{num(4)}", f"{num(3)}.{int(g.integers(300, 999))}.{num(2)}.{num(3)}", f"{num(2)}:{num(2)}:{num(2)}", f"0{num(1)}:{num(2)}:{num(2)}:{num(2)}")
        user, host, tld = f"{word()}{pick('.', '_', '')}{pick(num(2), word())}", word(), pick("com", "org", "net", "de", "io")
        if good:
            return pick(f"{user}@{host}.{tld}", f"{user} at {host} dot {tld}", f"{user}(at){host}.{tld}", f"{user} [at] {host} [dot] {tld}", f"{user}@{host}.co.{tld}")
        return pick(f"{user}@{host}", f"@{user}@{host}", f"{user}@{num(3)}", f"{word()} at {word()} dot {word()}")

    cue = {"phone": ("call ", "tel: ", "phone ", "fax ", "my number is ", "mobile "), "card": ("card ", "visa ", "paid with ", "credit card: "), "ip": ("host ", "server ", "ip ", "from "), "email": ("mail ", "write to ", "contact ", "reach me: ")}
    out = []
    while len(out) < n:
        kind, good = KINDS[int(g.integers(4))], int(g.integers(2))
        s = made(kind, good)
        lead = pick(pick(*cue[kind]), "", f"{word()} ") if good else pick("order ", "isbn ", "version ", "ref ", "id ", "page ", "date ", "", f"{word()} ", "#", "$")
        beside = made(pick("phone", "card", "ip"), int(g.integers(2))) if g.random() < 0.35 else ""
        left, right = (f"{beside}{pick(' ', '  ', ' / ', ' - ')}", "") if beside and g.random() < 0.5 else ("", f"{pick(' ', '  ', ' / ', ' - ')}{beside}" if beside else "")
        text = f"{word()} {word()} {lead}{left}"
        at = len(text)
        text += f"{s}{right}{pick('', ' ', '. ', ', ')}{pick('', word())}"
        all_ = candidates(text)
        found = [c for c in all_ if c[2] == kind and text[c[0] : c[1]].strip() == s and c[0] >= at - 1] or [c for c in all_ if kind == "email" and c[2] == kind and s in text[c[0] : c[1] + 1]]
        if found:
            out.append((text, found[0], good))
            if kind != "email":
                # What cuts the number, runs past it or takes it for another kind is no personal data of its own.
                wrong = [c for c in all_ if c[0] < at + len(s) and c[1] > at and c[:2] != found[0][:2] and (c[0] < at or c[1] > at + len(s) or good)]
                for _ in range(min(2, len(wrong))):
                    out.append((text, wrong[int(g.integers(len(wrong)))], 0))
    return out[:n]


@dataclass(frozen=True)
class Trees:
    """Boosted trees of fixed depth: feature, cut and leaf values by tree, and a threshold by kind."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float
    threshold: dict

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        depth = int(np.log2(self.leaf.shape[1]))
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            total += v[node - (len(c))]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.2, least: float = 4.0) -> Trees:
    """Second-order boosting of the logistic loss; cuts come from up to 32 quantiles of each feature."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    total, inner = np.full(len(y), start), 2**depth - 1
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for k in range(inner):
            own = np.flatnonzero(node == k)
            gain = 0.0
            if len(own):
                gs, hs = g[own].sum(), h[own].sum()
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gl = np.cumsum(np.bincount(binned[own, j], g[own], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[own, j], h[own], len(c) + 1))[:-1]
                    new = gl**2 / (hl + least) + (gs - gl) ** 2 / (hs - hl + least) - gs**2 / (hs + least)
                    i = int(np.argmax(new))
                    if new[i] > gain + 1e-12:
                        gain, feature[t, k], cut[t, k] = new[i], j, c[i]
            node[own] = 2 * k + 1 + (x[own, feature[t, k]] > cut[t, k])
        for k in range(inner + 1):
            own = node == inner + k
            leaf[t, k] = -rate * g[own].sum() / (h[own].sum() + least)
        total += leaf[t][node - inner]
    return Trees(feature, cut, leaf, start, {})


@lru_cache(1)
def model(learn: int = 6000, calibrate: int = 4000, precision: float = 0.97) -> Trees:
    """The trees, and for each kind the lowest score from which at least `precision` of unseen examples are right."""
    seen, other = examples(learn, 1), examples(calibrate, 2)
    trees = boost(np.array([describe(t, s) for t, s, _ in seen]), np.array([y for *_, y in seen], float))
    score, kind, y = trees.score(np.array([describe(t, s) for t, s, _ in other])), np.array([s[2] for _, s, _ in other]), np.array([y for *_, y in other])
    threshold = {}
    for k in KINDS:
        own = np.argsort(-score[kind == k], kind="stable")
        s, right = score[kind == k][own], np.cumsum(y[kind == k][own]) / np.arange(1, len(own) + 1)
        good = np.flatnonzero(right >= precision)
        threshold[k] = max(0.5, float(s[good[-1]])) if len(good) else 1.1
    return Trees(trees.feature, trees.cut, trees.leaf, trees.start, threshold)


class Taken:
    """Disjoint intervals, held in order."""

    def __init__(self, spans: list[Span] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e, _ in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(e, self.ends[-1])
            else:
                self.starts.append(s)
                self.ends.append(e)

    def free(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return not i or self.ends[i - 1] <= start

    def clear(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which of many intervals are free."""
        if not self.starts:
            return np.ones(len(starts), bool)
        i = np.searchsorted(np.array(self.starts), ends)
        return (i == 0) | (np.array(self.ends)[np.maximum(i - 1, 0)] <= starts)

    def take(self, start: int, end: int) -> None:
        i = bisect_left(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def _scored(x: np.ndarray, trees: Trees) -> np.ndarray:
    """Scores, made once for rows that are alike (told apart by a 64-bit hash)."""
    h = (x.view(np.uint64) * _WEIGHT[: x.shape[1]]).sum(1)
    h ^= h >> np.uint64(29)
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    return trees.score(x[first])[back]


_WEIGHT = np.random.default_rng(11).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def find(text: str, trees: Trees) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans), each by start, then kind.

    Proposals are described and scored in blocks; those that reach their threshold are kept, as numbers."""
    base, added = base_spans(text), []
    taken = Taken(base)
    floor = np.array([trees.threshold[k] for k in KINDS])
    held = []
    if _ANY_DIGIT.search(text):
        numbers = Numbers(text)
        for lo in range(0, len(numbers.begin), BLOCK):
            s, e, k = numbers.proposals(lo, lo + BLOCK)
            free = taken.clear(s, e)
            s, e, k = s[free], e[free], k[free]
            if len(s):
                score = _scored(numbers.features(s, e, k), trees)
                good = score >= floor[k]
                held.append((s[good], e[good], k[good], score[good], np.searchsorted(numbers.begin, s[good])))
    place = {k: i for i, k in enumerate(KINDS)}
    more = [c for c in others(text) if taken.free(c[0], c[1])]
    for lo in range(0, len(more), BLOCK):
        own = more[lo : lo + BLOCK]
        score, k = trees.score(np.array([describe(text, c) for c in own])), np.array([place[c[2]] for c in own])
        good = score >= floor[k]
        held.append((np.array([c[0] for c in own])[good], np.array([c[1] for c in own])[good], k[good], score[good], len(text) + lo + np.flatnonzero(good)))
    if held:
        s, e, k, score, order = (np.concatenate(x) for x in zip(*held, strict=True))
        # Best first; of equal ones the first in the text, the shorter, then by kind.
        for i in np.lexsort((-k, e, order, -score)).tolist():
            if taken.free(int(s[i]), int(e[i])):
                taken.take(int(s[i]), int(e[i]))
                added.append((int(s[i]), int(e[i]), KINDS[k[i]]))
    return tuple(sorted(x, key=lambda s: (s[0], place[s[2]], s[1])) for x in (base, added))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by the first one's kind in angle brackets."""
    out, at = [], 0
    for s, e, k in sorted(spans):
        if s >= at:
            out += [text[at:s], f"<{k.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def with_spans(docs: DataFrame, name: str = "pii") -> DataFrame:
    """All columns of docs plus a struct: base and added spans as strings, base counts, and the redacted text."""
    import pyarrow as pa

    ship(docs.sparkSession)
    trees = model()
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names).withColumn("_t", F.col(names[docs.columns.index("text")]).cast("string"))
    kind = "struct<base:string,spans:string,email:bigint,ip:bigint,card:bigint,phone:bigint,redacted:string>"
    schema = plain.drop("_t").withColumn("pii", F.lit(None).cast(kind)).schema
    shape = pa.struct([("base", pa.string()), ("spans", pa.string()), *((k, pa.int64()) for k in KINDS), ("redacted", pa.large_string())])

    def run(it):
        place = {k: i for i, k in enumerate(KINDS)}

        def said(spans):
            return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], place[x[2]], x[1])))

        for whole in it:
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                out = []
                for text in batch.columns[-1].to_pylist():
                    base, added = find(text or "", trees)
                    n = [sum(k == x[2] for x in base) for k in KINDS]
                    # Only a changed text is carried, so that clean ones do not travel twice.
                    out.append({"base": said(base), "spans": said(base + added), **dict(zip(KINDS, n, strict=True)), "redacted": redacted(text, base + added) if base or added else None})
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, shape).cast(_small(shape))], names=[*names, "pii"])
        words.trim()

    return plain.mapInArrow(run, schema).toDF(*docs.columns, name)


def _small(shape):
    import pyarrow as pa

    return pa.struct([(f.name, pa.string() if pa.types.is_large_string(f.type) else f.type) for f in shape])


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """Base counts and digest, and all spans, for every whole text of `documents`."""
    found = with_spans(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", *(F.col(f"pii.{k}").alias(f"n_{k}") for k in KINDS), F.sha2(F.col("pii.base").cast("binary"), 256).alias("base_sha256"), F.col("pii.spans").alias("spans"))
