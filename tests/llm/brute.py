"""Plain restatements of the operators, for small tables."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np


class Sets:
    """Disjoint sets; the least member names a set."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b) -> None:
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def grams(text: str | None, k: int = 5) -> Counter:
    words = (text or "").lower().split()
    return Counter(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else Counter()


def overlap(a: Counter, b: Counter) -> float:
    least = sum((a & b).values())
    return least / max(1, sum(a.values()) + sum(b.values()) - least)


def near_classes(docs: dict[int, str | None], threshold: float = 0.8) -> dict[int, int]:
    """class_id by id: all pairs that share a shingle are compared."""
    own, holders, sets = {d: grams(t) for d, t in docs.items()}, defaultdict(list), Sets()
    for d, c in own.items():
        for g in c:
            holders[g].append(d)
    for a, b in {p for v in holders.values() for p in combinations(v, 2)}:
        if overlap(own[a], own[b]) >= threshold - 1e-9:
            sets.join(a, b)
    return {d: sets.find(d) for d in docs}


def normal_line(line: str) -> str:
    return " ".join(re.findall(r"[^\s!-/:-@\[-`{-~]+", line.lower(), flags=re.A))


def distance(a: str, b: str) -> int:
    """Edit distance by bits: a bit for each character of a, a step for each of b."""
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every, last, up, down, found = (1 << len(a)) - 1, 1 << (len(a) - 1), (1 << len(a)) - 1, 0, len(a)
    for c in b:
        same = at.get(c, 0)
        across = (((same & up) + up) ^ up) | same | down
        more, less = down | (~(across | up) & every), up & across
        found += bool(more & last) - bool(less & last)
        more = more << 1 | 1
        up, down = ((less << 1) | ~(across | more)) & every, more & across & every
    return found


def letter_pairs(norm: str) -> np.ndarray:
    """Counts of letters, and of pairs of neighbours, by hash."""
    out = np.zeros(512, "i4")
    for c in norm:
        out[ord(c) % 64] += 1
    for a, b in zip(norm, norm[1:]):
        out[64 + (ord(a) * 31 + ord(b)) % 448] += 1
    return out


def line_classes(norms: list[str], threshold: float = 0.9) -> Sets:
    """Lines by number, all pairs compared by edit distance alone.

    An edit changes two letters and four pairs of neighbours at most, so counts that differ more rule a pair out.
    """
    sets, counts = Sets(), np.array([letter_pairs(n) for n in norms]).reshape(len(norms), 512)
    sizes = np.array([len(n) for n in norms])
    for i, a in enumerate(norms):
        most = np.floor((1 - threshold) * np.maximum(sizes[:i], len(a)) + 1e-9)
        maybe = np.flatnonzero(np.abs(sizes[:i] - len(a)) <= most)
        differ = np.abs(counts[maybe] - counts[i])
        maybe = maybe[(differ[:, :64].sum(axis=1) <= 2 * most[maybe]) & (differ[:, 64:].sum(axis=1) <= 4 * most[maybe])]
        for j in maybe.tolist():
            if sets.find(i) != sets.find(j) and distance(a, norms[j]) <= most[j]:
                sets.join(i, j)
    return sets


def line_dedup(docs: list[tuple[int, str | None]], threshold: float = 0.9) -> dict[int, str | None]:
    """Text by id: of connected lines, those after the first go."""
    number, where = {}, []
    for d, t in sorted(docs):
        for n, line in enumerate((t or "").split("\n")):
            if norm := normal_line(line):
                where.append((d, n, number.setdefault(norm, len(number))))
    sets, seen, gone = line_classes(list(number), threshold), set(), defaultdict(set)
    for d, n, i in where:
        if sets.find(i) in seen:
            gone[d].add(n)
        seen.add(sets.find(i))
    return {d: t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d]) for d, t in docs}


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns of secrets, sign by sign."""
    small, found, i = "0123456789abcdef", [], 0
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")

    def run(at: int, signs) -> int:
        while at < len(text) and text[at] in signs:
            at += 1
        return at

    def assigned(at: int) -> int | None:
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if text[at : at + len(name)].translate({c: c + 32 for c in range(65, 91)}) != name:
                continue
            p = at + len(name)
            p = run(p + (text[p : p + 1] in ("'", '"') and p < len(text)), " ")
            if text[p : p + 1] not in (":", "="):
                continue
            p = run(p + 1, " ")
            p += text[p : p + 1] in ("'", '"') and p < len(text)
            end = run(p, value)
            if end > p:
                return (end if end - p >= 6 else -end)
        return None

    while i < len(text):
        end = assigned(i)
        if end and end > 0:
            found.append(("assign", i, end))
        i = abs(end) if end else i + 1
    i = 0
    while (i := text.find("AKIA", i)) >= 0:
        end = run(i + 4, set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
        if end - i >= 20:
            found.append(("access", i, end))
        i = max(end, i + 4) if end > i + 4 else i + 1
    i = 0
    while i < len(text):
        end = run(i, small)
        if end - i >= 24:
            found.append(("hex", i, end))
        i = end + 1
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def log_ratio(text: str, samples: list[tuple[str, str]], alphabet: int, smoothing: float = 0.5) -> float:
    """How much likelier text is to the best model of random strings than to that of ordinary ones, in nats."""
    pairs: dict = defaultdict(Counter)
    for sample, label in samples:
        pairs[label].update(zip("^" + sample, sample))
    logs = {}
    for label, own in pairs.items():
        firsts = Counter()
        for (a, _), n in own.items():
            firsts[a] += n
        logs[label] = sum(math.log((own[a, b] + smoothing) / (firsts[a] + smoothing * alphabet)) for a, b in zip("^" + text, text))
    return max(v for k, v in logs.items() if k != "ordinary") - logs["ordinary"]
