"""Plain-Python versions of the operators, for comparison on small tables."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None, lower: bool = True) -> list[str]:
    text = text or ""
    return WORD.findall(text.translate(_AZ) if lower else text)


def shingles(text: str | None, width: int) -> set[tuple[str, ...]]:
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


class Union(dict):
    def root(self, a):
        while self.setdefault(a, a) != a:
            a = self[a]
        return a

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        if a != b:
            self[max(a, b)] = min(a, b)


def similar_pairs(sets: list[set], num: int, den: int) -> list[tuple[int, int]]:
    """All pairs of non-empty sets with den * common >= num * union."""
    by = defaultdict(list)
    for i, s in enumerate(sets):
        for t in s:
            by[t].append(i)
    out, counts = [], None
    for i, s in enumerate(sets):
        counts = defaultdict(int)
        for t in s:
            for j in by[t]:
                if j < i:
                    counts[j] += 1
        out += [(j, i) for j, c in counts.items() if den * c >= num * (len(s) + len(sets[j]) - c)]
    return out


def jaccard_components(rows: list[tuple[int, str | None]], width: int = 4, num: int = 85, den: int = 100) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id); ids are distinct."""
    sets = [shingles(t, width) for _, t in rows]
    u = Union()
    for i, j in similar_pairs(sets, num, den):
        u.join(rows[i][0], rows[j][0])
    return {d: (len(s), u.root(d)) for (d, _), s in zip(rows, sets, strict=True)}


def dedup_lines(rows: list[tuple[int | None, str | None]], num: int = 80, den: int = 100) -> dict[int | None, str | None]:
    """doc_id -> text left; ids are distinct, null comes first.

    From the definition: lines are taken by document, then number; a line goes
    if an earlier one has an equal or a similar set of words."""
    per: dict[int | None, list[str]] = {}
    seen: list[frozenset[str]] = []
    holders = defaultdict(list)
    gone: set[tuple[int | None, int]] = set()
    known: set[frozenset[str]] = set()
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        per[d] = list(dict.fromkeys(x for x in (t or "").split("\n") if words(x)))
        for no, x in enumerate(per[d]):
            s = frozenset(words(x, lower=False))
            common = defaultdict(int)
            for w in s:
                for k in holders[w]:
                    common[k] += 1
            if s in known or any(den * c >= num * (len(s) + len(seen[k]) - c) for k, c in common.items()):
                gone.add((d, no))
            if s not in known:
                known.add(s)
                for w in s:
                    holders[w].append(len(seen))
                seen.append(s)
    out = {}
    for d, t in rows:
        kept = [x for no, x in enumerate(per[d]) if (d, no) not in gone]
        same = t is None or (len(kept) == len(per[d]) == sum(bool(words(x)) for x in t.split("\n")))
        out[d] = t if same else "\n".join(kept)
    return out


def _discounts(counts: Counter, most: int = 5) -> dict[int, float]:
    n = Counter(counts.values())
    a = (most + 1) * n[most + 1] / n[1] if n[1] else 0.0
    out = {}
    for r in range(1, most + 1):
        x = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if n[r] and a < 1 else -1.0
        out[r] = x if 0 < x < 1 else (r - 0.5) / r
    return out


def katz(tokens: dict[int, list[str]], train: list[int]) -> dict[int, float]:
    """log10 probability of each document under a Katz bigram model."""
    uni, bi = Counter(), Counter()
    for k in train:
        uni.update(tokens[k])
        bi.update(zip(["<s>", *tokens[k]], tokens[k], strict=False))
    n, d1, d2 = sum(uni.values()), _discounts(uni), _discounts(bi)
    lost = sum(c * (1 - d1.get(c, 1)) for c in uni.values()) / n
    scale, unknown = (1.0, lost) if lost > 0 else (n / (n + 1), 1 / (n + 1))

    def p1(w):
        return uni[w] * d1.get(uni[w], 1) * scale / n if uni[w] else unknown

    after = defaultdict(dict)
    for (h, w), c in bi.items():
        after[h][w] = c
    back = {}
    for h, s in after.items():
        total, left = sum(s.values()), sum(c * (1 - d2.get(c, 1)) for c in s.values())
        if left <= 0:
            total, left = total + 1, 1.0
        back[h] = total, left / total / max(1 - sum(map(p1, s)), 1e-12)

    def p(h, w):
        if h not in after:
            return p1(w)
        total, alpha = back[h]
        c = after[h].get(w)
        return c * d2.get(c, 1) / total if c else alpha * p1(w)

    return {k: sum(math.log10(p(h, w)) for h, w in zip(["<s>", *t], t, strict=False)) for k, t in tokens.items()}
