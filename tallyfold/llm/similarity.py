"""Similarity of names and strings, JVM-side where it is used before a shuffle."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms of companies.
LEGAL_FORMS = ("oy", "oyj", "ab", "as", "gmbh", "bv", "sarl", "ltd", "ag", "sa", "inc", "llc", "plc", "aps", "kg", "nv", "srl", "spa")


def name_bigrams(name: Column) -> Column:
    """Set of the letter pairs in each word of a name, without what follows a comma and legal forms; null for a blank name."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.split_part(name, F.lit(","), F.lit(1))), r"[^\p{L}\p{N}]+", " "), rf"\b({'|'.join(LEGAL_FORMS)})$", ""))
    words = F.filter(F.split(plain, " "), lambda w: F.length(w) > 0)
    pairs = F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(2))))))
    return F.when(F.length(plain) > 0, pairs)


def overlap(a: Column, b: Column) -> Column:
    """Share of the smaller set of bigrams that the other has too; null if either is null."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))


@lru_cache(maxsize=200_000)
def bigrams(text: str) -> frozenset[str]:
    return frozenset(w[i : i + 2] for w in text.split() for i in range(max(1, len(w) - 1)))


@lru_cache(maxsize=500_000)
def dice(a: str, b: str) -> float:
    """Dice coefficient of the letter pairs of two texts of words; 0 if either has none."""
    x, y = bigrams(a), bigrams(b)
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


@lru_cache(maxsize=200_000)
def split_name(name: str) -> tuple[str, str]:
    """(words, legal form) of a company's name."""
    words = re.sub(r"[\W_]+", " ", name.partition(",")[0].lower()).split()
    form = words.pop() if len(words) > 1 and words[-1] in LEGAL_FORMS else ""
    return " ".join(words), form


@lru_cache(maxsize=500_000)
def name_similarity(a: str, b: str) -> float:
    """0 to 1; words in any order, cut short or mistyped; a different legal form takes a tenth off."""
    (x, f), (y, g) = split_name(a), split_name(b)
    p, q = bigrams(x), bigrams(y)
    if not p or not q:
        return 0.0
    sim = 0.5 * len(p & q) / min(len(p), len(q)) + len(p & q) / (len(p) + len(q))
    return max(0.0, sim - (0.1 if f and g and f != g else 0.03 if f != g else 0.0))


#: Costs of single edits; figures that look alike or are struck twice are likelier slips than others.
LOOK_ALIKE = frozenset(frozenset(p) for p in ("08", "17", "38", "56", "69", "49", "27"))
TRANSPOSED, DOUBLED, ALIKE, OTHER = 0.8, 0.85, 0.9, 1.0


def weighted_edits(a: str, b: str, bound: int) -> float | None:
    """Weighted Damerau-Levenshtein distance (restricted), or None if more than ``bound`` edits are needed."""
    if abs(len(a) - len(b)) > bound:
        return None
    big = (len(a) + len(b) + 1, float(len(a) + len(b) + 1))
    rows = [[big] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i == j == 0:
                rows[0][0] = (0, 0.0)
                continue
            if abs(i - j) > bound:
                continue
            best = big
            if i:
                n, w = rows[i - 1][j]
                best = min(best, (n + 1, w + (DOUBLED if i > 1 and a[i - 1] == a[i - 2] else OTHER)))
            if j:
                n, w = rows[i][j - 1]
                best = min(best, (n + 1, w + (DOUBLED if j > 1 and b[j - 1] == b[j - 2] else OTHER)))
            if i and j:
                n, w = rows[i - 1][j - 1]
                if a[i - 1] == b[j - 1]:
                    best = min(best, (n, w))
                else:
                    best = min(best, (n + 1, w + (ALIKE if frozenset((a[i - 1], b[j - 1])) in LOOK_ALIKE else OTHER)))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    n, w = rows[i - 2][j - 2]
                    best = min(best, (n + 1, w + TRANSPOSED))
            rows[i][j] = best
    n, w = rows[-1][-1]
    return w if n <= bound else None
