"""Similarities of short texts, 0 to 100, as Arrow functions over whole batches.

``token_set`` and ``weighted`` follow the public description of the usual fuzzy
scores (normalised indel similarity, token sets, weighted maximum with partial
scores); parity with a particular library isn't claimed. ``sequence`` is the
ratio of the standard library's difflib.
"""

from __future__ import annotations

import difflib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for x in b:
        u = state & masks.get(x, 0)
        state = ((state + u) | (state - u)) & full
    return len(a) - state.bit_count()


def indel(a: str, b: str) -> float:
    """2 LCS / (|a| + |b|), in percent; two empty texts are alike."""
    n = len(a) + len(b)
    return 100.0 if not n else 200.0 * _common(a, b) / n


def partial(a: str, b: str) -> float:
    """The best indel similarity of the shorter text with a stretch of the longer one."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    best = 0.0
    for i in range(1 - len(a), len(b)):
        best = max(best, indel(a, b[max(0, i) : i + len(a)]))
    return best


def _sorted(words) -> str:
    return " ".join(sorted(words))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = x & y, x - y, y - x
    if both and (not left or not right):
        return 100.0
    core = _sorted(both)
    one, two = (f"{core} {_sorted(s)}".strip() for s in (left, right))
    best = indel(one, two)
    if both:
        best = max(best, indel(core, one), indel(core, two))
    return best


def _partial_tokens(a: str, b: str) -> float:
    """Partial similarity of sorted tokens; 100 if a token is in both."""
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 100.0
    return partial(_sorted(a.split()), _sorted(b.split()))


@lru_cache(maxsize=200_000)
def weighted_ratio(a: str, b: str) -> float:
    """The largest of whole, token and (for lengths that differ) partial similarities, each with its weight."""
    if not a or not b:
        return 0.0
    long = max(len(a), len(b)) / min(len(a), len(b))
    tokens = max(indel(_sorted(a.split()), _sorted(b.split())), token_set_ratio(a, b))
    if long < 1.5:
        return max(indel(a, b), tokens * 0.95)
    scale = 0.9 if long <= 8 else 0.6
    return max(indel(a, b), partial(a, b) * scale, _partial_tokens(a, b) * 0.95 * scale)


def sequence_ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio() * 100


SCORERS = {"token_set": token_set_ratio, "weighted": weighted_ratio, "sequence": sequence_ratio, "indel": indel}


def scorer(name: str):
    """A column function of two texts; pairs that repeat in a batch are scored once."""
    score = SCORERS[name]

    @F.pandas_udf("double")
    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(a.fillna(""), b.fillna("")):
            if pair not in known:
                known[pair] = score(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    return scored


def rounded(x: Column) -> Column:
    """x to one digit as Python rounds it: by the binary value, ties to even.

    Twenty times x is the sum of 16 x and 4 x, both exact; what that sum loses is known exactly too. So its distances to
    the odd numbers around it, which are the midpoints between tenths, have the right sign.
    """
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def nearest(v: Column) -> Column:
        a, b, s = 16 * v, 4 * v, 16 * v + 4 * v
        lost = (a - (s - (s - a))) + (b - (s - a))
        c = F.floor(s / 2 + 0.5).cast("double")
        even = lambda k: F.when(k % 2 == 0, k)
        return let(F.struct(s.alias("s"), lost.alias("lost"), c.alias("c")), lambda r: let(
            F.struct(((r["s"] - (2 * r["c"] - 1)) + r["lost"]).alias("low"), ((r["s"] - (2 * r["c"] + 1)) + r["lost"]).alias("high"), r["c"].alias("c")),
            lambda d: F.when(d["low"] < 0, d["c"] - 1).when(d["high"] > 0, d["c"] + 1).when(d["low"] == 0, F.coalesce(even(d["c"]), d["c"] - 1)).when(d["high"] == 0, F.coalesce(even(d["c"]), d["c"] + 1)).otherwise(d["c"]) / 10,
        ))

    return F.when(F.isnan(x), x).otherwise(let(x.cast("double"), nearest))
