"""Measures that no expression states well, as Arrow-batched functions: one pass over a text each."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from math import comb

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType


def most_repeated_gram(text: str | None, n: int = 6) -> int:
    """Occurrences of the commonest run of n characters, blanks left out."""
    t = "".join((text or "").split())
    return max(Counter(t[i : i + n] for i in range(len(t) - n + 1)).values(), default=0)


def longest_loop(text: str | None, periods: int = 4) -> int:
    """Words in the longest stretch in which each word equals the one `period` before it, for a period of 1 to 4, the
    first period included; 0 if no word does."""
    w, best = (text or "").split(), 0
    for p in range(1, periods + 1):
        run = 0
        for i in range(p, len(w)):
            run = run + 1 if w[i] == w[i - p] else 0
            if run:
                best = max(best, run + p)
    return best


def longest_common(a: str | None, b: str | None, blanks: bool = False) -> int:
    """Length of the longest common substring, by a suffix automaton of the shorter text."""
    a, b = a or "", b or ""
    if not blanks:
        a, b = "".join(a.split()), "".join(b.split())
    if len(a) > len(b):
        a, b = b, a
    go: list[dict[str, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in a:
        cur = len(go)
        go.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    best = state = length = 0
    for c in b:
        while state and c not in go[state]:
            state = link[state]
            length = size[state]
        if c in go[state]:
            state, length = go[state][c], length + 1
        best = max(best, length)
    return best


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a column of the table at once as the bits of two integers (Myers 1999)."""
    if not a or not b:
        return len(a) or len(b)
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = full, 0
    for c in b:
        eq = place.get(c, 0)
        across = ((eq & up) + up ^ up) | eq
        rise, fall = down | ~(across | up) & full, up & across
        score += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        eq |= down
        up, down = fall | ~(eq | rise) & full, rise & eq
    return score


def sentence_scores(a: str, b: str, autojunk: bool = True) -> tuple[int, int]:
    """(reused, closeness) of two sentences. Equal or contained ones are reused. Of others, unless both have
    fewer than five words, closeness counts which of four hold: common run of characters, its words,
    edit distance, common words. autojunk, on as in difflib, leaves out characters that are frequent in a sentence of
    200 and more."""
    if a == b or a in b or b in a:
        return 1, 0
    x, y = a.split(), b.split()
    if max(len(x), len(y)) < 5:
        return 0, 0
    short, long, few = min(len(a), len(b)), max(len(a), len(b)), min(len(x), len(y))
    run = SequenceMatcher(None, a, b, autojunk).find_longest_match()
    known = set(y)
    holds = [run.size > 0.8 * short, len(a[run.a : run.a + run.size].split()) > 0.8 * few, long - short < 0.6 * long and edit_distance(a, b) < 0.6 * long, sum(w in known for w in x) > 0.8 * few]
    return 0, sum(holds)


def redundancy(sentences: list[str]) -> tuple[float, float]:
    """(reused, approximate) sentence pairs for 1,000 pairs; 0 without pairs."""
    reused = close = pairs = 0
    for i, a in enumerate(sentences):
        for b in sentences[i + 1 :]:
            r, c = sentence_scores(a, b)
            reused, close, pairs = reused + r, close + c, pairs + 1
    return (1000 * reused / pairs, 1000 * close / pairs) if pairs else (0.0, 0.0)


def similarity_ratio(a: str | None, b: str | None) -> float:
    return SequenceMatcher(None, a or "", b or "", autojunk=False).ratio()


def exact_binomial(k: int, n: int) -> float:
    """Two-sided p of k successes in n fair trials, at most 1; 1 for n = 0."""
    if not n:
        return 1.0
    k = min(k, n - k)
    return min(1.0, float(2 * sum(comb(n, i) for i in range(k + 1)) / 2**n))


def copied_share(a: str | None, b: str | None, n: int = 12) -> float:
    """Percent of a's distinct runs of n characters that b has; 0 if a has none."""
    a, b = a or "", b or ""
    x = {a[i : i + n] for i in range(len(a) - n + 1)}
    return 100.0 * len(x & {b[i : i + n] for i in range(len(b) - n + 1)}) / len(x) if x else 0.0


@pandas_udf(DoubleType())
def copied_share_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([copied_share(x, y) for x, y in zip(a, b)], dtype="float64")


@pandas_udf(IntegerType())
def most_repeated_gram_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(most_repeated_gram).astype("int32")


@pandas_udf(IntegerType())
def longest_loop_udf(t: pd.Series) -> pd.Series:
    return t.map(longest_loop).astype("int32")


@pandas_udf(IntegerType())
def longest_common_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([longest_common(x, y) for x, y in zip(a, b)], dtype="int32")


@pandas_udf(StructType([StructField("reused", DoubleType()), StructField("approximate", DoubleType())]))
def redundancy_udf(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([redundancy([x for x in v]) if v is not None else (0.0, 0.0) for v in s], columns=["reused", "approximate"])


@pandas_udf(DoubleType())
def exact_binomial_udf(k: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([exact_binomial(int(a), int(b)) for a, b in zip(k, n)], dtype="float64")
