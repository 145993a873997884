"""Vectorised kernels over a batch of texts held as one array of code points.

A batch is a pair (codes, offsets): text i is codes[offsets[i]:offsets[i+1]]. Nothing here loops
over characters in Python, and no text is shortened.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_MIX = U(0xBF58476D1CE4E5B9)
_BASE = U(0xD6E8FEB86659FD93)
#: Characters handled at once by the kernels, so that their temporary arrays stay near 200 MB.
BLOCK = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambling of 64-bit integers."""
    x = x * _ODD
    x ^= x >> U(29)
    x *= _MIX
    x ^= x >> U(32)
    return x


def pack(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, offsets) of texts; null is as empty."""
    texts = [t or "" for t in texts]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def compose(texts: list[str | None], form: str) -> list[str]:
    """Unicode normalisation; texts already in the form are passed through."""
    return [t if unicodedata.is_normalized(form, t) else unicodedata.normalize(form, t) for t in (t or "" for t in texts)]


@lru_cache(1)
def _folding() -> np.ndarray:
    """For each code point: its lower-case letter or digit, or 0 where it is neither. No letter lies
    between the last ideographs and the end of the code space."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x34000):
        if (x := chr(c)).isalnum():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


@lru_cache(1)
def _spaces() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[c for c in range(0x3001) if chr(c).isspace()]] = True
    return table


def folded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Texts without regard to spacing, punctuation, letter case and Unicode form (NFKC)."""
    codes, offsets, _ = folded_words(texts)
    return codes, offsets


def folded_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, offsets, begins) of folded texts; begins are the places in codes where a word starts, a word being
    what stands between blanks and has a letter or digit."""
    raw, offsets = pack(compose(texts, "NFKC"))
    codes = _folding()[raw]
    keep = codes != 0
    kept = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    new = _spaces()[raw]
    new[offsets[:-1][offsets[:-1] < len(raw)]] = True
    word = np.cumsum(new)[keep]
    begins = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
    return codes[keep], kept[offsets], begins


def owners(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which text each place belongs to."""
    return np.searchsorted(offsets, at, "right") - 1


def numbered(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Values of which equal ones of one owner are told apart by their number: the k-th is the same for all owners,
    so common values of two owners count as often as both have them. The first keeps its value."""
    if not len(owner):
        return value
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    first = np.r_[True, (o[1:] != o[:-1]) | (v[1:] != v[:-1])]
    at = np.flatnonzero(first)
    k = np.arange(len(o)) - np.repeat(at, np.diff(np.r_[at, len(o)]))
    out = value.copy()
    again = k > 0
    out[order[again]] = mix(v[again].view(U) + mix(k[again].astype(U))).view(value.dtype)
    return out


def common(owner: np.ndarray, value: np.ndarray, n: int, a: np.ndarray, b: np.ndarray, block: int = 2_000_000) -> np.ndarray:
    """For each pair of owners a[i], b[i] how many numbered values they have in common."""
    _, value = np.unique(value, return_inverse=True)
    width = int(value.max()) + 1 if len(value) else 1
    packed = np.sort(owner.astype(np.int64) * width + value)
    begin = np.searchsorted(packed, np.arange(n + 1, dtype=np.int64) * width)
    size = np.diff(begin)
    a, b = np.where(size[a] <= size[b], a, b), np.where(size[a] <= size[b], b, a)
    out = np.zeros(len(a), np.int64)
    ends = np.cumsum(size[a])
    s = 0
    while s < len(a):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + block, "right")))
        x, y = a[s:e], b[s:e]
        start = np.r_[0, np.cumsum(size[x])]
        pair = np.repeat(np.arange(len(x)), size[x])
        at = np.arange(start[-1]) - np.repeat(start[:-1], size[x]) + np.repeat(begin[x], size[x])
        wanted = packed[at] % width + y[pair].astype(np.int64) * width
        hit = packed[np.minimum(np.searchsorted(packed, wanted), len(packed) - 1)] == wanted if len(wanted) else np.zeros(0, bool)
        out[s:e] = np.bincount(pair[hit], minlength=len(x))
        s = e
    return out


def blocks(offsets: np.ndarray, most: int = BLOCK):
    """Ranges of texts of about `most` characters each; a longer text is a range of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, end
        start = end


def text_hash(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text; empty texts hash to 0."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    for a, b in blocks(offsets):
        c, o = codes[offsets[a] : offsets[b]].astype(np.uint64), offsets[a : b + 1] - offsets[a]
        if not len(c):
            continue
        length = np.diff(o)
        place = np.arange(len(c), dtype=np.uint64) - np.repeat(o[:-1], length).astype(np.uint64)
        value = mix(c + mix(place + U(1)))
        some = length > 0
        out[a:b][some] = mix(np.add.reduceat(value, o[:-1][some]) + length[some].astype(np.uint64))
    return out.view(np.int64)


def windows_hash(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k code points, by doubling: log2(k) passes."""
    h = mix(codes.astype(np.uint64) + U(1))
    if len(h) < k:
        return np.zeros(0, np.uint64)
    total, span, power, have, result = k, 1, _BASE, 0, None
    while True:
        if total & 1:
            if result is None:
                result, have = h, span
            else:
                n = len(codes) - have - span + 1
                result, have = result[:n] * power + h[have : have + n], have + span
        total >>= 1
        if not total:
            return mix(result)
        n = len(h) - span
        h = h[:n] * power + h[span : span + n]
        span, power = span * 2, U(int(power) ** 2 & (1 << 64) - 1)


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each run of `width` values."""
    span = 1
    while span * 2 <= width:
        x = op(x[: len(x) - span], x[span:])
        span *= 2
    return op(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def winnow(codes: np.ndarray, offsets: np.ndarray, k: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, fingerprint): from every run of `span` code points inside a text at least one
    window of k is selected, and which one depends on that run alone (winnowing, minimal hash)."""
    width = span - k + 1
    texts, places, prints = [], [], []
    for a, b in blocks(offsets):
        c, o = codes[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if len(c) < span:
            continue
        h = windows_hash(c, k)
        low = _sliding(h, width, np.minimum)
        length = np.diff(o)
        rest = np.repeat(o[1:], length)[: len(low)] - np.arange(len(low))
        low = np.where(rest >= span, low, U(0))
        none = np.zeros(width - 1, np.uint64)
        high = _sliding(np.concatenate([none, low, none]), width, np.maximum)
        # a window is selected if it is the least of some run that holds it; runs in one text only
        at = np.flatnonzero((h == high) & (high > 0))
        owner = np.searchsorted(o, at, "right") - 1
        inside = o[owner + 1] - at >= k
        at, owner = at[inside], owner[inside]
        texts.append(owner + a)
        places.append(at - o[owner])
        prints.append(h[at])
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(texts), np.concatenate(places), np.concatenate(prints).view(np.int64)


def content_chunks(codes: np.ndarray, offsets: np.ndarray, mean: int, window: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, digest, length) of content-defined chunks. A rolling hash over `window` code points
    cuts after about one in `mean` of them, so that an edit moves only the cuts next to it. A chunk of more
    than 255 is cut again after each 255."""
    texts, digests, lengths = [], [], []
    limit = U((1 << 64) // mean)
    for a, b in blocks(offsets):
        c, o = codes[offsets[a] : offsets[b]].astype(np.uint64), offsets[a : b + 1] - offsets[a]
        if not len(c):
            continue
        h = c.copy()
        for i in range(1, window):
            h[i:] += c[:-i] * U(1_000_003**i)
        cut = mix(h) < limit
        size = np.diff(o)
        cut[o[1:][size > 0] - 1] = True
        ends = np.flatnonzero(cut) + 1
        starts = np.concatenate([[0], ends[:-1]])
        n = ends - starts
        if (n > 255).any():
            pieces = -(-n // 255)
            first = np.repeat(np.r_[0, np.cumsum(pieces)][:-1], pieces)
            starts = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - first)
            n = np.r_[starts[1:], len(c)] - starts
        place = np.arange(len(c), dtype=np.uint64) - np.repeat(starts, n).astype(np.uint64)
        digests.append(mix(np.add.reduceat(mix(c + (place << U(32))), starts) + n.astype(np.uint64)))
        lengths.append(n)
        texts.append(np.searchsorted(o, starts, "right") - 1 + a)
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(texts), np.concatenate(digests).view(np.int64), np.concatenate(lengths)
