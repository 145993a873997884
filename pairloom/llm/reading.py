"""Problem 8: reading level of each document, by regularised ordinal regression.

Features: lexical diversity, word rarity (bands of corpus frequency), connectives, clause depth, length of
words and sentences, and how hard the graded texts show a document's words to be. The corpus is counted
whole, into a table of fixed size; the regression is fitted on a bounded sample of graded documents.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Graded documents used for fitting, by order of a hash of their id.
MOST_GRADED = 12_000
#: Word counts are kept by hash: the table's size doesn't depend on the corpus.
SLOTS = 1 << 20
BANDS = 10
LEVELS = 5
RIDGE = 3.0
#: Pseudo-observations of the mean level for each word's difficulty.
SHRINK = 2.0
#: Folds for words' difficulties while fitting.
FOLDS = 10
# Connectives from plain to formal.
CONNECTIVES = [["그리고", "그래서", "그런데", "그러다가"], ["하지만", "또한", "이처럼", "그러나", "한편"], ["따라서", "이를테면", "요컨대", "그럼에도", "불구하고", "나아가", "아울러", "더불어"]]
# Endings that join clauses, and particles that nest nouns.
CLAUSE_ENDINGS = r"(?:고|며|으며|지만|으나|기에|므로|면서|는데|니까)[,]?$"
NESTING = r"(?:의|대한|적인)$"


def _plain(texts: list[str | None]) -> pa.Array:
    out = [unicodedata.normalize("NFKC", t or "").lower() for t in texts]
    return pc.replace_substring_regex(pa.array(out, pa.string()), r"<[^<>]{0,60}>", " ")


@dataclass
class Words:
    """A batch of texts as words: text i's are those of owner i, each known by its place in `unique`."""

    owner: np.ndarray
    index: np.ndarray
    unique: list[str]
    stem: np.ndarray
    n: int

    @staticmethod
    def of(plain: pa.Array) -> Words:
        split = pc.split_pattern_regex(plain, r"[^\pL\pN]+")
        owner = pc.list_parent_indices(split).to_numpy()
        coded = split.flatten().dictionary_encode()
        index = coded.indices.to_numpy()
        unique = coded.dictionary.to_pylist()
        keep = np.array([w != "" for w in unique], bool)[index] if len(index) else np.zeros(0, bool)
        owner, index = owner[keep], index[keep]
        stems = [stem(w) for w in unique]
        return Words(owner, index, unique, slots(stems), len(plain))


def stem(word: str) -> str:
    """A word without its commonest particles. Numbers are 0."""
    if word[:1].isdigit():
        return "0"
    for tail in ("에서는", "에게는", "으로는", "에서", "에게", "으로", "은", "는", "이", "가", "을", "를", "의", "에", "과", "와", "도"):
        if word.endswith(tail) and len(word) > len(tail) + 1:
            return word[: -len(tail)]
    return word


def slots(stems: list[str]) -> np.ndarray:
    return (pd.util.hash_array(np.array(stems, object), categorize=False) % SLOTS).astype(np.int64) if stems else np.zeros(0, np.int64)


def frequencies(documents: DataFrame, text_col: str) -> np.ndarray:
    """How often each slot's words occur in all documents: SLOTS numbers, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            w = Words.of(_plain(b[text_col].to_pylist()))
            if len(w.index):
                count = np.bincount(w.index, minlength=len(w.unique))
                np.add.at(total, w.stem, count)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["slot", "n"])

    rows = documents.select(text_col).mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    t = rows.toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[t["slot"].to_numpy()] = t["n"].to_numpy()
    return out


def features(plain: pa.Array, w: Words, counts: np.ndarray) -> np.ndarray:
    """A row of features for each text. Texts without words have zeros."""
    n = np.bincount(w.owner, minlength=w.n).astype(float)
    some = np.maximum(n, 1)
    per = lambda values: np.bincount(w.owner, values, w.n) / some
    freq = np.log(np.maximum(counts[w.stem], 1) / max(counts.sum(), 1) + 1e-9)[w.index] if len(w.index) else np.zeros(0)
    band = np.clip(((freq + 18) / 1.3).astype(int), 0, BANDS - 1)
    uniq = np.unique(w.owner.astype(np.int64) * len(w.unique) + w.index) // max(len(w.unique), 1) if len(w.index) else np.zeros(0, np.int64)
    kinds = np.bincount(uniq, minlength=w.n)
    size = np.array([len(x) for x in w.unique])
    clause = pc.match_substring_regex(pa.array(w.unique, pa.string()), CLAUSE_ENDINGS).to_numpy(zero_copy_only=False).astype(float)
    nest = pc.match_substring_regex(pa.array(w.unique, pa.string()), NESTING).to_numpy(zero_copy_only=False).astype(float)
    sentences = np.maximum(pc.count_substring_regex(plain, r"[.!?。]+(?:\s|$)|\n").to_numpy(zero_copy_only=False), 1)
    chars = pc.utf8_length(plain).to_numpy(zero_copy_only=False)
    get = lambda v: v[w.index] if len(w.index) else np.zeros(0)
    cols = [per(freq), kinds / np.sqrt(2 * some), np.log1p(n), n / sentences, per(get(size)), per(get(size >= 5)), per(get(clause)) , np.bincount(w.owner, get(clause), w.n) / sentences, per(get(nest)), pc.count_substring(plain, ",").to_numpy(zero_copy_only=False) / sentences, np.log1p(chars)]
    cols += [per(band == k) for k in range(BANDS)]
    for group in CONNECTIVES:
        hit = np.array([x in group for x in w.unique], float)
        cols.append(np.bincount(w.owner, get(hit), w.n) / sentences)
    return np.nan_to_num(np.stack(cols, 1))


def difficulty(w: Words, level: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(sum of levels, number of texts, mean level) for each slot, over the texts that `has` holds for."""
    mean = float(level[has].mean()) if has.any() else 3.0
    pairs = np.unique(w.owner.astype(np.int64) * SLOTS + w.stem[w.index]) if len(w.index) else np.zeros(0, np.int64)
    text, s = pairs // SLOTS, pairs % SLOTS
    use = has[text]
    return np.bincount(s[use], level[text[use]], SLOTS), np.bincount(s[use], minlength=SLOTS).astype(float), mean


def difficulty_features(w: Words, table: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    """Mean difficulty of a text's words and its spread, and soft shares of easy, hard and hardest ones. Soft, since
    a word's difficulty moves a little with the folds that it is taken from."""
    total, number, mean = table
    d = ((total + SHRINK * mean) / (number + SHRINK))[w.stem][w.index] if len(w.index) else np.zeros(0)
    n = np.maximum(np.bincount(w.owner, minlength=w.n), 1)
    per = lambda v: np.bincount(w.owner, v, w.n) / n
    soft = lambda at: per(1 / (1 + np.exp(-(d - mean - at) / 0.3)))
    return np.stack([per(d), per(d * d), soft(-0.8), soft(0.4), soft(1.0)], 1)


@dataclass
class Model:
    counts: np.ndarray
    table: tuple[np.ndarray, np.ndarray, float]
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.center) / self.scale) @ self.weights

    def level(self, score: np.ndarray) -> np.ndarray:
        """The number of cuts that the score lies above, and one. Cuts are in order."""
        return 1 + (score[:, None] > self.cuts[None, :]).sum(1)


def fitted(x: np.ndarray, level: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, steps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(weights, cuts) of a cumulative-logit regression: P(level > k) = 1 / (1 + exp(cut_k - x w)), by Newton steps
    with a ridge on the weights."""
    k, d = LEVELS - 1, x.shape[1]
    theta = np.zeros(d + k)
    theta[d:] = np.linspace(1.5, -1.5, k)
    penalty = np.r_[np.full(d, ridge), np.full(k, 1e-3)]
    for _ in range(steps):
        grad, hess = -penalty * theta, np.diag(penalty)
        for j in range(k):
            z = np.clip(x @ theta[:d] + theta[d + j], -30, 30)
            p = 1 / (1 + np.exp(-z))
            r, v = weight * ((level > j + 1) - p), weight * np.maximum(p * (1 - p), 1e-6)
            grad[:d] += x.T @ r
            grad[d + j] += r.sum()
            hess[:d, :d] += (x * v[:, None]).T @ x
            cross = (x * v[:, None]).sum(0)
            hess[:d, d + j] += cross
            hess[d + j, :d] += cross
            hess[d + j, d + j] += v.sum()
        step = np.linalg.solve(hess, grad)
        theta += step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    return theta[:d], np.sort(-theta[d:])


def trained(texts: list[str], doc: np.ndarray, level: np.ndarray, counts: np.ndarray) -> Model:
    """A model from graded texts: rating i gives texts[doc[i]] the level level[i]. Words' difficulties are taken
    from other folds than the text's own while fitting; ratings far from the fit are weighed down once."""
    plain = _plain(texts)
    w = Words.of(plain)
    mean = np.bincount(doc, level, len(texts)) / np.maximum(np.bincount(doc, minlength=len(texts)), 1)
    base = features(plain, w, counts)
    fold = np.arange(len(texts)) * 7919 % FOLDS
    diff = np.zeros((len(texts), 5))
    for f in range(FOLDS):
        diff[fold == f] = difficulty_features(w, difficulty(w, mean, fold != f))[fold == f]
    x = np.concatenate([base, diff], 1)
    center, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - center) / scale
    weight = np.ones(len(doc))
    for _ in range(2):
        weights, cuts = fitted(z[doc], level, weight)
        guess = 1 + (1 / (1 + np.exp(-(z[doc] @ weights)[:, None] + cuts[None, :]))).sum(1)
        weight = np.where(np.abs(guess - level) > 1.2, 0.1, 1.0)
    return Model(counts, difficulty(w, mean, np.ones(len(texts), bool)), center, scale, weights, cuts)


def graded_texts(documents: DataFrame, graded: DataFrame, id_col: str, text_col: str, most: int = MOST_GRADED) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, and for each rating its text and level. At most `most` documents, chosen by a hash of their id."""
    marks = graded.where(f"level between 1 and {LEVELS} and doc_id is not null").select(F.col("doc_id").alias(id_col), F.col("level").cast("int").alias("level"))
    ids = marks.select(id_col).distinct().orderBy(F.xxhash64(id_col)).limit(most)
    rows = documents.select(id_col, text_col).where(F.col(text_col).isNotNull()).join(F.broadcast(ids), id_col).join(marks.join(F.broadcast(ids), id_col, "left_semi"), id_col).select(id_col, text_col, "level").toArrow()
    ids_here = rows[id_col].to_pylist()
    place = {x: i for i, x in enumerate(dict.fromkeys(sorted(ids_here)))}
    texts = [""] * len(place)
    for x, t in zip(ids_here, rows[text_col].to_pylist()):
        texts[place[x]] = t
    return texts, np.array([place[x] for x in ids_here], np.int64), rows["level"].to_numpy().astype(float)


def reading_levels(documents: DataFrame, graded: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_graded: int = MOST_GRADED) -> DataFrame:
    """(doc_id, level, score, korean_share): a row for each document. level is 1 to 5, score the point on the scale
    that the regression gives.

    A null or empty text, or one without words, has level null. Documents that aren't mainly Korean get a
    level, too, but korean_share tells them. Null ids and repeated rows are kept. Graded rows with a null or
    unknown level are ignored; without any graded text, ValueError is raised. An empty table of documents
    gives no rows if there are graded ones elsewhere to fit, else the error."""
    spark = documents.sparkSession
    counts = frequencies(documents, text_col)
    texts, doc, level = graded_texts(documents, graded, id_col, text_col, most_graded)
    if not len(doc):
        raise ValueError("no graded text to fit")
    model = spark.sparkContext.broadcast(trained(texts, doc, level, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            plain = _plain(b["text"].to_pylist())
            w = Words.of(plain)
            x = np.concatenate([features(plain, w, m.counts), difficulty_features(w, m.table)], 1)
            score = m.score(x)
            empty = np.bincount(w.owner, minlength=w.n) == 0
            letters = np.maximum(pc.count_substring_regex(plain, r"\pL").to_numpy(zero_copy_only=False), 1)
            korean = pc.count_substring_regex(plain, "[가-힣]").to_numpy(zero_copy_only=False) / letters
            yield pa.record_batch([b["id"], pa.array(m.level(score).astype(np.int32), mask=empty), pa.array(score, mask=empty), pa.array(korean)], names=["doc_id", "level", "score", "korean_share"])

    rows = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, level int, score double, korean_share double")
