"""Linear probes on character grams, with MLlib."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pairloom.functions.text import char_grams, squeezed
from pairloom.llm import kernels as K
from pairloom.llm.store import written
from pairloom.operators import linear as L
from pairloom.operators.stats import auroc
from pairloom.plans.session import prepare


def _grams(df: DataFrame, text: str) -> DataFrame:
    t = squeezed(F.col(text))
    return df.withColumn("_grams", F.concat(*[char_grams(t, n) for n in (2, 3, 4)]))


def text_probe(train: DataFrame, test: DataFrame, text: str, label: str, features: int = 1 << 18, ridge: float = 1e-3) -> DataFrame:
    """(n_pos, n_neg, auroc) on test of a TF-IDF probe fitted on train."""
    pipe = Pipeline(stages=[HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol=label, regParam=ridge, maxIter=30)])
    model = pipe.fit(_grams(train, text))
    scored = model.transform(_grams(test, text)).select(F.col(label).alias("y"), vector_to_array("probability")[1].alias("p"))
    return auroc(scored, [], "p", "y")


def _is_blank(codes: np.ndarray) -> np.ndarray:
    """As (?U)\\s does."""
    table = np.zeros(0x3002, bool)
    table[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
    return table[np.minimum(codes, 0x3001)]


def _ranges(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    for a, b in K.blocks(offsets, L.BLOCK):
        yield from ((i, min(b, i + L.MOST_ROWS)) for i in range(a, b, L.MOST_ROWS))


def _gram_blocks(features: int, text: str, label: str, fold: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: blocks of how often each slot's grams of two to four characters occur, blanks left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, offsets = K.pack(batch[text].to_pylist())
            keep = ~_is_blank(codes)
            codes, offsets = codes[keep], np.r_[0, np.cumsum(keep)][offsets]
            kept = batch.drop_columns([text])
            y, part = batch[label].to_numpy(zero_copy_only=False), batch[fold].to_numpy(zero_copy_only=False)
            for a, b in _ranges(offsets):
                c, o = codes[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                row = np.repeat(np.arange(b - a), np.diff(o))
                places, slots = [], []
                for n in (2, 3, 4):
                    h = (K.windows_hash(c, n) >> np.uint64(32)) * np.uint64(features) >> np.uint64(32)
                    inside = row[: len(h)] == row[n - 1 : n - 1 + len(h)]
                    places.append(row[: len(h)][inside])
                    slots.append(h[inside].astype(np.int64))
                yield L.block(np.concatenate(places), np.concatenate(slots), y[a:b], part[a:b], kept.slice(a, b - a))

    return run


def _tasks(blocks: DataFrame) -> DataFrame:
    """A task for each core, as each sends its sums in each step, and more only of large tables."""
    n = blocks.rdd.getNumPartitions()
    return blocks.coalesce(max(blocks.sparkSession.sparkContext.defaultParallelism, n // 8))


def out_of_fold(df: DataFrame, text: str, label: str, fold: str, k: int, features: int = 1 << 18) -> DataFrame:
    """df's columns besides the text + (p): each row scored by the probe that was fitted without its fold.

    Grams are counted once, and each pass serves all folds. Weights by rarity are left out, as the fit divides each
    slot by its deviation."""
    prepare(df.sparkSession)
    schema = StructType([*[df.schema[c] for c in df.columns if c != text], StructField("p", DoubleType())])
    blocks = _tasks(df.mapInArrow(_gram_blocks(features, text, label, fold), L.BLOCK_SCHEMA)).persist()
    try:
        return written(L.scored(blocks, L.fitted(blocks, features, k, 1e-3, 20), schema), "scores")
    finally:
        blocks.unpersist()


def stratified_folds(df: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """df + (fold): rank by the key's hash within each label, modulo k. Ranks are counted in 256 buckets of the hash, so
    no task sorts all rows."""
    x = df.withColumn("_h", F.md5(F.col(key).cast("string").cast("binary")))
    x = x.withColumn("_b", F.substring("_h", 1, 2))
    before = F.coalesce(F.sum("count").over(Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = x.groupBy(label, "_b").count().select(label, "_b", before.alias("_s"))  # at most 256 rows a label
    rank = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key)) - 1 + F.col("_s")
    return x.join(F.broadcast(shift), [label, "_b"]).withColumn("fold", (rank % k).cast("int")).drop("_h", "_b", "_s")


def cross_validated(df: DataFrame, key: str, text: str, label: str, k: int = 5, features: int = 1 << 18) -> DataFrame:
    """(folds, auroc): mean AUC over k folds that hold equal shares of both labels; null with fewer than k rows of one."""
    least = df.groupBy(label).count().agg(F.min("count").alias("n"), F.count(F.lit(1)).alias("labels")).first()
    if least["labels"] < 2 or least["n"] < k:
        return df.sparkSession.createDataFrame([(k, None)], "folds int, auroc double")
    x = stratified_folds(df, key, label, k).select("fold", label, text)
    per = auroc(out_of_fold(x, text, label, "fold", k, features), ["fold"], "p", label)
    return per.agg(F.lit(k).alias("folds"), F.avg("auroc").alias("auroc"))


def _runs_of_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(codes without blanks, offsets of words, [(text, 64-bit hash) of each run of one, two and three words, by its first
    word; of a run that leaves its text, the text is -1])."""
    codes, offsets = K.pack(texts)
    blank = _is_blank(codes)
    new = ~blank & np.r_[True, blank[:-1]]
    new[offsets[:-1][offsets[:-1] < len(codes)]] |= ~blank[offsets[:-1][offsets[:-1] < len(codes)]]
    owner = K.owners(offsets, np.flatnonzero(new))
    at = np.r_[np.flatnonzero(new[~blank]), (~blank).sum()]
    codes = codes[~blank]
    one = K.text_hash(codes, at).view(np.uint64)
    out, h = [(owner, one.view(np.int64))], one
    for n in (2, 3):
        h = K.mix(h[: max(0, len(one) - n + 1)] + K.mix(one[n - 1 :] + np.uint64(n)))
        out.append((np.where(owner[: len(h)] == owner[n - 1 :], owner[: len(h)], -1), h.view(np.int64)))
    return codes, at, out


def _batches_of(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for batch in batches:
        texts = batch[text].to_pylist()
        for a, b in _ranges(np.r_[0, np.cumsum([len(t or "") for t in texts])]):
            yield batch.slice(a, b - a), texts[a:b]


def _vocabulary(df: DataFrame, text: str, most: int) -> np.ndarray:
    """Hashes, sorted, of the `most` most frequent runs of one to three words that two texts have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _batches_of(batches, text):
            owner, h = (np.concatenate(x) for x in zip(*((o[o >= 0], h[o >= 0]) for o, h in _runs_of_words(texts)[2])))
            order = np.lexsort((owner, h))
            owner, h = owner[order], h[order]
            new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
            first = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])] if len(h) else np.zeros(0, bool)
            texts_with = np.add.reduceat(first.astype(np.int64), new) if len(new) else new
            yield pa.record_batch([pa.array(h[new]), pa.array(np.diff(np.r_[new, len(h)])), pa.array(texts_with)], names=["h", "n", "texts"])

    by = df.select(text).mapInArrow(run, "h long, n long, texts long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
    top = by.where("texts >= 2").orderBy(F.desc("n"), "h").limit(most).select("h").toArrow()
    return np.sort(top["h"].to_numpy())


def telling_words(df: DataFrame, text: str, label: str, top: int = 20, vocabulary: int = 100_000) -> DataFrame:
    """(word, weight): the words, and runs of two and three words, of largest and least weight in a probe over the
    `vocabulary` most frequent ones.

    Runs are told apart by 64-bit hashes; only those that come out are read as strings."""
    spark = prepare(df.sparkSession)
    known = _vocabulary(df, text, vocabulary)
    if not len(known):
        return spark.createDataFrame([], "word string, weight double")
    sent = spark.sparkContext.broadcast(known)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _batches_of(batches, text):
            places, slots = [], []
            for owner, h in _runs_of_words(texts)[2]:
                at = np.minimum(np.searchsorted(sent.value, h), len(sent.value) - 1)
                hit = (owner >= 0) & (sent.value[at] == h)
                places.append(owner[hit])
                slots.append(at[hit])
            yield L.block(np.concatenate(places), np.concatenate(slots), batch[label].to_numpy(zero_copy_only=False), np.full(len(texts), -1), batch.select([label]))

    blocks = _tasks(df.select(label, text).mapInArrow(counted, L.BLOCK_SCHEMA)).persist()
    try:
        weight = L.fitted(blocks, len(known), 1, 1e-3, 30)[0, :-1]
    finally:
        blocks.unpersist()
    ends = np.sort(weight)
    wanted = (weight <= ends[:top][-1]) | (weight >= ends[-top:][0])
    named = spark.sparkContext.broadcast(known[wanted])

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, texts in _batches_of(batches, text):
            codes, at, runs = _runs_of_words(texts)
            for n, (owner, h) in enumerate(runs, 1):
                hit = np.flatnonzero((owner >= 0) & np.isin(h, named.value))
                h, first = np.unique(h[hit], return_index=True)
                new = [(int(x), int(i)) for x, i in zip(h, hit[first]) if int(x) not in seen]
                seen.update(x for x, _ in new)
                spell = lambda i: codes[at[i] : at[i + 1]].tobytes().decode("utf-32-le", "surrogatepass")
                yield pa.record_batch([pa.array([x for x, _ in new], pa.int64()), pa.array([" ".join(spell(i + j) for j in range(n)) for _, i in new], pa.string())], names=["h", "word"])

    words_of = {r["h"]: r["word"] for r in df.select(text).mapInArrow(spelled, "h long, word string").distinct().collect()}
    ranked = sorted((float(w), words_of[int(h)]) for w, h in zip(weight[wanted], known[wanted]))
    return spark.createDataFrame([(w, c) for c, w in ranked[:top] + ranked[-top:]], "word string, weight double")
