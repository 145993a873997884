"""Problem 3: records of one split that occur, exactly or almost, in another.

Normalised records are cut into content-defined chunks by a rolling hash; chunk digests are joined across
splits, the lengths of a pair's shared chunks are summed, and each record has the share of its own letters that
they make up. Pairs of enough common chunks are then compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm import chunks as C
from pairloom.llm.store import written

LEAST_WORDS = 30


def split_side(split_col: str = "split") -> str:
    """0 for train, 1 for dev and test, null for any other; case and padding ignored."""
    s = f"lower(regexp_replace(`{split_col}`, '(?U)^\\\\s+|\\\\s+$', ''))"
    return f"case when {s} = 'train' then 0 when {s} in ('dev', 'test') then 1 end"


def candidates(prefix: DataFrame, loose: float) -> DataFrame:
    """(doc_a of side 0, doc_b of side 1): texts that share a chunk of their prefixes and, by their signatures, folded
    ones first, may share `loose` of their chunks. A frequent chunk's rows are split on one side and repeated on
    the other."""
    words = [f"w{i}" for i in range(C.THIN)]
    rows = prefix.withColumn("parts", C.parts(C.PART)).withColumn("thin", F.col("shared") - sum((F.bit_count(w) for w in words), F.lit(0))).withColumn("folded", F.col("shared") - F.size("bits"))
    rows = rows.select("digest", "doc", "side", "n", "parts", "thin", "folded", *words, "bits")
    a = rows.where("side = 0").withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")).drop("side", "parts")
    b = rows.where("side = 1").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("side", "parts")
    a, b = (x.select("digest", "part", *[F.col(c).alias(f"{c}_{k}") for c in x.columns if c not in ("digest", "part")]) for x, k in ((a, "a"), (b, "b")))
    need = F.lit(loose) * F.greatest("n_a", "n_b")
    thin = sum((F.bit_count(F.col(f"{w}_a").bitwiseAND(F.col(f"{w}_b"))) for w in words), F.lit(0)) + F.least("thin_a", "thin_b")
    met = a.join(b, ["digest", "part"]).where((F.col("doc_a") != F.col("doc_b")) & (thin >= need))
    return met.where(F.size(F.array_intersect("bits_a", "bits_b")) + F.least("folded_a", "folded_b") >= need).select("doc_a", "doc_b").distinct()


def with_fractions(pairs: DataFrame, texts: DataFrame, least_words: int, mean: int) -> DataFrame:
    """pairs + (shared, fraction_a, fraction_b): the summed lengths of the chunks that both texts have, and the share
    of each text's letters that they are. Chunks are joined for the texts of pairs only."""
    docs = pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("doc")).distinct()
    body = C.bodies(texts, least_words, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b["text"].to_pylist()
            _, _, _, text, digest, length = C.chunked(raw, [""] * len(raw), mean)
            yield pa.record_batch([pa.array(b["text_hash"].to_numpy()[text]), pa.array(digest), pa.array(length.astype(np.int32))], names=["doc", "chunk", "length"])

    chunks = body.mapInArrow(run, "doc bigint, chunk bigint, length int")
    letters = chunks.groupBy("doc").agg(F.sum("length").alias("letters"))
    a, b = (chunks.withColumnRenamed("doc", f"doc_{k}") for k in "ab")
    shared = pairs.select("doc_a", "doc_b").join(a, "doc_a").join(b.drop("length"), ["doc_b", "chunk"]).groupBy("doc_a", "doc_b").agg(F.sum("length").alias("shared"))
    for k in "ab":
        shared = shared.join(letters.select(F.col("doc").alias(f"doc_{k}"), F.col("letters").alias(f"letters_{k}")), f"doc_{k}")
    return shared.select("doc_a", "doc_b", "shared", *[(F.col("shared") / F.col(f"letters_{k}")).alias(f"fraction_{k}") for k in "ab"])


def cross_split_texts(df: DataFrame, id_col: str, text_col: str, side: str, least_words: int = LEAST_WORDS, mean: int = C.MEAN, loose: float = C.LOOSE) -> tuple[DataFrame, DataFrame]:
    """(links, members): links (doc_a of side 0, doc_b of side 1, shared, fraction_a, fraction_b) between different
    texts, and which rows hold each text."""
    texts = C.long_form(df, id_col, [text_col], side)
    rows, phrase = C.ranked(texts, least_words, mean, across=True)
    links = C.confirmed(candidates(C.prefixes(rows, phrase, loose, longs=True), loose), texts, least_words)
    return with_fractions(links, texts, least_words, mean), written(C.members(texts, least_words), "members")


def cross_split_pairs(df: DataFrame, id_col: str, text_col: str, side: str, least_words: int = LEAST_WORDS, mean: int = C.MEAN, loose: float = C.LOOSE) -> DataFrame:
    """(id_0, id_1, fraction_0, fraction_1): all pairs of a row of side 0 and one of side 1 with the same or nearly
    the same text, and how much of each lies in shared chunks.

    Nearly the same: as in signature_tree. Equal texts (after folding) have fractions of 1. Null ids, null texts
    and rows of no side take no part; nor do texts of fewer than least_words words. A repeated row pairs as any
    other. Other columns of df, whatever their names, don't matter. An empty table gives no pairs."""
    near, who = cross_split_texts(df, id_col, text_col, side, least_words, mean, loose)
    m0 = who.where("side = 0").select(F.col("id").alias("id_0"), F.col("text_hash").alias("doc_a"))
    m1 = who.where("side = 1").select(F.col("id").alias("id_1"), F.col("text_hash").alias("doc_b"))
    one = F.lit(1.0)
    same = C.met(m0, m1.withColumnRenamed("doc_b", "doc_a"), "doc_a").select("id_0", "id_1", one.alias("fraction_0"), one.alias("fraction_1"))
    return C.met(m0, C.met(near, m1, "doc_b"), "doc_a").select("id_0", "id_1", F.col("fraction_a").alias("fraction_0"), F.col("fraction_b").alias("fraction_1")).unionByName(same)


def record_overlaps(near: DataFrame, who: DataFrame) -> DataFrame:
    """(id_1, n_pairs, fraction): each row of side 1 that has counterparts, their number, and the largest share of it
    that one of them holds. From cross_split_texts(); copies are counted, not paired."""
    n0 = who.where("side = 0").groupBy(F.col("text_hash").alias("doc_a")).agg(F.count(F.lit(1)).alias("k"))
    texts1 = who.where("side = 1").select(F.col("text_hash").alias("doc_a")).distinct()
    same = n0.join(texts1, "doc_a").select(F.col("doc_a").alias("doc_b"), "k", F.lit(1.0).alias("fraction"))
    met = near.join(n0, "doc_a").select("doc_b", "k", F.col("fraction_b").alias("fraction")).unionByName(same)
    per = met.groupBy("doc_b").agg(F.sum("k").alias("n_pairs"), F.max("fraction").alias("fraction"))
    return who.where("side = 1").select(F.col("id").alias("id_1"), F.col("text_hash").alias("doc_b")).join(per, "doc_b").select("id_1", "n_pairs", "fraction")


def split_report(df: DataFrame, overlaps: DataFrame, id_col: str, source_col: str, split_col: str = "split") -> DataFrame:
    """(split, source, n_rows, n_rows_found, n_pairs, share, mean_fraction): overlaps of each evaluation split and
    source; mean_fraction is over the rows found. A null source is reported as null."""
    side = F.lower(F.regexp_replace(F.col(f"`{split_col}`"), r"(?U)^\s+|\s+$", ""))
    rows = df.select(F.col(f"`{id_col}`").alias("id_1"), side.alias("split"), F.col(f"`{source_col}`").alias("source")).where("split in ('dev', 'test')")
    out = rows.join(overlaps, "id_1", "left").groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_rows"), F.count("n_pairs").alias("n_rows_found"), F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_pairs"), F.avg("fraction").alias("mean_fraction"))
    return out.withColumn("share", F.col("n_rows_found") / F.col("n_rows"))
