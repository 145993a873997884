"""The pN_ queries: each problem's operator on its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import defects, mixing, overlap, packing, reading, signature_tree, spans, truncation
from pairloom.llm.store import table


def _p1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, row_id, source, round, cut) of both tables, judged together."""
    pairs = table(spark, sf_dir, "pairs").select(F.lit("pairs").alias("tbl"), F.col("pair_id").alias("row_id"), "source", F.lit(None).cast("int").alias("round"), F.col("human_text").alias("text"))
    outputs = table(spark, sf_dir, "gen_test").select(F.lit("gen_test").alias("tbl"), F.col("gen_id").alias("row_id"), "source", "round", "text")
    rows = pairs.select("*", F.lit(False).alias("none")).unionByName(defects.with_exemption(outputs, "text", "none"))
    return truncation.truncated_rows(rows, ["tbl", "row_id", "source", "round"], "text", F.col("none"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p1_rows(spark, sf_dir).where("cut").select("tbl", "row_id")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut rows of each source, and for gen_test of each round."""
    return truncation.truncation_report(_p1_rows(spark, sf_dir), ["tbl", "source", "round"])


def _p2_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, row_id, source, answer, prompt) of both tables."""
    rows = table(spark, sf_dir, "pairs")
    pairs = rows.select(F.lit("pairs").alias("tbl"), F.col("pair_id").alias("row_id"), "source", F.col("ai_text").alias("answer"), F.col("human_text").alias("prompt"))
    asked = rows.select("pair_id", F.col("ai_text").alias("prompt"))
    outputs = table(spark, sf_dir, "gen_test").select("gen_id", "pair_id", "source", F.col("text").alias("answer")).join(asked, "pair_id", "left").select(F.lit("gen_test").alias("tbl"), F.col("gen_id").alias("row_id"), "source", "answer", "prompt")
    return pairs.unionByName(outputs)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.defective_answers(_p2_rows(spark, sf_dir), ["tbl", "row_id"])


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective answers of each table, by defect and, for truncated ones, by what shows it."""
    rows = defects.evidenced_answers(_p2_rows(spark, sf_dir), ["tbl", "row_id"])
    return rows.groupBy("tbl", "defect", "evidence").agg(F.count(F.lit(1)).alias("n_rows"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = overlap.cross_split_pairs(table(spark, sf_dir, "pairs"), "pair_id", "human_text", overlap.split_side())
    return pairs.select(F.least("id_0", "id_1").alias("id_a"), F.greatest("id_0", "id_1").alias("id_b"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping rows and pairs of each evaluation split and source."""
    df = table(spark, sf_dir, "pairs")
    found = overlap.record_overlaps(*overlap.cross_split_texts(df, "pair_id", "human_text", overlap.split_side()))
    return overlap.split_report(df, found, "pair_id", "source")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_tree.near_duplicate_pairs(table(spark, sf_dir, "pairs"), "pair_id", ["human_text", "ai_text"]).select("field", "id_a", "id_b")


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each record and field: the class it belongs to and its number of links."""
    return signature_tree.near_duplicate_groups(table(spark, sf_dir, "pairs"), "pair_id", ["human_text", "ai_text"])


def p5_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each text occurs word for word in other records."""
    pairs, outputs = table(spark, sf_dir, "pairs"), table(spark, sf_dir, "gen_test")
    batches = [spans.record_texts(pairs, "pair_id * 2", {"human_text": 0}), spans.record_texts(pairs, "pair_id * 2", {"ai_text": 1})]
    # outputs as they came, round by round; an unknown round comes last
    came = F.coalesce("round", F.lit(3))
    batches += [spans.record_texts(outputs.where(c), "gen_id * 2 + 1", {"text": 2}) for c in (came <= 0, came == 1, came == 2, came >= 3)]
    names = F.element_at(F.array(*map(F.lit, ("human_text", "ai_text", "text"))), F.col("field") + 1)
    tbl = F.when(F.col("field") == 2, "gen_test").otherwise("pairs")
    found = spans.shared_text(batches)
    return found.select(tbl.alias("tbl"), F.shiftright("record", 1).alias("row_id"), names.alias("field"), "size", "shared", "share")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_share(spark, sf_dir).select("tbl", "row_id", "field")


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each document, for each capacity."""
    sized = packing.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    limits = [(r["container"], r["capacity_tokens"]) for r in table(spark, sf_dir, "pack_limits").orderBy("capacity_tokens", "container").collect()]
    return packing.packed_all(sized, limits).withColumnRenamed("id", "doc_id")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(p6_pack(spark, sf_dir))


def _p7_draw(spark: SparkSession, sf_dir: str, total: str | None = None) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_targets")
    docs = table(spark, sf_dir, "documents").join(F.broadcast(targets.select("source").distinct()), "source")  # as many rows as targets
    sized = packing.token_counts(docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), "text"), "text")
    return mixing.drawn(sized, targets, total_tokens=total), targets


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draw: which documents of each source are used, and how often."""
    return _p7_draw(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each listed source."""
    return mixing.share_report(*_p7_draw(spark, sf_dir))


def p7_full_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a draw as large as the listed sources together: scarce ones are repeated up to their limit."""
    return mixing.share_report(*_p7_draw(spark, sf_dir, "all"))


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading level of each document."""
    return reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "graded_docs"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_levels(spark, sf_dir).where("level = 5 and korean_share >= 0.5").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_share": p5_share,
    "p6_pack": p6_pack,
    "p6_fill": p6_fill,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_full_shares": p7_full_shares,
    "p8_found": p8_found,
    "p8_levels": p8_levels,
}

#: None of these operators can be stated in SQL that ends in time on whole tables; the tests hold them
#: against brute force on small fixtures instead.
ORACLE: dict[str, str] = {}
