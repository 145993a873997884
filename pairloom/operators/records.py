"""Ids, gates, joins with completeness, de-duplication and set checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def article_id(c: Column) -> Column:
    """An id without its domain prefix; ids that begin with a digit have none. Case and blanks are ignored."""
    t = F.lower(F.regexp_replace(c, r"(?U)\s+", ""))
    return F.when(t.rlike("^[0-9]"), t).otherwise(F.regexp_replace(t, "^[^-]*-", ""))


def with_prefix(c: Column, domain: Column) -> Column:
    return F.when(F.startswith(c, F.concat(domain, F.lit("-"))), c).otherwise(F.concat(domain, F.lit("-"), c))


def clean_split(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def resolved(left: DataFrame, pool: DataFrame, left_id: str, pool_id: str) -> DataFrame:
    """left + (pool_key): the id's match in pool, exact if there is one, else without its prefix, else null."""
    keys = pool.select(F.col(pool_id).alias("_k")).where("_k is not null").distinct()
    x = left.withColumn("_bare", F.regexp_replace(F.col(left_id), "^[^0-9-][^-]*-", ""))
    x = x.join(keys.select(F.col("_k").alias("_exact")), F.col(left_id) == F.col("_exact"), "left").join(keys.select(F.col("_k").alias("_stripped")), F.col("_bare") == F.col("_stripped"), "left")
    return x.withColumn("pool_key", F.coalesce("_exact", "_stripped")).drop("_bare", "_exact", "_stripped")


def joined_complete(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that fails, when run, on a left row without a match."""
    marked = right.withColumn("_here", F.lit(True))
    x = left.join(marked, key, "left")
    return x.where(F.when(F.col("_here"), True).otherwise(F.raise_error(F.concat(F.lit(f"no match for {key} "), F.col(key).cast("string"))).cast("boolean"))).drop("_here")


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; a window group limit keeps hot keys from being sorted whole."""
    w = Window.partitionBy(*key).orderBy(*[c.desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_wins(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key in the order given; null keys are dropped. As an aggregation it combines on
    the map side, so a hot key costs one row for each task."""
    row, rank = F.struct(*[F.col(c) for c in df.columns]), F.struct(*[F.col(c) for c in order])
    return df.withColumn("_key", key).where("_key is not null").groupBy("_key").agg(F.min_by(row, rank).alias("_row")).select("_row.*")


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def pair_gate(df: DataFrame, human: str, ai: str, tau: float) -> DataFrame:
    """human < tau and ai >= tau."""
    return df.where((F.col(human) < tau) & (F.col(ai) >= tau))


def loop_gate(df: DataFrame, human: str, ai: str, tau: float) -> DataFrame:
    """human < tau and ai > tau: strict on both sides."""
    return df.where((F.col(human) < tau) & (F.col(ai) > tau))


def floor_filled(df: DataFrame, kept: Column, by: str, margin: Column, least: int, tie: str) -> DataFrame:
    """Kept rows, and for a group that has fewer than `least`, its rejected rows of the largest margin (floor true)."""
    w = Window.partitionBy(by)
    x = df.withColumns({"_kept": F.coalesce(kept, F.lit(False)), "_margin": margin}).withColumn("_n", F.sum(F.col("_kept").cast("int")).over(w))
    x = x.withColumn("_r", F.row_number().over(w.orderBy(F.col("_kept"), F.col("_margin").desc_nulls_last(), tie)))
    return x.where(F.col("_kept") | (F.col("_r") <= least - F.col("_n"))).withColumn("floor", ~F.col("_kept")).drop("_kept", "_margin", "_n", "_r")


def without_trained(pool: DataFrame, trained: DataFrame, key: str) -> DataFrame:
    """The pool's distinct keys that a classifier was not trained on."""
    return pool.where(F.col(key).isNotNull()).select(key).distinct().join(trained.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def score_source(df: DataFrame, first: Column, a: str, b: str) -> DataFrame:
    """df + (score, src): column a where `first` holds, b elsewhere; a missing score fails when run."""
    value = F.when(first, F.col(a)).otherwise(F.col(b))
    return df.withColumns({"score": F.coalesce(value, F.raise_error(F.lit("a row has no score of its source")).cast("double")), "src": F.when(first, "oof").otherwise("final")})


def manifest_rows(manifest: DataFrame, rows: DataFrame, key: str, n: int) -> DataFrame:
    """The manifest's rows in full; fails, when run, unless it has exactly n distinct ids, all of them in rows."""
    have = manifest.agg(F.count(F.lit(1)).alias("_all"), F.countDistinct(key).alias("_ids"))  # one row
    ok = (F.col("_all") == n) & (F.col("_ids") == n)
    checked = manifest.crossJoin(F.broadcast(have)).where(F.when(ok, True).otherwise(F.raise_error(F.lit(f"a manifest must hold {n} different ids")).cast("boolean"))).drop("_all", "_ids")
    return joined_complete(checked, rows, key)


def given_or_sample(given: DataFrame, rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """(key): the given ids if there are any, else n of rows in a seeded order."""
    if given.limit(1).count():
        return given.select(key)
    return rows.select(key).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def numbered_on(new: DataFrame, old: DataFrame, key: str, order: str) -> DataFrame:
    """new + (candidate): its number within its key, counted on from the rows that old has."""
    have = old.groupBy(key).agg(F.count(F.lit(1)).alias("_have"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return new.withColumn("_place", place).join(have, key, "left").withColumn("candidate", F.coalesce("_have", F.lit(0)) + F.col("_place")).drop("_have", "_place")
