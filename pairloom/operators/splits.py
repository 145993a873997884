"""Deterministic splits, samples, folds and quotas. Order comes from hashes, never from row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def md5_mod(c: Column, m: int) -> Column:
    """The 128-bit md5 as a number, modulo a small m, by Horner's rule over 32-bit pieces."""
    digits = F.md5(c.cast("binary"))
    piece = lambda i: F.conv(F.substring(digits, i, F.lit(8)), 16, 10).cast("bigint")
    return F.aggregate(F.array(*[F.lit(i) for i in (1, 9, 17, 25)]), F.lit(0).cast("bigint"), lambda a, i: (a * 4294967296 + piece(i)) % m)


def md5_mod_by(c: Column, m: Column) -> Column:
    """md5_mod with a modulus below 2^31 of its own for each row, 16 bits at a time so that nothing overflows."""
    digits = F.md5(c.cast("binary"))
    pieces = F.array(*[F.conv(F.substring(digits, F.lit(i), F.lit(4)), 16, 10).cast("bigint") for i in range(1, 33, 4)])
    return F.aggregate(pieces, F.lit(0).cast("bigint"), lambda a, p: (a * 65536 + p) % m)


def hash_split(c: Column, seed: int = 42, ratios: tuple[int, int, int] = (8, 1, 1)) -> Column:
    h = md5_mod(F.concat(F.lit(f"{seed}:"), c), sum(ratios))
    return F.when(h < ratios[0], "train").when(h < ratios[0] + ratios[1], "dev").otherwise("test")


def dev_half(c: Column) -> Column:
    return F.when(md5_mod(c, 2) == 0, "cal").otherwise("gate")


def shard(c: Column, n: int) -> Column:
    return (F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("bigint") % n).cast("int")


def seeded(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def largest_remainder(df: DataFrame, group: str, size: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly `size` rows, groups in proportion; quotas by largest remainder, ties by name; within a group
    by a seeded hash. size 0, or one above the number of rows, keeps all. Null groups are 'unknown'."""
    g = F.coalesce(F.nullif(F.col(group), F.lit("")), F.lit("unknown"))
    x = df.withColumn("_g", g)
    per = x.groupBy("_g").count()
    whole = Window.partitionBy()  # one row for each group
    exact = F.col("count") * F.lit(float(size)) / F.sum("count").over(whole)
    q = per.withColumn("_e", exact).withColumn("_f", F.floor("_e")).withColumn("_t", F.sum("count").over(whole))
    q = q.withColumn("_r", F.row_number().over(whole.orderBy((F.col("_e") - F.col("_f")).desc(), "_g")))
    quota = F.when((F.lit(size) <= 0) | (F.lit(size) >= F.col("_t")), F.col("count")).otherwise(F.col("_f") + (F.col("_r") <= F.lit(size) - F.sum("_f").over(whole)).cast("int"))
    q = q.select("_g", quota.alias("_q"))
    ranked = x.withColumn("_n", F.row_number().over(Window.partitionBy("_g").orderBy(seeded(key, seed), key)))
    if size > 0:  # no quota is above size: lets a task drop the rest of a large group before it is shuffled
        ranked = ranked.where(F.col("_n") <= size)
    return ranked.join(F.broadcast(q), "_g").where("_n <= _q").drop("_g", "_n", "_q")


def head_per(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def folds(df: DataFrame, key: str, k: int, seed: int = 42, buckets: int = 256) -> DataFrame:
    """df + (fold): rank in a seeded order, modulo k. Ranks are counted in buckets of the hash, shifted by the
    buckets before, so no task sorts all rows."""
    h = seeded(key, seed)
    x = df.withColumns({"_h": h, "_b": (F.conv(F.substring(h, 1, 2), 16, 10)).cast("int")})
    before = F.coalesce(F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = x.groupBy("_b").count().select("_b", before.alias("_s"))  # at most 256 rows
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) - 1 + F.col("_s")
    return x.join(F.broadcast(shift), "_b").withColumn("fold", (rank % k).cast("int")).drop("_h", "_b", "_s")


def group_quota(sizes: DataFrame, group: str, size: str, n: int, how: str = "large") -> DataFrame:
    """Groups, by size (large, small or spread), until n documents are reached. The table has a row for each group."""
    order = [F.col(size).asc() if how == "small" else F.col(size).desc(), F.col(group).asc()]
    if how == "spread":  # every k-th of the order of sizes first, k an eighth of the groups
        place, step = F.row_number().over(Window.orderBy(*order)) - 1, F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(Window.partitionBy()) / 8))
        sizes = sizes.withColumns({"_i": place, "_step": step}).withColumn("_o", F.struct((F.col("_i") % F.col("_step") != 0).alias("a"), F.col("_i").alias("b"))).drop("_i", "_step")
        order = [F.col("_o")]
    before = F.coalesce(F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("before", before).where(F.col("before") < n).drop("before", "_o")


def group_split(sizes: dict[str, int], ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), measure: dict[str, float] | None = None, rounds: int = 20) -> dict[str, str]:
    """Whole groups to splits: the largest first, each to the split with the largest deficit. With a measure
    (say digit density), groups are then moved as long as that brings the splits' means closer at no more
    than a tenth more size error. Group aggregates only, so it runs on the driver."""
    names, total = ("train", "dev", "test"), sum(sizes.values())
    want = {n: r * total for n, r in zip(names, ratios)}
    have = dict.fromkeys(names, 0)
    out: dict[str, str] = {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], g)):
        s = max(names, key=lambda n: (want[n] - have[n], -names.index(n)))
        out[g] = s
        have[s] += sizes[g]
    if not measure:
        return out
    mass = {n: sum(measure[g] * sizes[g] for g in out if out[g] == n) for n in names}
    overall = sum(mass.values()) / max(total, 1)

    def cost(h: dict[str, int], m: dict[str, float]) -> float:
        size_error = sum(abs(h[n] - want[n]) for n in names) / max(total, 1)
        spread = sum(abs(m[n] / h[n] - overall) for n in names if h[n]) / (abs(overall) + 1e-9)
        return spread + 10 * size_error

    best = cost(have, mass)
    for _ in range(rounds):
        moved = False
        for g in sorted(sizes):
            for n in names:
                if n == (o := out[g]):
                    continue
                h, m = dict(have), dict(mass)
                h[o], h[n] = h[o] - sizes[g], h[n] + sizes[g]
                m[o], m[n] = m[o] - measure[g] * sizes[g], m[n] + measure[g] * sizes[g]
                if (c := cost(h, m)) < best - 1e-12:
                    out[g], have, mass, best, moved = n, h, m, c, True
        if not moved:
            break
    return out


def round_robin(df: DataFrame, topic: str, publisher: str, order: list[str], per_stratum: int, n: int) -> DataFrame:
    """n rows, topics in turn, publishers within a topic in turn: rank in stratum, then rank of that among the
    topic's strata. At most per_stratum rows of a stratum are looked at."""
    stratum = Window.partitionBy(topic, publisher).orderBy(*order)
    x = df.withColumn("_n", F.row_number().over(stratum)).where(F.col("_n") <= per_stratum)
    x = x.withColumn("_t", F.row_number().over(Window.partitionBy(topic).orderBy("_n", publisher, *order)))
    return x.orderBy("_t", topic, publisher, *order).limit(n).drop("_n", "_t")


def legacy_sample(df: DataFrame, group: str, size: int, order: list[str], key: str, seed: int = 42) -> DataFrame:
    """Each group's first max(1, round(share)) rows, halves to even, then `size` of them in a seeded order."""
    per = df.groupBy(group).count()
    quota = per.select(group, F.greatest(F.lit(1), F.bround(F.lit(float(size)) * F.col("count") / F.sum("count").over(Window.partitionBy()), 0)).alias("_q"))  # a row for each group
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= size)
    return ranked.join(F.broadcast(quota), group).where("_n <= _q").drop("_n", "_q").orderBy(seeded(key, seed), key).limit(size)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(seeded(key, seed), key).limit(n)


def ranked_in(df: DataFrame, by: list[Column], key: str, buckets: int = 256) -> DataFrame:
    """df + (place): the number, from 0, of each row in the order `by`, ties by key. A range sort numbers rows within
    its ranges; they are shifted by the ranges before, so no task sorts all rows."""
    x = df.repartitionByRange(buckets, *by, key).sortWithinPartitions(*by, key).withColumn("_p", F.spark_partition_id())
    x = x.withColumn("_in", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    before = F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = x.groupBy("_p").count().select("_p", before.alias("_s"))  # at most `buckets` rows
    return x.join(F.broadcast(shift), "_p").withColumn("place", F.col("_in") + F.col("_s")).drop("_p", "_in", "_s")


def length_batches(df: DataFrame, length: str, key: str, size: int) -> DataFrame:
    """(key, batch): rows by length, the longest first, in batches of `size`."""
    return ranked_in(df, [F.col(length).desc()], key).select(key, F.floor(F.col("place") / size).alias("batch"))


def ratio_cut(df: DataFrame, key: str, cuts: tuple[float, float], seed: int = 42) -> DataFrame:
    """df + (part): a seeded order, cut at shares of the rows."""
    n = df.count()
    x = ranked_in(df.withColumn("_h", seeded(key, seed)), [F.col("_h")], key)
    return x.withColumn("part", F.when(F.col("place") < int(cuts[0] * n), "train").when(F.col("place") < int(cuts[1] * n), "dev").otherwise("test")).drop("_h", "place")


def resampled(df: DataFrame, group: str, key: str, n: int, seed: int = 42, weights: dict[str, int] | None = None) -> DataFrame:
    """(draw, key): n draws with replacement; a group is drawn by its weight (1 unless given), a row within it evenly.
    Draws are hashed to (group, place) and joined, so a draw costs one row whatever the table's size."""
    spark = df.sparkSession
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).count().orderBy(group).collect()  # a row for each group
    slots = [(r[group], r["count"]) for r in sizes for _ in range((weights or {}).get(r[group], 1))]
    if not slots:
        return df.sparkSession.createDataFrame([], f"draw bigint, `{key}` {df.schema[key].dataType.simpleString()}")
    table = F.broadcast(spark.createDataFrame([(i, g, m) for i, (g, m) in enumerate(slots)], "_i bigint, _g string, _m bigint"))
    draws = spark.range(n).withColumnRenamed("id", "draw").withColumn("_i", md5_mod(F.concat(F.lit(f"{seed}:g:"), F.col("draw")), len(slots)))
    picked = draws.join(table, "_i").withColumn("_r", md5_mod_by(F.concat(F.lit(f"{seed}:r:"), F.col("draw")), F.col("_m")))
    placed = df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(key)) - 1).select(F.col(group).alias("_g"), F.col("_r").cast("bigint").alias("_r"), key)
    return picked.select("draw", "_g", "_r").join(placed, ["_g", "_r"]).select("draw", key)
