"""Problem 7: sources mixed to target shares of the tokens, by min-cost flow.

A document is a text; one that stands in several sources can be drawn for any of them. Documents are
aggregated by membership pattern (the set of listed sources that hold the text). The flow routes the tokens
of patterns to the quotas of sources; the r-th use of a pattern's tokens costs r - 1, so repetition, being
convex, starts only where first uses don't suffice. The flow's size depends on sources and patterns only.
Documents are then drawn in a seeded order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.store import written

BUCKETS = 1024


class Flow:
    """Min-cost flow by successive shortest paths, integer capacities."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> int:
        total = 0
        while True:
            far = [None] * len(self.out)
            via = [-1] * len(self.out)
            far[source] = 0
            queue = [source]
            while queue:
                later = []
                for x in queue:
                    for e in self.out[x]:
                        if self.room[e] and (far[self.to[e]] is None or far[x] + self.cost[e] < far[self.to[e]]):
                            far[self.to[e]], via[self.to[e]] = far[x] + self.cost[e], e
                            later.append(self.to[e])
                queue = list(dict.fromkeys(later))
            if far[sink] is None:
                return total
            amount, x = None, sink
            while x != source:
                e = via[x]
                amount = self.room[e] if amount is None else min(amount, self.room[e])
                x = self.to[e ^ 1]
            x = sink
            while x != source:
                e = via[x]
                self.room[e] -= amount
                self.room[e ^ 1] += amount
                x = self.to[e ^ 1]
            total += amount


def routed(patterns: dict[int, int], shares: list[float], repeats: list[int], total: int) -> tuple[int, dict[tuple[int, int, int], int]]:
    """(tokens routed, {(pattern, source, use): tokens}). patterns: tokens by bit set of sources."""
    names = sorted(p for p in patterns if p and patterns[p] > 0)
    uses = max(repeats, default=0)
    base = 2 + len(names) * uses
    flow = Flow(base + len(shares))
    edges = {}
    for i, p in enumerate(names):
        for r in range(uses):
            node = 2 + i * uses + r
            flow.edge(0, node, patterns[p], r)
            for s in range(len(shares)):
                if p >> s & 1 and r < repeats[s]:
                    edges[p, s, r] = flow.edge(node, base + s, patterns[p])
    for s, share in enumerate(shares):
        flow.edge(base + s, 1, int(share * total))
    got = flow.run(0, 1)
    return got, {k: flow.room[e ^ 1] for k, e in edges.items() if flow.room[e ^ 1]}


def largest_total(patterns: dict[int, int], shares: list[float], repeats: list[int]) -> int:
    """The largest total for which each source that has documents can reach its share of it."""
    low, high = 0, sum(patterns.values()) * max(repeats, default=1) + 1
    while high - low > 1:
        mid = (low + high) // 2
        if routed(patterns, shares, repeats, mid)[0] == sum(int(s * mid) for s in shares):
            low = mid
        else:
            high = mid
    return low


def corrected(picks: DataFrame, one: DataFrame, quotas: dict[int, int]) -> DataFrame:
    """picks (text_hash, src, uses), each source brought nearer to its quota by one document: the unused one that fits
    what it lacks best is added, or one use of the one that fits its excess best is taken away."""
    spark = one.sparkSession
    picks = written(picks, "picks")
    got = {r["src"]: r["t"] for r in picks.join(one, ["text_hash", "src"]).groupBy("src").agg(F.sum(F.col("uses") * F.col("tokens")).alias("t")).collect()}  # a row for each source
    off = F.broadcast(spark.createDataFrame([(s, q - (got.get(s) or 0)) for s, q in quotas.items()], "src int, off bigint"))

    def nearest(rows: DataFrame) -> DataFrame:
        near = rows.join(off, "src").where("off <> 0 and tokens < 2 * abs(off)")
        return near.groupBy("src").agg(F.min_by("text_hash", F.struct(F.abs(F.col("tokens") - F.abs("off")), "text_hash")).alias("text_hash"), F.first("off").alias("off"))

    add = nearest(one.join(picks.select("text_hash").distinct(), "text_hash", "left_anti")).where("off > 0")
    add = add.groupBy("text_hash").agg(F.min("src").alias("src")).select("text_hash", "src", F.lit(1).cast("bigint").alias("uses"))
    drop = nearest(one.join(picks, ["text_hash", "src"])).where("off < 0").select("text_hash", "src", F.lit(-1).cast("bigint").alias("uses"))
    return picks.unionByName(add).unionByName(drop).groupBy("text_hash", "src").agg(F.sum("uses").alias("uses")).where("uses > 0")


def drawn(sized: DataFrame, targets: DataFrame, seed: int = 42, total_tokens: int | str | None = None) -> DataFrame:
    """(source, doc_id, uses, tokens, used_tokens): the draw. sized: (doc_id, source, text_hash, tokens).

    targets: (source, target_share, max_repeats), one row for each listed source, a bounded table. Sources without
    documents can't be drawn; their share is left to the others in proportion. Unless total_tokens is given,
    the total is the largest for which all others reach their shares, repeats included: any larger one would take a
    scarce source away from its share. With a larger one ("all": the tokens of all listed sources), scarce sources
    are repeated up to their limit and then stay below. Documents are drawn whole; each source is then brought nearer
    to its quota by one document. A text counts as one document, whatever rows repeat it; its uses, over all sources,
    never exceed the most that one of them allows, and its uses by a source never that source's own.
    Null sources, unlisted ones and texts without tokens take no part. Null or non-positive shares or
    repeats count as none. Empty tables give no rows."""
    spark = sized.sparkSession
    rows = [r for r in targets.select("source", "target_share", "max_repeats").distinct().orderBy("source").collect() if r["source"] and (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0]
    if len({r["source"] for r in rows}) < len(rows):
        raise ValueError("a source has more than one target")
    listed = F.broadcast(spark.createDataFrame([(r["source"], i) for i, r in enumerate(rows)], "source string, src int"))
    one = written(sized.where("tokens > 0 and text_hash is not null").join(listed, "source").groupBy("text_hash", "source", "src").agg(F.min("doc_id").alias("doc_id"), F.min("tokens").alias("tokens")), "sized")
    texts = one.groupBy("text_hash").agg(F.array_join(F.sort_array(F.collect_set("src")), ",").alias("pattern"), F.min("tokens").alias("tokens"))
    place = F.xxhash64(F.lit(seed), "text_hash")
    texts = texts.withColumns({"place": place, "bucket": F.pmod(place, F.lit(BUCKETS)).cast("int")})
    texts = written(texts, "texts")
    sums = texts.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("t"))
    named = {sum(1 << int(i) for i in r["pattern"].split(",")): (r["pattern"], r["t"]) for r in sums.groupBy("pattern").agg(F.sum("t").alias("t")).collect()}  # one row for each set of sources
    patterns = {p: t for p, (_, t) in named.items()}
    present = [i for i in range(len(rows)) if any(p >> i & 1 for p in patterns)]
    whole = sum(rows[i]["target_share"] for i in present) or 1.0
    shares = [rows[i]["target_share"] / whole if i in present else 0.0 for i in range(len(rows))]
    repeats = [r["max_repeats"] for r in rows]
    total = sum(patterns.values()) if total_tokens == "all" else total_tokens if total_tokens is not None else largest_total(patterns, shares, repeats)
    _, flow = routed(patterns, shares, repeats, total)
    ranges, at = [], {}
    for (p, s, r), tokens in sorted(flow.items(), key=lambda x: (x[0][0], x[0][2], x[0][1])):
        begin = at.get((p, r), 0)
        ranges.append((named[p][0], s, float(begin), float(begin + tokens)))
        at[p, r] = begin + tokens
    table = F.broadcast(spark.createDataFrame(ranges, "pattern string, src int, lo double, hi double"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sums.select("pattern", "bucket", before.alias("shift"))
    inside = F.sum("tokens").over(Window.partitionBy("pattern", "bucket").orderBy("place", "text_hash"))
    middle = texts.withColumn("inside", inside).join(shift, ["pattern", "bucket"]).withColumn("middle", F.col("shift") + F.col("inside") - F.col("tokens") / 2)
    picks = middle.join(table, "pattern").where("middle >= lo and middle < hi").groupBy("text_hash", "src").agg(F.count(F.lit(1)).alias("uses"))
    # what the flow routed to a source is what it can reach
    quotas = {i: sum(t for (_, s, _), t in flow.items() if s == i) for i in present}
    picks = corrected(picks, one, quotas)
    return one.join(picks, ["text_hash", "src"]).select("source", "doc_id", "uses", "tokens", (F.col("uses") * F.col("tokens")).alias("used_tokens"))


def share_report(draw: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, n_docs, most_uses, tokens, actual_share) of each listed source."""
    per = draw.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.max("uses").alias("most_uses"), F.sum("used_tokens").alias("tokens"))
    whole = per.agg(F.sum("tokens").alias("whole"))
    out = targets.select("source", "target_share").join(per, "source", "left").crossJoin(F.broadcast(whole))  # one row
    return out.select("source", "target_share", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"))
