"""Problem 6: documents into containers of fixed capacity, by large-item matching.

Documents above a third of the capacity pair at most twice in a container; they are matched greedily, the
largest with the largest that still fits. Smaller documents then fill the remaining gaps, best fit first.

Sizes are whole tokens, at most the capacity, so a plan needs only the number of documents of each size: a
histogram of at most `capacity` rows, however many documents there are. The plan is a list of runs ("the
documents of size s with ranks a to b go into containers c to c + b - a"), and each document finds its run by
its rank among those of its size.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.llm.store import written

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "piece_bpe_32k.model"
#: Ranks are counted within slices of a size of about so many rows, and SLICES at least, so that no size is ordered in
#: one task.
SLICES, SLICE_ROWS = 64, 100_000


def token_counts(texts: DataFrame, text_col: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """texts with tokens int in the text's place: its length under a public tokenizer. Null and empty texts have 0."""
    kept = [c for c in texts.columns if c != text_col]
    schema = ", ".join(f"`{c}` {t}" for c, t in texts.select(*kept).dtypes) + ", tokens int"
    names = [*kept, "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=f"{tokenizers}/{vocabulary}")
        for b in batches:
            ids = model.encode([t or "" for t in b[text_col].to_pylist()], num_threads=1)
            yield pa.record_batch([*(b[c] for c in kept), pa.array([len(x) for x in ids], pa.int32())], names=names)

    return texts.mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Runs (size, first rank, first container, number): the documents of a size, in rank order, take
    consecutive containers. Every document is placed, no container overflows."""
    left = {s: n for s, n in sorted(histogram.items()) if 0 < s <= capacity and n > 0}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # room left -> blocks (first container, number)
    rooms: list[int] = []
    containers = 0

    def take(size: int, first: int, n: int) -> None:
        runs.append((size, used[size], first, n))
        used[size] += n
        left[size] -= n

    def free(room: int, first: int, n: int) -> None:
        if room <= 0 or n <= 0:
            return
        if room not in gaps:
            gaps[room] = []
            insort(rooms, room)
        gaps[room].append((first, n))

    third = capacity / 3
    large = [s for s in left if s > third]
    for s in reversed(large):
        while left[s]:
            # the largest partner that fits, another document of the same size included
            i = bisect_left(large, capacity - s + 1) - 1
            while i >= 0 and (large[i] > s or not left[large[i]] or (large[i] == s and left[s] < 2)):
                i -= 1
            if i < 0:
                n = left[s]
                take(s, containers, n)
                free(capacity - s, containers, n)
            else:
                p = large[i]
                n = left[s] // 2 if p == s else min(left[s], left[p])
                take(s, containers, n)
                take(p, containers, n)
                free(capacity - s - p, containers, n)
            containers += n
    for s in [x for x in reversed(left) if x <= third]:
        while left[s]:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                n = -(-left[s] // (capacity // s))
                free(capacity, containers, n)
                containers += n
                continue
            room = rooms[i]
            first, n = gaps[room].pop()
            if not gaps[room]:
                del gaps[room], rooms[i]
            here = min(n, left[s])
            take(s, first, here)
            free(room - s, first, here)
            free(room, first + here, n - here)
    return runs


def ranked_by_size(pieces: DataFrame, keys: list[str], slices: int) -> DataFrame:
    """pieces + rank: a number from 0 within each size. Slices of a size are numbered apart and shifted by the
    slices before them, so a size that a third of all pieces have is no task of its own."""
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64(*keys), F.lit(slices)).cast("int"))
    per = sliced.groupBy("size", "slice").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = per.select("size", "slice", before.alias("shift"))
    inside = F.row_number().over(Window.partitionBy("size", "slice").orderBy(*keys)) - 1
    return sliced.withColumn("inside", inside).join(shift, ["size", "slice"]).withColumn("rank", F.col("inside") + F.col("shift")).drop("slice", "inside", "shift")


def numbered_documents(sized: DataFrame, id_col: str, size_col: str) -> DataFrame:
    """(id, n, row), written, so that the row numbers don't change."""
    docs = sized.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col), F.lit(0)).cast("int").alias("n"), F.monotonically_increasing_id().alias("row"))
    return written(docs, "documents")


def packed(sized: DataFrame, capacity: int, container: str, id_col: str = "doc_id", size_col: str = "tokens") -> DataFrame:
    """(container, capacity_tokens, id, piece, tokens, bin): where each document goes.

    A document larger than the capacity is cut into full pieces, each a bin by itself, and a rest that is placed
    as others are; no other document is split. Documents without tokens (null or empty texts) take no room: they
    are given bin 0, which is opened for them if need be. Equal ids are documents of their own. Null ids
    are placed, too. An empty table gives no rows."""
    spark: SparkSession = sized.sparkSession
    docs = sized if sized.columns == ["id", "n", "row"] else numbered_documents(sized, id_col, size_col)
    full = F.floor(F.col("n") / capacity).cast("int")
    rest = docs.select("id", "row", full.alias("piece"), (F.col("n") % capacity).alias("size")).where("size > 0")
    whole = docs.where(full > 0).select("id", "row", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"))
    slices = max(SLICES, int((docs.agg(F.sum(F.ceil(F.col("n") / capacity)).alias("k")).first()["k"] or 0) // SLICE_ROWS))
    histogram = {r["size"]: r["count"] for r in rest.groupBy("size").count().collect()}  # at most `capacity` rows
    runs = plan(histogram, capacity)
    containers = max((c + n for _, _, c, n in runs), default=0)
    table = spark.createDataFrame([(s, a, a + n, c) for s, a, c, n in runs], "size int, lo bigint, hi bigint, first bigint")
    # runs of one size are disjoint, and each rank lies in one; their number is bounded by the plan, not by the data
    placed = ranked_by_size(rest, ["row"], slices).join(F.broadcast(table), ["size"]).where("rank >= lo and rank < hi")
    out = placed.select("id", "piece", F.col("size").alias("tokens"), (F.col("first") + F.col("rank") - F.col("lo")).alias("bin"))
    numbered = ranked_by_size(whole.withColumn("size", F.lit(capacity)), ["row", "piece"], slices)
    out = out.unionByName(numbered.select("id", "piece", F.col("size").alias("tokens"), (F.col("rank") + containers).alias("bin")))
    nothing = docs.where("n <= 0").select("id", F.lit(0).alias("piece"), F.lit(0).alias("tokens"), F.lit(0).cast("bigint").alias("bin"))
    return out.unionByName(nothing).select(F.lit(container).alias("container"), F.lit(capacity).alias("capacity_tokens"), "id", "piece", "tokens", "bin")


def packed_all(sized: DataFrame, limits: list[tuple[str, int]], id_col: str = "doc_id", size_col: str = "tokens") -> DataFrame:
    """packed() for each (container, capacity); a null or non-positive capacity is an error."""
    if not limits:
        return packed(sized.limit(0), 1, "", id_col, size_col)
    docs, out = numbered_documents(sized, id_col, size_col), None
    for container, capacity in limits:
        if not capacity or capacity < 1:
            raise ValueError(f"container {container!r} has no capacity")
        part = packed(docs, int(capacity), container)
        out = part if out is None else out.unionByName(part)
    return out


def fill_report(placed: DataFrame) -> DataFrame:
    """(container, capacity_tokens, n_bins, tokens, fill, least_bins): fill is the share of the room that is used,
    least_bins the number below which no packing can go."""
    bins = placed.where("tokens > 0").groupBy("container", "capacity_tokens", "bin").agg(F.sum("tokens").alias("used"))
    out = bins.groupBy("container", "capacity_tokens").agg(F.count(F.lit(1)).alias("n_bins"), F.sum("used").alias("tokens"))
    return out.withColumns({"fill": F.col("tokens") / (F.col("n_bins") * F.col("capacity_tokens")), "least_bins": F.ceil(F.col("tokens") / F.col("capacity_tokens"))})
