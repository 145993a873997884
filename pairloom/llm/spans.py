"""Problem 5: long exact spans shared between records, by a log-structured fingerprint index.

Winnowing selects fingerprints (hashes of windows of WINDOW code points) so that each run of SPAN code
points holds at least one, chosen by that run alone. The index keeps immutable runs of historical
fingerprints, bucketed and sorted by hash. A new batch becomes a run of its own, is merge-joined with the
older runs bucket by bucket, without an exchange, and runs are compacted when there are too many. What
shares a fingerprint is then verified character by character.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairloom.llm import chunks as C
from pairloom.llm import kernels as K
from pairloom.llm.store import removed, shared_dir, written

SPAN, WINDOW = 80, 40
#: Runs before compaction.
FANOUT = 4
#: Up to so many fingerprints (8 bytes each) are broadcast; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: A fingerprint of more occurrences is verified by a distributed aggregation instead of in one task.
HOT = 20_000
#: Bits of the filter that spares texts without any shared fingerprint the shuffle. Its size is fixed;
#: if it fills up, it only spares less.
FILTER_WORDS = 1 << 16
OCCURRENCES = "fp bigint, record bigint, field int, pos int"
CONTEXTS = "fp bigint, hot boolean, record bigint, field int, pos int, before int, size int, context string"
INTERVALS = "record bigint, field int, size int, begin int, end int"


def occurrences(texts: DataFrame, span: int, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, offsets = K.pack(K.compose(b["text"].to_pylist(), "NFC"))
            text, pos, fp = K.winnow(codes, offsets, window, span)
            yield pa.record_batch([pa.array(fp), pa.array(b["record"].to_numpy()[text]), pa.array(b["field"].to_numpy()[text]), pa.array(pos.astype(np.int32))], names=["fp", "record", "field", "pos"])

    return texts.mapInArrow(run, OCCURRENCES)


RUN = "fp bigint, lo bigint, hi bigint, n bigint"


class SpanIndex:
    """An index over batches of texts (record bigint, field int, text string), kept in a folder: another session can
    open it there and go on. Runs that compaction has merged are deleted."""

    def __init__(self, spark: SparkSession, span: int = SPAN, window: int = WINDOW, buckets: int | None = None, path: str | None = None):
        self.spark, self.span, self.window = spark, span, window
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = path or f"{shared_dir(spark).rstrip('/')}/pairloom/spans-{uuid.uuid4().hex}"
        self.parts: dict[str, list[str]] = {"runs": [], "postings": [], "met": []}

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SpanIndex:
        """The index of a folder, as its last manifest has it."""
        last = spark.read.json(f"{path}/manifests/*").orderBy(F.desc("at")).first()
        out = cls(spark, last["span"], last["window"], last["buckets"], path)
        out.parts = {k: list(last[k] or []) for k in out.parts}
        return out

    def _saved(self) -> None:
        """Writes a manifest; a reader sees the one before or this one."""
        number = sum(map(len, self.parts.values()))
        row = [(time.time_ns(), self.span, self.window, self.buckets, *self.parts.values())]
        schema = "at bigint, span int, window int, buckets int, runs array<string>, postings array<string>, met array<string>"
        self.spark.createDataFrame(row, schema).coalesce(1).write.json(f"{self.path}/manifests/{number}-{uuid.uuid4().hex}")

    def _part(self, kind: str, rows: DataFrame) -> DataFrame:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{kind}/{name}")
        self.parts[kind].append(name)
        return self._read(kind, name, rows.schema)

    def _read(self, kind: str, name: str, schema: StructType | str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/{name}")

    def _all(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{kind}/{n}" for n in self.parts[kind]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _run(self, rows: DataFrame) -> DataFrame:
        """Rows (fp, lo, hi, n), one for each fp, as a run: bucketed and sorted by fp, never changed."""
        name = uuid.uuid4().hex
        rows.repartition(self.buckets, "fp").write.bucketBy(self.buckets, "fp").sortBy("fp").option("path", f"{self.path}/runs/{name}").saveAsTable(f"pairloom_run_{name}")
        self.parts["runs"].append(name)
        return self.spark.table(f"pairloom_run_{name}")

    def _history(self, name: str) -> DataFrame:
        """A run by name, made known to this session's catalogue if another session wrote it."""
        table = f"pairloom_run_{name}"
        if not self.spark.catalog.tableExists(table):
            self.spark.sql(f"create table {table} ({RUN}) using parquet clustered by (fp) sorted by (fp) into {self.buckets} buckets location '{self.path}/runs/{name}'")
        return self.spark.table(table)

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("fp").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))

    def add(self, texts: DataFrame) -> DataFrame:
        """Take in a batch; returns the fingerprints (fp, n) by which one of its records meets another, in the
        batch or in history."""
        found = self._part("postings", occurrences(texts, self.span, self.window))
        older = [self._history(n) for n in self.parts["runs"]]
        run = self._run(self._merged(found.select("fp", F.col("record").alias("lo"), F.col("record").alias("hi"), F.lit(1).cast("bigint").alias("n"))))
        state = run.select("fp", "lo", "hi", "n")
        met = state.where("lo <> hi").select("fp", "n")
        for old in older:
            o = old.select("fp", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("n").alias("n2"))
            both = state.hint("merge").join(o, "fp").where("least(lo, lo2) <> greatest(hi, hi2)")
            met = met.unionByName(both.select("fp", (F.col("n") + F.col("n2")).alias("n")))
        met = self._part("met", met.groupBy("fp").agg(F.max("n").alias("n")))
        old = self.compact() if len(self.parts["runs"]) > FANOUT else []
        self._saved()
        for name in old:  # no manifest names them any more
            self.spark.sql(f"drop table if exists pairloom_run_{name}")
            removed(self.spark, f"{self.path}/runs/{name}")
        return met

    def compact(self) -> list[str]:
        """Merges all runs into one; returns the names of those that it replaces."""
        old = self.parts["runs"]
        rows = self._history(old[0])
        for name in old[1:]:
            rows = rows.unionByName(self._history(name))
        self.parts["runs"] = []
        self._run(self._merged(rows))
        return old

    def marks(self) -> DataFrame:
        """(record, field, pos, fp, hot): the occurrences of all fingerprints that two records share."""
        fps = self._all("met", "fp bigint, n bigint").groupBy("fp").agg(F.max("n").alias("n"))
        fps = written(fps.select("fp", (F.col("n") > HOT).alias("hot")), "shared")
        small = fps.count() <= BROADCAST_ROWS
        return self._all("postings", OCCURRENCES).join(F.broadcast(fps) if small else fps, "fp").select("record", "field", "pos", "fp", "hot")


def _filter(marks: DataFrame) -> np.ndarray:
    """A bit for each hash of a marked text; FILTER_WORDS words of 64, whatever the input."""
    bits = marks.select(F.xxhash64("record", "field").alias("h")).selectExpr(f"cast(pmod(h, {FILTER_WORDS}) as int) as word", "shiftleft(1L, cast(pmod(shiftright(h, 40), 64) as int)) as bit")
    out = np.zeros(FILTER_WORDS, np.int64)
    for r in bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        out[r["word"]] = r["bits"]
    return out


def _marked(texts: DataFrame, marks: DataFrame) -> DataFrame:
    spark = texts.sparkSession
    words = spark.sparkContext.broadcast(_filter(marks))
    hashed = texts.withColumn("h", F.xxhash64("record", "field"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b["h"].to_numpy()
            hit = (words.value[h % FILTER_WORDS] >> ((h >> 40) % 64)) & 1 == 1
            yield pa.record_batch([b[c].filter(pa.array(hit)) for c in ("record", "field", "text")], names=["record", "field", "text"])

    return hashed.mapInArrow(run, "record bigint, field int, text string")


def contexts(texts: DataFrame, marks: DataFrame, span: int, window: int) -> DataFrame:
    """The SPAN - WINDOW code points on both sides of each marked fingerprint, and it itself."""
    reach = span - window
    some = _marked(texts, marks).select("record", "field", F.lit(-1).alias("pos"), "text", F.lit(0).cast("bigint").alias("fp"), F.lit(False).alias("hot"))
    both = some.unionByName(marks.select("record", "field", "pos", F.lit(None).cast("string").alias("text"), "fp", "hot"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.whole_groups(batches, ["record", "field"], 50_000):
            pos = t["pos"].to_numpy()
            at = np.flatnonzero(pos < 0)
            texts_here = K.compose(t["text"].take(pa.array(at)).to_pylist(), "NFC")
            owner = np.searchsorted(at, np.arange(len(pos)), "right") - 1
            record, field = t["record"].to_numpy(), t["field"].to_numpy()
            use = np.flatnonzero((pos >= 0) & (owner >= 0))
            use = use[(record[use] == record[at[owner[use]]]) & (field[use] == field[at[owner[use]]])]
            size = np.array([len(x) for x in texts_here], np.int32)[owner[use]] if len(use) else np.zeros(0, np.int32)
            low = np.maximum(pos[use] - reach, 0)
            cut = [texts_here[o][a:b] for o, a, b in zip(owner[use].tolist(), low.tolist(), (pos[use] + span).tolist())]
            take = pa.array(use)
            yield pa.record_batch([t["fp"].combine_chunks().take(take), t["hot"].combine_chunks().take(take), pa.array(record[use]), pa.array(field[use]), pa.array(pos[use]), pa.array((pos[use] - low).astype(np.int32)), pa.array(size), pa.array(cut, pa.string())], names=["fp", "hot", "record", "field", "pos", "before", "size", "context"])

    return both.repartition("record", "field").sortWithinPartitions("record", "field", "pos").mapInArrow(run, CONTEXTS)


def _matrix(context: list[str], before: np.ndarray, span: int, window: int) -> np.ndarray:
    """Contexts as rows of code points, the fingerprint at the same column; beyond a text's ends a row holds
    values that no other row has."""
    width = 2 * span - window
    out = np.repeat((np.uint32(0x110000) + np.arange(len(context), dtype=np.uint32))[:, None], width, 1)
    codes, offsets = K.pack(context)
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(context)), size)
    col = np.arange(len(codes)) - np.repeat(offsets[:-1], size) + np.repeat(span - window - before, size)
    out[row, col] = codes
    return out


def _pairs(begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within groups, in blocks."""
    row = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.r_[0, np.cumsum(size)][:-1], size)
    count = np.repeat(begin + size, size) - row - 1
    ends = np.cumsum(count)
    s = 0
    while s < len(row):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + 100_000, "right")))
        n = count[s:e]
        start = np.r_[0, np.cumsum(n)]
        a = np.repeat(row[s:e], n)
        yield a, a + 1 + np.arange(start[-1]) - np.repeat(start[:-1], n)
        s = e


def verified(rows: DataFrame, span: int, window: int, most_classes: int = 64) -> DataFrame:
    """(record, field, size, begin, end): what a text has in common with another record around a fingerprint,
    if that is a run of `span` code points or more. Equal contexts are one class, so copies cost
    nothing; different ones are compared pair by pair, or, in groups of many, by the hashes of all runs of
    `span` around the fingerprint."""
    reach = span - window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.whole_groups(batches, ["fp"], 50_000):
            fp, record, field, pos, before, size = (t[c].to_numpy() for c in ("fp", "record", "field", "pos", "before", "size"))
            context = t["context"].to_pylist()
            # rows of the same fp and context stand together: classes
            new_fp = np.r_[True, fp[1:] != fp[:-1]]
            new = new_fp | np.r_[True, before[1:] != before[:-1]] | np.array([True] + [x != y for x, y in zip(context[1:], context[:-1])])
            head = np.flatnonzero(new)
            cls = np.cumsum(new) - 1
            n = len(head)
            least, most = np.minimum.reduceat(record, head), np.maximum.reduceat(record, head)
            length = np.array([len(context[h]) for h in head])
            m = _matrix([context[h] for h in head], before[head], span, window)
            left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
            good = (least != most) & (length >= span)
            left[good], right[good] = before[head][good], (length - before[head] - window)[good]
            begin = np.flatnonzero(new_fp[head])
            count = np.diff(np.r_[begin, n])
            few = (count > 1) & (count <= most_classes)
            for a, b in _pairs(begin[few], count[few]):
                differ = (least[a] != least[b]) | (most[a] != most[b]) | (least[a] != most[a])
                a, b = a[differ], b[differ]
                equal = m[a] == m[b]
                same = equal[:, reach : reach + window].all(1)  # else only the hashes met
                l = np.where(equal[:, :reach].all(1), reach, equal[:, reach - 1 :: -1].argmin(1) if reach else 0)
                tail = equal[:, reach + window :]
                r = np.where(tail.all(1), reach, tail.argmin(1))
                ok = same & (l + r + window >= span)
                for x in (a[ok], b[ok]):
                    np.maximum.at(left, x, l[ok])
                    np.maximum.at(right, x, r[ok])
            for s, c in zip(begin[count > most_classes].tolist(), count[count > most_classes].tolist()):
                flat = K.windows_hash(np.ascontiguousarray(m[s : s + c]).reshape(-1), span)
                width = m.shape[1]
                shifts, heads = np.arange(reach + 1)[None, :], head[s : s + c]
                start = (reach - before[heads])[:, None]
                inside = ((shifts >= start) & (shifts + span <= start + length[s : s + c][:, None])).reshape(-1)
                at = (np.arange(c)[:, None] * width + shifts).reshape(-1)[inside]
                if not len(at):
                    continue
                h = flat[at]
                order = np.argsort(h, kind="stable")
                first = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
                who = s + at[order] // width
                met = np.minimum.reduceat(least[who], first) != np.maximum.reduceat(most[who], first)
                hit = np.repeat(met, np.diff(np.r_[first, len(h)]))
                x, shift = who[hit], at[order][hit] % width
                np.maximum.at(left, x, reach - shift)
                np.maximum.at(right, x, shift)
            use = (left + right + window >= span)[cls]
            c = cls[use]
            yield pa.record_batch([pa.array(record[use]), pa.array(field[use]), pa.array(size[use]), pa.array((pos[use] - left[c]).astype(np.int32)), pa.array((pos[use] + window + right[c]).astype(np.int32))], names=["record", "field", "size", "begin", "end"])

    return rows.repartition("fp").sortWithinPartitions("fp", "before", "context").mapInArrow(run, INTERVALS)


def verified_hot(rows: DataFrame, span: int, window: int) -> DataFrame:
    """The same for fingerprints of very many occurrences: each run of `span` around them becomes a row, and
    runs are aggregated before they are shuffled. No group is held by one task."""
    runs = rows.withColumn("shift", F.explode(F.sequence(F.lit(0), F.greatest(F.length("context") - span, F.lit(0)))))
    runs = runs.where(F.length("context") >= span).withColumn("run", F.sha2(F.substring(F.col("context"), F.col("shift") + 1, F.lit(span)), 256))
    met = runs.groupBy("run").agg(F.min("record").alias("lo"), F.max("record").alias("hi")).where("lo <> hi").select("run")
    begin = F.col("pos") - F.col("before") + F.col("shift")
    return runs.join(met, "run", "left_semi").select("record", "field", "size", begin.cast("int").alias("begin"), (begin + span).cast("int").alias("end"))


def shared_spans(index: SpanIndex, texts: DataFrame) -> DataFrame:
    """(record, field, size, begin, end): maximal pieces around fingerprints; they may overlap."""
    marks = written(index.marks(), "marks")
    rows = contexts(texts, marks, index.span, index.window)
    if not marks.where("hot").limit(1).count():
        return verified(rows, index.span, index.window)
    rows = written(rows, "contexts")
    return verified(rows.where("not hot"), index.span, index.window).unionByName(verified_hot(rows.where("hot"), index.span, index.window))


def record_texts(df: DataFrame, record: str, fields: dict[str, int]) -> DataFrame:
    """(record, field, text). record: an SQL expression over df's columns that gives a bigint."""
    parts = F.array(*[F.struct(F.lit(n).cast("int").alias("field"), F.col(f"`{f}`").alias("text")) for f, n in fields.items()])
    return df.select(F.expr(record).cast("bigint").alias("record"), F.explode(parts).alias("_x")).select("record", "_x.field", "_x.text").where("record is not null and text is not null")


def shared_text(batches: list[DataFrame], span: int = SPAN, window: int = WINDOW) -> DataFrame:
    """(record, field, size, shared, share): each text with a run of at least `span` code points (NFC) that occurs
    in another record, and how much of it lies in such runs. batches: tables (record, field, text), taken
    in one after the other.

    Fingerprints that any batch shares with it or with history are verified once, at the end. Null texts and records take no part; texts shorter than span have no such run. Rows with the same
    record value are one record, and one record's fields don't count against each other. No batch, or
    empty ones, give no rows."""
    index = SpanIndex(batches[0].sparkSession, span, window)
    for b in batches:
        index.add(b)
    texts = batches[0]
    for b in batches[1:]:
        texts = texts.unionByName(b)
    order = Window.partitionBy("record", "field").orderBy("begin", "end")
    upto = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = shared_spans(index, texts).withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("begin", upto)))
    out = parts.groupBy("record", "field").agg(F.max("size").alias("size"), F.sum("new").alias("shared"))
    return out.withColumn("share", F.col("shared") / F.col("size"))
