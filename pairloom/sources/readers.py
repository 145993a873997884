"""Readers: typed tables, strict JSON lines, nested archives, HTML and Markdown tables."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLES = "member string, doc_id string, topic string, publisher string, author string, date string, title string, body string, n_char int, n_para int"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    from pairloom.plans.session import prepare

    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, gzip by suffix. A malformed line is an error, blank ones are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_keys(spark: SparkSession, path: str, fields: list[str], require_text: bool = False) -> DataFrame:
    """The distinct keys of JSON lines; only the named fields are parsed."""
    schema = ", ".join(f"`{f}` string" for f in dict.fromkeys([*fields, "text"]))
    rows = spark.read.schema(schema).json(path)
    return (rows.where("text <> ''") if require_text else rows).select(*fields).distinct()


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where("trim(value) <> ''").count()


def paired_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, split, human_text, ai_text). Missing texts and repeated ids fail when the table is used."""
    rows = spark.read.schema("id string, doc_id string, split string, human_text string, ai_text string").option("mode", "FAILFAST").json(path)
    x = rows.select(F.coalesce(F.nullif(F.col("doc_id"), F.lit("")), F.col("id")).alias("doc_id"), "split", "human_text", "ai_text")
    good = (F.col("doc_id") != "") & F.col("split").isin("train", "dev", "test") & (F.col("human_text") != "") & (F.col("ai_text") != "")
    once = x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct("split", "human_text", "ai_text")).alias("_r"), F.min(F.coalesce(good, F.lit(False))).alias("_ok"))
    checked = F.when(F.col("_ok") & (F.col("_n") == 1), F.col("_r")).otherwise(F.raise_error(F.concat(F.lit("bad or repeated row: "), F.coalesce("doc_id", F.lit("null")))))
    return once.select("doc_id", checked.alias("_c")).select("doc_id", "_c.*")


def csv_manifest(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, with or without a byte order mark."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    return df.withColumnRenamed(df.columns[0], df.columns[0].lstrip("﻿")) if df.columns else df


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(id) of a JSON file: a list, or an object with detector or ids."""
    raw = spark.read.option("wholetext", True).text(path)
    ids = F.coalesce(F.from_json("value", "array<string>"), F.from_json(F.get_json_object("value", "$.detector"), "array<string>"), F.from_json(F.get_json_object("value", "$.ids"), "array<string>"))
    return raw.select(F.explode(ids).alias("id")).distinct()


def nested_articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles of ZIP archives of nested JSON, a task for each archive's members in turn.

    A member holds document[].paragraph[].form and metadata. The first paragraph is the title."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ARTICLES.split(", ")]
        for b in batches:
            for content in b["content"].to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(z.namelist()):
                        if not member.endswith(".json"):
                            continue
                        rows = []
                        for doc in json.loads(z.read(member)).get("document", []):
                            forms = [p.get("form") or "" for p in doc.get("paragraph", [])]
                            m, body = doc.get("metadata") or {}, "\n".join(forms[1:])
                            rows.append((member, doc.get("id"), m.get("topic"), m.get("publisher"), m.get("author"), m.get("date"), forms[0] if forms else None, body, len(body), len(forms)))
                        schema = pa.schema([(n, pa.int32() if n[:2] == "n_" else pa.string()) for n in names])
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ARTICLES)


def corpus_filter(articles: DataFrame, topics: list[str], least: int = 800, most: int = 1200, paragraphs: int = 6, quotes: float = 0.40) -> DataFrame:
    """Articles of the given topics and shape; cheap rules first, quotations last."""
    from pairloom.functions.text import quote_ratio

    shaped = articles.where(F.col("topic").isin(topics) & (F.col("n_para") >= paragraphs) & F.col("n_char").between(least, most))
    return shaped.where(quote_ratio(F.col("body")) <= quotes)


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple[int, list[str]]] = []
        self.table, self.cell = -1, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.table += 1
        elif tag == "tr":
            self.rows.append((self.table, []))
        elif tag in ("td", "th"):
            self.cell = ""

    def handle_data(self, data):
        if self.cell is not None:
            self.cell += data

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None and self.rows:
            self.rows[-1][1].append(" ".join(self.cell.split()))
            self.cell = None


def html_rows(html: str | None) -> list[tuple[int, int, list[str]]]:
    p = _Tables()
    p.feed(html or "")
    return [(t, i, cells) for i, (t, cells) in enumerate(p.rows) if cells]


def html_tables(df: DataFrame, key: str, html: str) -> DataFrame:
    """key + (table, row, cells) of each table row in a column of HTML."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(k, *r) for k, h in zip(b[key].to_pylist(), b[html].to_pylist()) for r in html_rows(h)]
            yield pa.record_batch([pa.array([o[0] for o in out], b[key].type), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.list_(pa.string()))], names=[key, "table", "row", "cells"])

    return df.select(key, html).mapInArrow(run, f"`{key}` {kind}, table int, row int, cells array<string>")


def markdown_table(lines: str, header: str) -> list[list[str]]:
    """Rows under an exact header line, up to the first line that is no row."""
    out, inside = [], False
    for line in lines.splitlines():
        if line.strip() == header.strip():
            inside = True
        elif inside and line.lstrip().startswith("|"):
            cells = [c.strip() for c in line.strip().strip("|").split("|")]
            if not all(set(c) <= set("-: ") for c in cells):
                out.append(cells)
        elif inside:
            break
    return out


def report_rows(lines: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Columns by a layout pattern's groups, of the report lines (file, line, text) that match it."""
    hit = lines.where(F.col("text").rlike(pattern))
    return hit.select("file", "line", *[F.regexp_extract("text", pattern, i + 1).alias(n) for i, n in enumerate(names)])
