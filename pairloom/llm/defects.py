"""Problem 2: answers that are empty, cut off, refusals, copies of the prompt, or in another language.

Answers are sorted, and neighbours' common prefixes show shortened versions; lengths that too many answers have
show limits; ends are judged by their context as in problem 1. Then come the rules for empty answers, refusals,
language and copies. Built-in expressions, but for the neighbour scan and the shares of common letter runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from pairloom.llm import kernels as K
from pairloom.llm import truncation as T
from pairloom.llm.store import written

# What stands for a missing answer, once folded to letters and digits.
PLACEHOLDERS = ["null", "none", "na", "nan", "nil", "undefined", "empty", "없음", "빈출력", "출력없음", "내용없음", "해당없음", "아래글을다시쓰세요"]
# Marks of a decline, an apology or a stated inability, by language.
DECLINE_KO = r"(드릴 수 없|드리지 못|드리기 (어렵|힘들|곤란)|할 수 없(습니다|어요|네요)|응하기 (어렵|힘들|곤란)|응할 수 없|거절하겠|거절합니다|거절할게|사양하겠|사양합니다|범위를 벗어|확인하지 못해|따를 수 없|기준에 맞지 않아)"
OPENING_KO = r"(죄송|미안|유감스럽|안타깝|말씀하신|요청하신|언어 모델|인공지능|양해|저는|제가|저로서는)"
DECLINE_EN = r"(?i)\b(can ?not|can't|unable to|not able to|must decline|won't|will not|decline to|not allowed to)\b"
OPENING_EN = r"(?i)\b(I|I'm|sorry|apologi[sz]e|unfortunately|as an (assistant|ai|language model))\b"
DECLINE_CJK = r"(できません|できかねます|お断り|お応えできない|无法|不能|抱歉|拒绝|無法)"
OPENING_CJK = r"(申し訳|すみません|私は|抱歉|对不起|很遗憾|作为|我)"
#: A refusal is short, apart from what it quotes, or else has next to nothing of its prompt.
REFUSAL_LENGTH, REFUSAL_SHARE = 400, 0.10
#: Share of the answer's runs of six letters that occur in the prompt, from which it is a copy. An answer of fewer than
#: SHORT letters is one if the prompt begins with it.
COPY = 0.65
COPY_GRAM, SHORT, LEAST_COPY = 6, 40, 6
#: Letters of answers and prompts whose runs are sorted at once.
GRAMS_AT_ONCE = 300_000
U = np.uint64
#: What a shortened version may have beyond the beginning that it shares with a longer answer: a letter, or a mark.
BEYOND = 2
#: An end that is known to finish texts isn't cut, whatever neighbours and lengths say.
FIRM_SHARE = 0.10


def _where(mark: str, text: Column, pattern: str, by: str) -> Column:
    """A replacement that is only tried where its mark occurs."""
    return F.when(F.contains(text, F.lit(mark)), F.regexp_replace(text, pattern, by)).otherwise(text)


def with_content(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with a column of the answer without reasoning blocks, code fences, headings and label lines."""
    t = F.col(name)
    x = T.pinned(df, name, _where("<", F.col(text), r"(?is)<(think|thinking|reasoning|analysis)>.*?(</\1>|$)", " "))
    x = T.pinned(x, name, _where("```", t, r"(?m)^\s*```\w*\s*$", " "))
    x = T.pinned(x, name, _where("#", t, r"(?m)^\s*#{1,6}\s*[^\n]{0,20}$", " "))
    # a short line that ends in a colon announces a text, but isn't one
    x = T.pinned(x, name, F.when(t.rlike(r"[:：]\s*(\n|$)"), F.regexp_replace(t, r"(?m)^[^\n]{0,30}[:：]\s*$", " ")).otherwise(t))
    ends = F.substring(t, 1, 1).rlike(r"(?U)[\s​﻿]") | F.right(t, F.lit(1)).rlike(r"(?U)[\s​﻿]")
    return T.pinned(x, name, F.when(ends, F.regexp_replace(t, r"(?U)^[\s​﻿]+|[\s​﻿]+$", "")).otherwise(t))


def letters(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def is_empty(text: Column, folded: Column) -> Column:
    """Null, or nothing but blanks, placeholders, labels and reasoning. folded: letters() of the content."""
    return text.isNull() | (folded == "") | folded.isin(PLACEHOLDERS)


def declines(content: Column) -> tuple[Column, Column]:
    """(whether the answer, as left by with_content(), declines near its beginning, whether it is short). What it quotes
    doesn't count, nor do others' refusals that it reports: those are told in the past, of somebody else."""
    t = F.regexp_replace(content, r"(?s)“[^”]*”|‘[^’]*’|(?<![\p{L}\p{N}])'[^'\n]{0,80}'|\"[^\"\n]{0,80}\"", " ")
    head = F.regexp_extract(t, r"^(?:[^.!?。]*+[.!?。]++){0,2}[^.!?。]*+", 0)
    both = lambda opening, decline: head.rlike(opening) & t.rlike(decline)
    says = both(OPENING_KO, DECLINE_KO) | both(OPENING_EN, DECLINE_EN) | (both(OPENING_CJK, DECLINE_CJK) & ~t.rlike("[가-힣]"))
    return says, (F.length(t) <= REFUSAL_LENGTH) & (F.length(content) <= REFUSAL_LENGTH + 100)


def with_exemption(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with whether its answer is empty or a short refusal, and so can't be cut."""
    x = with_content(df, text, "_content")
    x = T.pinned(x, "_x", letters(F.col("_content")))
    says, short = declines(F.col("_content"))
    return x.withColumn(name, is_empty(F.col(text), F.col("_x")) | (says & short)).drop("_content", "_x")


SCRIPTS = {"hangul": r"[가-힣ᄀ-ᇿ㄰-㆏]", "latin": r"[A-Za-zÀ-ɏ]", "kana": r"[぀-ヿ]", "han": r"[一-鿿㐀-䶿]", "cyrillic": r"[Ѐ-ӿ]", "arabic": r"[؀-ۿ]", "thai": r"[฀-๿]", "devanagari": r"[ऀ-ॿ]"}


@lru_cache(1)
def _scripts() -> np.ndarray:
    """For each code point of the first plane: the number of its script, from 1; 0 for none."""
    table = np.zeros(0x10000, np.int8)
    for i, p in enumerate(SCRIPTS.values(), 1):
        table[[c for c in range(0x10000) if not 0xD800 <= c < 0xE000 and re.match(p, chr(c))]] = i
    return table


def languages(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The language group that most of each folded text is in: a letter of Korean, Chinese or Japanese says about
    as much as two of an alphabet. Han with a tenth of kana is Japanese. None without letters."""
    count, size = len(offsets) - 1, np.diff(offsets)
    kind = _scripts()[np.minimum(codes, 0xFFFF)]
    by = np.bincount(np.repeat(np.arange(count) * 9, size) + kind, minlength=9 * count).reshape(count, 9)
    n = {k: by[:, i].astype(float) for i, k in enumerate(SCRIPTS, 1)}
    cjk = n["han"] + n["kana"]
    japanese = n["kana"] >= 0.1 * cjk
    weight = {"ko": n["hangul"] * 2, "latin": n["latin"] * 0.8, "ja": np.where(japanese, cjk * 2, 0.0), "zh": np.where(japanese, 0.0, cjk * 2)} | {k: n[k] for k in ("cyrillic", "arabic", "thai", "devanagari")}
    names = sorted(weight, reverse=True)
    w = np.stack([weight[k] for k in names])
    return np.where(w.max(0) > 0, np.array(names, object)[w.argmax(0)], None)


def gram_shares(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Share of the distinct runs of COPY_GRAM letters of each folded answer that its prompt has, too. Answers and prompts
    take turns. Runs of a pair are told apart by as many bits of their hash as its number leaves, 44 at least."""
    bounds = offsets[::2]
    out = np.zeros(len(bounds) - 1)
    for start, end in K.blocks(bounds, GRAMS_AT_ONCE):
        for a in range(start, end, 1 << 18):
            b = min(end, a + (1 << 18))
            g = K.windows_hash(codes[bounds[a] : bounds[b]], COPY_GRAM)
            if not len(g):
                continue
            text = np.repeat(np.arange(2 * (b - a), dtype=np.uint64), np.diff(offsets[2 * a : 2 * b + 1]))
            inside = text[: len(g)] == text[COPY_GRAM - 1 :]
            text, bits = text[: len(g)][inside], np.uint64(62 - (b - a).bit_length())
            # the pair, the run, and last whether it is the prompt's: a common run is two neighbours
            key = (((text >> U(1)) << bits | g[inside] >> (U(64) - bits)) << U(1)) | (text & U(1))
            key.sort()
            key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
            mine, pair = (key & U(1)) == 0, (key >> (bits + U(1))).astype(np.int64)
            both = np.flatnonzero(mine[:-1] & (key[1:] == key[:-1] + U(1)))
            out[a:b] = np.bincount(pair[both], minlength=b - a) / np.maximum(np.bincount(pair[mine], minlength=b - a), 1)
    return out


@F.pandas_udf(StructType([StructField(k, t) for k, t in (("size", IntegerType()), ("prompt_size", IntegerType()), ("share", DoubleType()), ("begins", BooleanType()), ("brief", StringType()), ("answer_language", StringType()), ("prompt_language", StringType()))]))
def compared(answer: pd.Series, prompt: pd.Series) -> pd.DataFrame:
    """Answers and prompts without regard to case, blanks and marks: the answer's letters and digits, the share of its
    runs that its prompt has, whether its prompt begins with it, if it is short, itself, if it is brief, and languages."""
    raw, offsets = K.pack([t for both in zip(answer, prompt) for t in both])
    codes = K._folding()[raw]
    keep = codes != 0
    codes, offsets = codes[keep], np.r_[0, np.cumsum(keep)][offsets]
    size, spoken = np.diff(offsets)[::2], languages(codes, offsets)
    begins, brief = np.zeros(len(size), bool), np.full(len(size), None, object)
    for i in np.flatnonzero(size < SHORT):
        a, b, c = offsets[2 * i : 2 * i + 3]
        begins[i] = b - a <= c - b and (codes[a:b] == codes[b : b + b - a]).all()
        brief[i] = codes[a:b].tobytes().decode("utf-32-le", "surrogatepass")
    return pd.DataFrame({"size": size, "prompt_size": np.diff(offsets)[1::2], "share": gram_shares(codes, offsets), "begins": begins, "brief": brief, "answer_language": spoken[::2], "prompt_language": spoken[1::2]})


def copies(size: Column, share: Column, begins: Column) -> Column:
    """True for an answer that repeats its prompt, whole or its opening sentences. From compared()."""
    return F.when(size >= SHORT, share >= COPY).otherwise((size >= LEAST_COPY) & begins)


def shared_beginning(x: str, y: str) -> int:
    """How many leading characters two texts have in common."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            high = mid
    return low


MARK = re.compile(T.MARKS)


def is_shortened(x: str, y: str) -> bool:
    """x is a beginning of y that stops before y's sentence does: what x has beyond their common prefix is at most
    BEYOND characters, or a mark for the rest, and y goes on further."""
    n = shared_beginning(x, y)
    beyond = x[n:].strip()
    if not n or len(y) - n <= len(x) - n or not (len(beyond) <= BEYOND or MARK.fullmatch(beyond)):
        return False
    before = x[:n].rstrip()
    # a stop in either text at this place ends a sentence
    return bool(before) and before[-1] not in ".!?。”\"’'…" and not y[n:].lstrip()[:1] in tuple(".!?。")


def shortened_versions(df: DataFrame, text_col: str) -> DataFrame:
    """(text_hash): xxhash64 of texts that are shortened versions of another one.

    Texts are sorted over the whole cluster, by ranges of their first 64 characters, and each is compared with the
    neighbours on both sides by the length of their common prefix. Each range is scanned once, and the seams between
    ranges, one row each, are closed after. Copies are dropped within each task before the sort, so none of them
    weighs on a range."""
    one = "text string"

    def distinct_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            keep = []
            for x in b["text"].to_pylist():
                h = hash(x)
                keep.append(h not in seen)
                seen.add(h)
            yield pa.record_batch([b["text"].filter(pa.array(keep, pa.bool_()))], names=["text"])

    texts = df.select(F.col(text_col).alias("text")).where("text is not null and text <> ''").mapInArrow(distinct_here, one)
    ranged = texts.repartitionByRange(F.substring("text", 1, 64)).sortWithinPartitions("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = first = None
        names = ["seam", "text", "last"]
        for b in batches:
            if not b.num_rows:
                continue
            t = b["text"].to_pylist()
            first = t[0] if first is None else first
            both = t if held is None else [held, *t]
            short = [x for x, y in zip(both, both[1:]) if x != y and is_shortened(x, y)]
            short += [y for x, y in zip(both, both[1:]) if x != y and is_shortened(y, x)]
            held = both[-1]
            yield pa.record_batch([pa.nulls(len(short), pa.int32()), pa.array(short, pa.string()), pa.nulls(len(short), pa.string())], names=names)
        if held is not None:
            yield pa.record_batch([pa.array([1], pa.int32()), pa.array([first]), pa.array([held])], names=names)

    rows = written(ranged.mapInArrow(run, "seam int, text string, last string"), "shortened")
    # a seam is one row for each range; the next range's first text follows this one's last
    seams = rows.where("seam = 1").select(F.col("last"), F.lead("text").over(Window.orderBy("text")).alias("next")).where("next is not null and next <> last")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = list(zip(b["last"].to_pylist(), b["next"].to_pylist()))
            yield pa.record_batch([pa.array([x for x, y in both if is_shortened(x, y)] + [y for x, y in both if is_shortened(y, x)], pa.string())], names=["text"])

    return rows.where("seam is null").select("text").unionByName(seams.mapInArrow(close, one)).select(F.xxhash64("text").alias("text_hash")).distinct()


def length_spikes(df: DataFrame, length_col: str, times: float = 6.0, around: int = 12) -> DataFrame:
    """(length): lengths in code points that more texts have than their surroundings explain, as a limit leaves: `times`
    deviations above the mean of the `around` lengths on both sides. The window runs over a row for each length."""
    by = df.select(F.col(length_col).alias("length")).where("length > 0").groupBy("length").count()
    near = Window.orderBy("length").rangeBetween(-around, around)
    usual = (F.sum("count").over(near) - F.col("count")) / (2 * around)
    return by.withColumn("usual", usual).where(F.col("count") > F.col("usual") + times * F.sqrt(F.greatest("usual", F.lit(0.5)))).select("length")


def evidenced_answers(df: DataFrame, keys: list[str], answer: str = "answer", prompt: str = "prompt") -> DataFrame:
    """keys + (defect, evidence): one row for each defective answer, with exactly one defect. evidence, of truncated
    answers only: shortened (a neighbour in the order of texts goes on), limit (a length that a limit leaves) or
    context (its last words stand inside texts, as in problem 1), the first that holds.

    Order of rules: empty, refusal, other_language, copy, truncated. Neighbours and lengths decide unless the last words
    are known to finish texts. A null answer is empty. A null or blank prompt can be neither copied nor differ in
    language. Repeated rows each get their own. An empty table gives no rows. Columns besides keys, answer and prompt
    are ignored."""
    base = df.select(*keys, F.col(answer).alias("_answer"), F.col(prompt).alias("_prompt"))
    x = with_content(base, "_answer", "_content")
    x = x.withColumn("_to", compared(F.coalesce("_content", F.lit("")), F.coalesce("_prompt", F.lit(""))))
    to = lambda name: F.col(f"_to.{name}")
    says, short = declines(F.col("_content"))
    refusal = says & (short | ((to("prompt_size") > 0) & (to("share") < REFUSAL_SHARE)))
    other = F.coalesce(to("answer_language") != to("prompt_language"), F.lit(False))
    rule = F.when(is_empty(F.col("_answer"), F.coalesce(to("brief"), F.lit("-"))), "empty").when(refusal, "refusal").when(other, "other_language").when(copies(to("size"), to("share"), to("begins")), "copy")
    x = T.pinned(x, "_rule", rule).select(*keys, "_answer", "_rule", F.length("_answer").alias("_length"), F.xxhash64("_answer").alias("_hash"))
    judged = written(T.judged(T.ends(x, "_answer"), written(T.counted(base.where("_answer is not null"), "_answer"), "contexts")).select(*keys, "_rule", "_length", "_hash", "cut", "share", F.coalesce(F.col("word").rlike(r"[.!?。]$"), F.lit(False)).alias("_stop")), "judged")
    short = shortened_versions(base, "_answer").withColumnRenamed("text_hash", "_hash").withColumn("_short", F.lit(True))
    spikes = length_spikes(judged, "_length").withColumnRenamed("length", "_length").withColumn("_spike", F.lit(True))
    left = judged.where("_rule is null").join(short, "_hash", "left").join(F.broadcast(spikes), "_length", "left")  # at most a row for each length
    open_end = F.col("cut") | (~F.col("_stop") & (F.coalesce("share", F.lit(0.0)) < FIRM_SHARE))
    evidence = F.when(F.col("_short") & open_end, "shortened").when(F.col("_spike") & open_end, "limit").when(F.col("cut"), "context")
    cut = left.withColumn("evidence", evidence).where("evidence is not null").select(*keys, F.lit("truncated").alias("defect"), "evidence")
    return judged.where("_rule is not null").select(*keys, F.col("_rule").alias("defect"), F.lit(None).cast("string").alias("evidence")).unionByName(cut)


def defective_answers(df: DataFrame, keys: list[str], answer: str = "answer", prompt: str = "prompt") -> DataFrame:
    """keys + (defect): evidenced_answers() without the evidence."""
    return evidenced_answers(df, keys, answer, prompt).drop("evidence")
