"""Text measures as Spark expressions. Patterns with Unicode blanks use (?U)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the measures look for.
QUOTED = r"[“‘\"]([^”’\"]{5,})[”’\"]"
MARKDOWN = r"(?m)\*\*|^#{1,4}\s|^\s*[-*•]\s"
CONTAMINATION = r"(?i)(^|\n)\s*(#{1,6}\s*)?(분석 결과|자연도 등급|주요 변경 사항|의미 보존 검증)"
NUMBER = r"(?U)\d+(?:[.,]\d+)*\s*(?:%|퍼센트|명|건|개|년|월|일|시간|배|원|억|만|천)?"
NEGATION = r"않|못하|못한|없|아니|불가|미흡|비유의"
DIRECTIONS = {"증가": "증가|늘어|상승|높아|많아", "감소": "감소|줄어|하락|낮아|적어", "유의": "유의(?!하지|하지 않)", "비유의": "유의하지 않|유의미하지 않|비유의", "정적": r"정\(\+\)|정적 (?:상관|영향)|양(?:\(\+\)|의 상관)", "부적": r"부\(-\)|부적 (?:상관|영향)|음(?:\(-\)|의 상관)"}
TITLE_LINE = r"^\s*(?:(?:제목|Title|(?:다듬은|수정된|편집된|정리한)\s*(?:본문|글|텍스트)|Polished(?:\s+text)?)\s*[:：]\s*|(?:제목|Title)\s*[:：][^\n]*)(?:\n|$)"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeezed(c: Column) -> Column:
    """Without any blank."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def quote_ratio(c: Column) -> Column:
    """Share of a text inside quotations of five characters or more; 0 for an empty text."""
    inside = F.aggregate(F.regexp_extract_all(c, F.lit(QUOTED), F.lit(1)), F.lit(0), lambda a, q: a + F.length(q))
    return F.when(F.length(c) > 0, inside / F.length(c)).otherwise(F.lit(0.0))


def digit_density(c: Column) -> Column:
    """ASCII digits for 1,000 characters."""
    return F.regexp_count(c, F.lit("[0-9]")) / F.greatest(F.length(c), F.lit(1)) * 1000


def hangul_share(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[가-힣]")) / F.greatest(F.length(c), F.lit(1))


def has_markdown(c: Column) -> Column:
    return c.rlike(MARKDOWN)


def cleaned_output(c: Column) -> Column:
    """A model's answer without reasoning blocks and without a first line that is a label or a title."""
    t = stripped(F.regexp_replace(c, r"(?s)<think>.*?</think>\s*", ""))
    return stripped(F.regexp_replace(t, TITLE_LINE, ""))


def without_speakers(c: Column) -> Column:
    """Dialogue lines without their A: and B: marks."""
    return F.regexp_replace(c, r"(?m)^[ \t]*[AB][ \t]*[:：]+[ \t]*", "")


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?U)(?<=[.!?])\s+"), stripped), lambda x: x != "")


def word_grams(w: Column, n: int) -> Column:
    last = F.size(w) - (n - 1)
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))


def repeated_gram_share(w: Column, n: int) -> Column:
    """1 - distinct / all word n-grams; 0 without any."""
    g = word_grams(w, n)
    return F.when(F.size(g) > 0, 1 - F.size(F.array_distinct(g)) / F.size(g)).otherwise(F.lit(0.0))


def char_grams(c: Column, n: int) -> Column:
    return F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def copied_gram_share(a: Column, b: Column, n: int = 12) -> Column:
    """Percent of a's distinct n-grams, blanks left out, that b has."""
    x, y = F.array_distinct(char_grams(squeezed(a), n)), F.array_distinct(char_grams(squeezed(b), n))
    return F.when(F.size(x) > 0, 100.0 * F.size(F.array_intersect(x, y)) / F.size(x)).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dialogue_repaired(c: Column) -> Column:
    """Blank lines dropped; an unmarked first line before a B line gets an A mark."""
    lines = F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")
    need = (F.size(lines) > 1) & ~F.get(lines, F.lit(0)).rlike(r"^\s*[AB]\s*[:：]") & F.get(lines, F.lit(1)).rlike(r"^\s*B\s*[:：]")
    return F.when(need, F.concat(F.lit("A: "), F.array_join(lines, "\n"))).otherwise(F.array_join(lines, "\n"))


def dialogue_fault(c: Column, turns: Column) -> Column:
    """unmarked, count or alternation: the first rule that a dialogue breaks; else null."""
    lines = F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")
    who = F.transform(lines, lambda x: F.regexp_extract(x, r"^\s*([AB])\s*[:：]", 1))
    same = F.exists(F.sequence(F.lit(0), F.greatest(F.size(who) - 2, F.lit(0))), lambda i: F.get(who, i) == F.get(who, i + 1))
    return F.when(F.exists(who, lambda x: x == ""), "unmarked").when(F.size(who) != turns, "count").when(same, "alternation")


def number_tokens(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(f"({NUMBER})"), F.lit(1)), squeezed)


def multiset_surplus(a: Column, b: Column) -> Column:
    """How many items a holds beyond those that b holds, each counted as often as it occurs."""
    times = lambda xs, v: F.size(F.filter(xs, lambda x: x == v))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, v: s + F.greatest(F.lit(0), times(a, v) - times(b, v)))


def directions_lost(a: Column, b: Column) -> Column:
    """Names of the directions that a states and b doesn't."""
    return F.array_compact(F.array(*[F.when(a.rlike(p) & ~b.rlike(p), F.lit(k)) for k, p in DIRECTIONS.items()]))


def style_sentences(c: Column) -> Column:
    """Sentences, cut also after a 다."""
    return F.filter(F.split(F.regexp_replace(stripped(c), r"(?U)(?<=[.!?다])\s+", "\u0001"), "\u0001"), lambda x: x != "")


def style_features(c: Column) -> dict[str, Column]:
    """The style features that need no tagger, for 1,000 characters or in characters."""
    n, s = F.greatest(F.length(c), F.lit(1)), F.greatest(F.size(style_sentences(c)), F.lit(1))
    times = lambda w: F.regexp_count(c, F.lit(w))
    return {"ttohan": times("또한") / n * 1000, "geosida": (times("것이다") + times("것으로")) / n * 1000, "sentences": s / n * 1000, "sentence_chars": n / s}


def filled(template: str, **values: Column) -> Column:
    """A template with {names} replaced by columns."""
    out = F.lit(template)
    for name, v in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), v)
    return out


def token_budget(target: Column, ratio: float) -> Column:
    return F.floor(target * F.lit(ratio)).cast("int")


def attempt_seed(seed: int, i: Column, attempt: Column) -> Column:
    return F.lit(seed) + i + 1000 * attempt


def member_digest(df: DataFrame, group: str, name: str, content: str) -> DataFrame:
    """group + (digest): sha256 over the members' names and digests, in the order of names. Only digests are
    gathered, 80 bytes a member."""
    member = F.struct(F.col(name).alias("k"), F.concat(F.col(name).cast("string"), F.lit(":"), F.sha2(F.col(content).cast("binary"), 256)).alias("v"))
    lines = F.transform(F.array_sort(F.collect_list(member)), lambda x: x["v"])
    return df.groupBy(group).agg(F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("digest"))


def parsed_number(c: Column) -> Column:
    """"1,985", "−1.26%p" and the like as doubles; null where there is no number."""
    t = F.regexp_replace(F.regexp_replace(stripped(c), "[−–]", "-"), r"[,\s]|%p?$", "")
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), t.cast("double"))


def html_escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def plain_lines(c: Column) -> Column:
    """Line ends as \\n."""
    return F.regexp_replace(c, "\r\n?", "\n")
