"""Problem 1: texts that stop before they are finished. Built-in expressions only.

The last words of a complete text stand at many texts' ends; the last words of one that was cut stand
inside many texts, but at hardly any end. So words and word trigrams are counted inside all texts and at
all ends (numbers as 0), and each text's final ones are looked up. A text may also be cut within a word: its
last word then is a beginning of others, so words count inside for each of their beginnings, too. Contexts
too rare to tell lean on the shorter ones: three words on one, one word on the last character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.store import written

#: Ends of complete texts make up a few percent of a context's occurrences, cuts less than a thousandth.
TERMINAL_SHARE = 0.010
#: Up to here an end is doubtful.
DOUBTFUL_SHARE = 0.020
#: Occurrences inside from which a trigram tells more than its last word, and a word with a full stop is known to end
#: sentences. Rarer trigrams lean on the word alone: two cuts at one place would make them look terminal.
KNOWN = 20
#: A shorter context weighs as much as so many occurrences of the longer one.
PRIOR = 100.0
#: A word's beginnings up to this length are counted, since all beginnings of one grow with its square. Words
#: themselves are never shortened.
LONGEST_BEGINNING = 100
#: Characters at a text's end that are looked at first. Where they don't hold four words, the whole text is.
TAIL = 400
# Marks put in place of a text's rest.
MARKS = r"(?:[(\[<【〔]\s*(?:이하\s*)?(?:생략|중략|하략|계속|더보기|더 보기|전문 보기|truncated|continued|more|\.\.\.|…)\s*[)\]>】〕]|\.{2,}|…+)"


def composed(text: Column) -> Column:
    """Conjoining Hangul letters as syllables (NFC for Korean)."""
    piece = F.regexp_extract_all(text, F.lit(r"([ᄀ-ᄒ][ᅡ-ᅵ][ᆨ-ᇂ]?|(?s:.))"), F.lit(1))

    def syllable(p: Column) -> Column:
        code = lambda i: F.ascii(F.substring(p, i, 1))
        number = F.lit(0xAC00) + ((code(1) - 0x1100) * 21 + code(2) - 0x1161) * 28 + F.when(F.length(p) > 2, code(3) - 0x11A7).otherwise(0)
        return F.when(p.rlike("^[ᄀ-ᄒ][ᅡ-ᅵ]"), F.decode(F.unhex(F.lpad(F.hex(number), 4, "0")), "UTF-16BE")).otherwise(p)

    return F.when(text.rlike("[ᄀ-ᄒ][ᅡ-ᅵ]"), F.array_join(F.transform(piece, syllable), "")).otherwise(text)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[\s​﻿]+$", "")


def tail(text: Column) -> Column:
    """The end of a text, with its last three words whole, where marks and its last words are looked for."""
    t = F.right(text, F.lit(TAIL))
    return F.when(t.rlike(r"(?U)^\s*+\S*+\s++\S++\s++\S++\s++\S"), t).otherwise(text)


def end_body(end: Column) -> Column:
    """A text's end up to a mark that stands for the rest, without what layout puts around the last stop."""
    t = F.regexp_replace(trimmed(end), rf"(?iU)(?:\s*{MARKS})+$", "")
    t = F.regexp_replace(t, r"(?U)\s*```\s*$", "")
    return F.regexp_replace(t, r"(?U)\s+([.!?。])\s*\"?$|(?<=[.!?。])\s*\"$", "$1")


def body(text: Column) -> Column:
    """The whole text, its end as in end_body."""
    return F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(tail(text))), end_body(tail(text)))


def pinned(df: DataFrame, name: str, col: Column) -> DataFrame:
    """df with a column that is evaluated once for each row, however often it is used later: exploding an
    array of one keeps the optimizer from putting the expression in each place of its use."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(col)).alias(name))


def with_words(df: DataFrame, text: str, name: str = "w") -> DataFrame:
    """df with a text column replaced by its words; numbers are 0, tags #, and each ideograph or kana a word. What
    is rare is looked for first, as a search costs less than a replacement."""
    t = F.col(text)
    x = pinned(df, text, F.when(F.contains(t, F.lit("#")), F.regexp_replace(t, r"#\S+", "#")).otherwise(t))
    x = pinned(x, text, F.replace(F.regexp_replace(t, r"[0-9０-９]+(?:[.,][0-9０-９]+)*", "0"), F.lit("\n"), F.lit(" ")))
    odd = r"[一-鿿぀-ヿ\t\r\f\x0b\u0085\u00a0\u2000-\u200a\u2028-\u3000]"
    x = pinned(x, text, F.when(t.rlike(odd), F.regexp_replace(t, r"(?U)([一-鿿぀-ヿ。、，])|\s+", " $1 ")).otherwise(t))
    return pinned(x, name, F.filter(F.split(t, " "), lambda w: w != "")).drop(text)


def trigram(w: Column, i: Column) -> Column:
    """The last three characters of three words: in Korean, they tell a word's role."""
    last = lambda k: F.right(F.get(w, i - k), F.lit(3))
    return F.concat_ws(" ", last(2), last(1), last(0))


def cut_character(text: Column) -> Column:
    """The end lies within a character, as a replacement character or a letter that needs another, or
    right after a mark that nothing can end with."""
    return text.rlike(r"([,，、(\[{“‘]|�|[ᄀ-ᄒ]|&(?:#\d*|[a-z]{1,4})?|\\u[0-9a-f]{0,3})$") & ~text.rlike(r"\s&$")


def open_quotation(text: Column) -> Column:
    """The last quotation isn't closed, however long ago it was opened, and no sentence ends within it."""
    last = F.substring_index(text, "“", -1)
    # the end is looked at where the quotation is open, which is rare
    still = F.contains(text, F.lit("“")) & ~F.contains(last, F.lit("”"))
    return F.when(still, ~end_body(last).rlike(r"。|[.!?](?:\s|$)")).otherwise(F.lit(False))


def counted(texts: DataFrame, text_col: str) -> DataFrame:
    """(kind, context, inside, ending): words (kind 1) and trigrams (kind 3) inside texts and at their ends."""
    x = pinned(texts.select(F.col(text_col).alias("t")), "t", composed(F.col("t")))
    x = with_words(pinned(x, "t", body(F.col("t"))), "t").where(F.size("w") > 0)
    rows = x.select("w", F.posexplode("w").alias("i", "word"))
    rows = rows.select("word", trigram(F.col("w"), F.col("i")).alias("three"), (F.col("i") == F.size("w") - 1).cast("bigint").alias("last"))
    both = rows.groupingSets([[F.col("word")], [F.col("three")]], F.col("word"), F.col("three"))
    out = both.agg(F.grouping("word").alias("g"), F.sum(1 - F.col("last")).alias("inside"), F.sum("last").alias("ending"))
    return out.select(F.when(F.col("g") == 1, 3).otherwise(1).cast("byte").alias("kind"), F.coalesce("word", "three").alias("context"), "inside", "ending")


def beginnings(vocabulary: DataFrame) -> DataFrame:
    """(context, longer): how often, inside texts, a longer word begins so. Stops after a word don't make it longer."""
    core = F.regexp_replace("context", r"[.!?~…,\"”’。]+$", "")
    one = vocabulary.where("inside > 0").select(core.alias("w"), "inside").groupBy("w").agg(F.sum("inside").alias("inside")).where(F.length("w") > 1)
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("w") - 1, F.lit(LONGEST_BEGINNING))), lambda i: F.substring(F.col("w"), F.lit(1), i)))
    return one.select(cut.alias("context"), "inside").groupBy("context").agg(F.sum("inside").alias("longer"))


def verdicts(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((word, word_share), (trigram, inside, ending)) of the words and trigrams that end a text. The share is that
    of ends among all occurrences, with one's own left out."""
    vocabulary = written(counts.where("kind = 1").drop("kind"), "vocabulary")
    begun = written(beginnings(vocabulary), "beginnings")
    last = lambda c: F.right(F.col(c), F.lit(1))
    ends = vocabulary.groupBy(last("context").alias("c0")).agg(F.sum("inside").alias("in0"), F.sum("ending").alias("end0")).where("end0 > 0")
    goes_on = begun.groupBy(last("context").alias("c0")).agg(F.sum("longer").alias("on0"))
    # one row for each character that ends a text: no more than there are characters
    c0 = ends.join(goes_on, "c0", "left").select("c0", ((F.col("end0") - 1) / F.greatest(F.lit(1), F.col("in0") + F.col("end0") - 1 + F.coalesce("on0", F.lit(0)))).alias("share0"))
    x = vocabulary.where("ending > 0").join(begun, "context", "left").withColumn("c0", last("context")).join(F.broadcast(c0), "c0")
    n = F.col("inside") + F.col("ending") - 1 + F.coalesce("longer", F.lit(0))
    word = x.select(F.col("context").alias("word"), F.col("inside").alias("word_in"), ((F.col("ending") - 1 + PRIOR * F.col("share0")) / (n + PRIOR)).alias("word_share"))
    return word, counts.where("kind = 3 and ending > 0").select(F.col("context").alias("trigram"), "inside", "ending")


def ends(rows: DataFrame, text_col: str) -> DataFrame:
    """rows without the text, but with its final contexts and what can be seen at the end itself."""
    x = pinned(rows, "_open", open_quotation(F.col(text_col)))
    x = pinned(x, "_t", tail(F.col(text_col))).drop(text_col)
    x = pinned(x, "_t", composed(F.col("_t")))
    x = pinned(x.withColumn("trails", trimmed(F.col("_t")).rlike(r"(?:\.{2,}|…)$")), "_t", end_body(F.col("_t")))
    x = with_words(x.withColumn("hard", cut_character(F.col("_t")) | F.col("_open")).drop("_open"), "_t", "_w")
    return x.withColumns({"word": F.get("_w", F.size("_w") - 1), "trigram": trigram(F.col("_w"), F.size("_w") - 1)}).drop("_w")


def judged(ended: DataFrame, counts: DataFrame) -> DataFrame:
    """ended + (share, cut, doubtful)."""
    word, three = verdicts(counts)
    # an ellipsis stands in a stop's place: a word that is known to end sentences ends this one
    stopped = word.where(F.col("word").endswith(".") & (F.col("word_in") >= KNOWN)).select(F.expr("substring(word, 1, length(word) - 1)").alias("word"), F.lit(True).alias("trails"), F.col("word_share").alias("stop_share"))
    x = ended.join(word.drop("word_in"), "word", "left").join(three, "trigram", "left").join(stopped, ["word", "trails"], "left")
    smooth = (F.col("ending") - 1 + PRIOR * F.col("word_share")) / (F.col("inside") + F.col("ending") - 1 + PRIOR)
    x = x.withColumn("share", F.coalesce("stop_share", F.when(F.col("inside") >= KNOWN, smooth).otherwise(F.col("word_share"))))
    cut = F.col("hard") | (F.col("share") < TERMINAL_SHARE)
    return x.withColumns({"cut": F.coalesce(cut, F.lit(False)), "doubtful": F.coalesce(~cut & (F.col("share") < DOUBTFUL_SHARE), F.lit(False))}).drop("inside", "ending", "word_share", "stop_share", "trails")


def truncated_rows(rows: DataFrame, keys: list[str], text_col: str, exempt: Column | None = None) -> DataFrame:
    """keys + (cut): whether each row's text stops before it is finished.

    Null texts, blank ones and those that `exempt` holds for (say, empty or refusing answers) are not cut.
    Repeated rows each get their own row. The contexts are counted over all rows; of very few rows the
    last character decides. An empty table gives no rows. Other columns are ignored."""
    kept = rows.select(*keys, F.col(text_col).alias("_text"), F.coalesce(exempt, F.lit(False)).alias("_exempt") if exempt is not None else F.lit(False).alias("_exempt"))
    counts = written(counted(rows.where(F.col(text_col).isNotNull()), text_col), "contexts")
    return judged(ends(kept, "_text"), counts).select(*keys, (F.col("cut") & ~F.col("_exempt") & F.col("word").isNotNull()).alias("cut"))


def truncation_report(judged_rows: DataFrame, by: list[str]) -> DataFrame:
    """by + (n_rows, n_cut, cut_share)."""
    return judged_rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("cut").alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("cut_share"))
