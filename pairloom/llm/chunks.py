"""Content-defined chunks as tokens: postings, a global rarity order, and exact prefix filtering.

A text is folded (spacing, punctuation, case and Unicode form ignored) and cut where a rolling hash
says so, hence an edit changes only the chunks around it. Two texts are candidates when the chunks they share
are at least `loose` of the longer one's, by number and by weight; their words are then compared
(`confirmed`). Set phrases, which unrelated texts share, weigh little. Order the chunks of every text from rare
to frequent: a candidate pair must then share a chunk within the first (1 - loose) of each text's weight, its
`prefix`. Only prefixes are joined. This holds for any common order, so no pair is lost.

A prefix row has a fixed size, whatever the length of its text: a chunk, the text's hash and sizes, and a
bitmap of its shared chunks that bounds its overlap with any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.llm import kernels as K
from pairloom.llm.store import written

#: Mean chunk length in letters and digits: short enough that chunks survive between edits of every fourth word, long
#: enough that most are no set phrases.
MEAN = 11
#: Least share of common chunks at which two texts are compared word by word. Texts with a quarter of their words
#: edited at random places share 0.36 in the middle case and 0.20 or less in 2.5 of 100 (with 15 % edited, in 0.05 of
#: 100); 99.9 % of unrelated pairs share less than 0.13.
LOOSE = 0.2
#: Least share of the words, or else of the letter trigrams, which don't depend on spacing, that near-same texts have in
#: common: a quarter of edited words spoils 1 - 0.75 ** 1.6 of the trigrams.
WORDS, TRIGRAMS = 0.75, 0.58
#: Up to so many text hashes (8 bytes each) are broadcast; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Planning sample: it only decides which chunks are counted without a shuffle, never which pairs are found.
SAMPLE_TEXTS, HOT_IN_SAMPLE = 4000, 10
#: A chunk of more than one in PHRASE_SHARE texts, and of more than LEAST_PHRASE, is a set phrase. It weighs 1, as does a
#: chunk that no other text has; others weigh INFORMS.
PHRASE_SHARE, LEAST_PHRASE, INFORMS = 1000, 100, 8
#: Bits of a text's signature, many for its 40 chunks or so, since a bound on what two texts share allows for collisions.
BITS = 4096
#: 64-bit words of a folded signature, which is looked at first.
THIN = 8
#: Rows of a key that one task takes; more are split.
PART = 16_384
MEMBERS = "field string, side int, id bigint, text_hash bigint"
#: what: 2 * the chunk's length + the text's side. A text's own row has a negative what, -1 - (2 * number of chunks +
#: side), and its letters and words (32 bits each) as digest.
POSTINGS = "digest bigint, doc bigint, what bigint"
PREFIX = "digest bigint, df int, doc bigint, side int, n int, shared int, letters int, words int"


def field_salt(field: str) -> np.int64:
    """Digests of different fields never meet."""
    return K.text_hash(*K.pack([field]))[0]


def _salts(fields: list[str]) -> np.ndarray:
    salt = {f: field_salt(f) for f in set(fields)}
    return np.array([salt[f] for f in fields], np.int64).reshape(-1)


def long_form(df: DataFrame, id_col: str, fields: list[str], side: str = "0") -> DataFrame:
    """(field, side, id, text), one row for each text."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("text")) for f in fields])
    return df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.expr(side).cast("int").alias("side"), F.explode(parts).alias("_x")).select("_x.field", "side", "id", "_x.text").where("id is not null and side is not null and text is not null")


def in_scope(texts: list[str], least_words: int) -> np.ndarray:
    return np.array([len(t.split()) >= least_words for t in texts], bool)


def members(texts: DataFrame, least_words: int) -> DataFrame:
    """Which row holds which text: (field, side, id, text_hash) of the texts in scope."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b["text"].to_pylist()
            keep = in_scope(raw, least_words)
            h = K.text_hash(*K.folded(raw)) ^ _salts(b["field"].to_pylist())
            mask = pa.array(keep)
            yield pa.record_batch([b["field"].filter(mask), b["side"].filter(mask), b["id"].filter(mask), pa.array(h[keep])], names=["field", "side", "id", "text_hash"])

    return texts.mapInArrow(run, MEMBERS)


def chunked(raw: list[str], fields: list[str], mean: int):
    """(hash, letters, words) of each text of a batch, and (text, digest, length) of its chunks. Chunks that recur in
    a text are numbered, so each is a token of its own."""
    salts = _salts(fields)
    codes, offsets, begins = K.folded_words(raw)
    h = K.text_hash(codes, offsets) ^ salts
    words = np.bincount(K.owners(offsets, begins), minlength=len(raw)) if len(begins) else np.zeros(len(raw), np.int64)
    text, digest, length = K.content_chunks(codes, offsets, mean)
    return h, np.diff(offsets), words, text, K.numbered(text, digest) ^ salts[text], length


def postings(texts: DataFrame, least_words: int, mean: int) -> DataFrame:
    """A row for each chunk of each distinct text, and one for the text itself. Copies of a text are dropped within
    a task already, so a text adds at most one set of rows for each task, however often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            keep = pa.array(in_scope(b["text"].to_pylist(), least_words))
            raw, fields, side = (b[c].filter(keep).to_pylist() for c in ("text", "field", "side"))
            h, letters, words, text, digest, length = chunked(raw, fields, mean)
            new = np.zeros(len(raw), bool)
            for i, key in enumerate(zip(h.tolist(), side)):
                if key not in seen:
                    seen.add(key)
                    new[i] = True
            n, side = np.bincount(text, minlength=len(raw)), np.array(side, np.int64).reshape(-1)
            use = new[text] if len(text) else np.zeros(0, bool)
            text, digest, length = text[use], digest[use], length[use]
            own = np.flatnonzero(new & (n > 0))
            yield pa.record_batch([pa.array(np.r_[digest, letters[own] << 32 | words[own]]), pa.array(np.r_[h[text], h[own]]), pa.array(np.r_[length << 1 | side[text], -1 - (n[own] << 1 | side[own])])], names=["digest", "doc", "what"])

    return texts.mapInArrow(run, POSTINGS)


def frequent_chunks(texts: DataFrame, least_words: int, mean: int) -> tuple[DataFrame, int]:
    """((digest, hot_df), texts): chunks that a sample of about SAMPLE_TEXTS texts holds HOT_IN_SAMPLE times or more,
    with the exact number of texts that hold them, and the number of texts. The list is bounded by the sample,
    whatever the input."""
    n = texts.count()
    share = min(1.0, SAMPLE_TEXTS / max(n, 1))
    counted = lambda x: postings(x, least_words, mean).where("what >= 0").groupBy("digest").count()
    found = [(r["digest"], r["count"]) for r in counted(texts.sample(False, share, 7) if share < 1 else texts).where(F.col("count") >= HOT_IN_SAMPLE).collect()]
    spark: SparkSession = texts.sparkSession
    if share < 1:
        rows = postings(texts, least_words, mean).where("what >= 0").join(F.broadcast(spark.createDataFrame([(d,) for d, _ in found], "digest bigint")), "digest")
        found = [(r["digest"], r["count"]) for r in rows.groupBy("digest").count().collect()]
    return spark.createDataFrame(found, "digest bigint, hot_df bigint"), n


def ranked(texts: DataFrame, least_words: int, mean: int, across: bool = False) -> tuple[DataFrame, int]:
    """(postings, phrase): postings with the number of texts that hold the chunk (df), without those of a single
    text, or, across, of a single side; texts' own rows stay. A chunk of more than `phrase` texts is a set phrase.

    Frequent chunks are counted without a shuffle of their rows by key; among the rest, no key has more than about
    HOT_IN_SAMPLE / SAMPLE_TEXTS of all texts, so counting in a window is even."""
    hot, n = frequent_chunks(texts, least_words, mean)
    tagged = postings(texts, least_words, mean).join(F.broadcast(hot), "digest", "left")
    own = F.col("what") < 0
    # the rows of a hot chunk, and texts' own, are spread by text, the others meet by chunk
    key = F.when(F.col("hot_df").isNotNull() | own, F.col("doc")).otherwise(F.col("digest"))
    meet = Window.partitionBy("key")
    counted = tagged.withColumn("key", key).withColumn("df", F.coalesce("hot_df", F.count(F.lit(1)).over(meet)).cast("int"))
    side = F.col("what").bitwiseAND(F.lit(1))
    alone = F.min(side).over(meet) == F.max(side).over(meet) if across else F.col("df") < 2
    kept = counted.withColumn("alone", alone).where(own | F.col("hot_df").isNotNull() | ~F.col("alone"))
    return kept.select("digest", "doc", "what", "df"), max(LEAST_PHRASE, n // PHRASE_SHARE)


def whole_groups(batches: Iterator[pa.RecordBatch], key: list[str], least: int = 200_000) -> Iterator[pa.Table]:
    """Sorted batches, joined and cut so that no group of equal keys is split."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(held)
        changed = np.zeros(t.num_rows, bool)
        for k in key:
            x = t[k].to_numpy()
            changed[1:] |= x[1:] != x[:-1]
        at = np.flatnonzero(changed)
        if len(at):
            yield t.slice(0, at[-1])
            t = t.slice(at[-1])
        held, rows = t.combine_chunks().to_batches(), t.num_rows
    if held:
        yield pa.Table.from_batches(held)


def signatures(text: np.ndarray, digest: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, place): a bitmap of BITS bits of the digests of each of n texts, as the places of its bits, so at most
    BITS of them."""
    bit = (K.mix(digest.view(np.uint64)) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
    both = np.unique(text * BITS + bit)
    return np.searchsorted(both, np.arange(n + 1) * BITS), (both % BITS).astype(np.int16)


def gap_coded(begin: np.ndarray, place: np.ndarray) -> pa.Array:
    """Signatures as bytes: the gaps between places, each as bytes that add up to it, 255 as often as it fits."""
    gap = np.diff(place.astype(np.int64), prepend=0)
    first = begin[:-1][np.diff(begin) > 0]
    gap[first] = place[first]
    ends = np.cumsum(gap // 255 + 1)
    out = np.full(ends[-1] if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = gap % 255
    offsets = np.r_[0, ends][begin].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def gap_decoded(signed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(begin, place) of gap-coded signatures."""
    offsets = np.frombuffer(signed.buffers()[1], np.int32)[signed.offset : signed.offset + len(signed) + 1].astype(np.int64)
    data = np.frombuffer(signed.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    add = np.r_[0, np.cumsum(data, dtype=np.int64)]
    row = np.repeat(np.arange(len(signed)), np.diff(offsets))
    real = data < 255
    return np.r_[0, np.cumsum(real)][offsets], (add[1:] - add[offsets[:-1]][row])[real]


def bitmaps(begin: np.ndarray, place: np.ndarray, fold: int = 1) -> np.ndarray:
    """Signatures as rows of 64-bit words, folded to BITS / fold bits."""
    out = np.zeros((len(begin) - 1, BITS // fold // 8), np.uint8)
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    place = place.astype(np.int64) % (BITS // fold)
    np.bitwise_or.at(out, (row, place >> 3), (1 << (place & 7)).astype(np.uint8))
    return out.view(np.uint64)


def prefixes(rows: DataFrame, phrase: int, loose: float, longs: bool = False) -> DataFrame:
    """A row for each shared chunk in the prefix of each text, by weight. Signatures are gap-coded; with longs, they are arrays of
    places, and folded ones are given as THIN numbers, for use in expressions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["doc"]):
            doc, what, digest, df = (t[c].to_numpy() for c in ("doc", "what", "digest", "df"))
            own = what < 0
            side = np.where(own, -1 - what, what) & 1
            start = np.r_[True, (doc[1:] != doc[:-1]) | (side[1:] != side[:-1])]
            text = np.cumsum(start) - 1
            at = np.flatnonzero(start)  # a text's own row comes first
            n, letters, words = (-1 - what[at]) >> 1, digest[at] >> 32, digest[at] & 0xFFFFFFFF
            use = ~own & np.r_[True, (digest[1:] != digest[:-1]) | start[1:]]  # the same text from two tasks
            text, digest, df = text[use], digest[use], df[use]
            size = np.bincount(text, minlength=len(at))
            weight = np.where(df > phrase, 1, INFORMS)
            rest = np.cumsum(weight[::-1])[::-1]  # from a row on
            ends = np.r_[rest, 0][np.cumsum(size)]
            total = n - size + np.bincount(text, weight, len(at))
            take = np.flatnonzero(rest - ends[text] >= loose * total[text])
            begin, place = signatures(text, digest, len(at))
            signed = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(place)) if longs else gap_coded(begin, place)
            thin = [bitmaps(begin, place, BITS // 64 // THIN).view(np.int64)] if longs else []
            for a in range(0, len(take), 50_000):
                u = take[a : a + 50_000]
                x = text[u]
                cols = [pa.array(digest[u]), pa.array(df[u]), pa.array(doc[at[x]]), *(pa.array(v[x].astype(np.int32)) for v in (side[at], n, size, letters, words)), signed.take(pa.array(x))]
                cols += [pa.array(w[x, i]) for w in thin for i in range(THIN)]
                yield pa.record_batch(cols, names=[c.split()[0] for c in schema.split(", ")])

    schema = PREFIX + (", bits array<smallint>" + "".join(f", w{i} bigint" for i in range(THIN)) if longs else ", bits binary")
    what = F.col("what")
    side = F.when(what < 0, -1 - what).otherwise(what).bitwiseAND(F.lit(1))
    return rows.repartition("doc").sortWithinPartitions("doc", side, what >= 0, "df", "digest").mapInArrow(run, schema)


def parts(size: int) -> Column:
    """In how many parts of about `size` rows a chunk's rows are to be split."""
    return F.greatest(F.lit(1), F.ceil(F.col("df") / size)).cast("int")


def met(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left joined with right, the rows of a key that left has more than PART of split over tasks."""
    many = left.groupBy(key).count().where(F.col("count") > PART).select(key, F.ceil(F.col("count") / PART).cast("int").alias("_parts"))
    n = F.coalesce("_parts", F.lit(1))
    a = left.join(many, key, "left").withColumn("_part", F.pmod(F.xxhash64(*left.columns), n).cast("int")).drop("_parts")
    b = right.join(many, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), n - 1))).drop("_parts")
    return a.join(b, [key, "_part"]).drop("_part")


def near_same(a: list[str], b: list[str]) -> np.ndarray:
    """For each pair whether all but a quarter of the words are common to both texts, wherever they stand."""
    texts = list(dict.fromkeys([*a, *b]))
    place = {t: i for i, t in enumerate(texts)}
    x, y = (np.array([place[t] for t in side], np.int64).reshape(-1) for side in (a, b))
    codes, offsets, begins = K.folded_words(texts)
    out = np.zeros(len(x), bool)
    if not len(codes):
        return out
    owner = K.owners(offsets, begins)
    word = K.numbered(owner, K.text_hash(codes, np.r_[begins, len(codes)]))
    n = np.bincount(owner, minlength=len(texts))
    out = K.common(owner, word, len(texts), x, y) >= np.maximum(WORDS * np.maximum(n[x], n[y]), 1)
    rest = np.flatnonzero(~out & (np.minimum(*(np.diff(offsets)[i] for i in (x, y))) > 2))
    if len(rest):
        at = np.arange(max(len(codes) - 2, 0))
        owner = K.owners(offsets, at)
        inside = at + 2 < offsets[owner + 1]
        some = np.zeros(len(texts), bool)
        some[x[rest]] = some[y[rest]] = True
        inside &= some[owner]
        owner, three = owner[inside], K.windows_hash(codes, 3).view(np.int64)[inside]
        n = np.diff(offsets) - 2
        out[rest] = K.common(owner, K.numbered(owner, three), len(texts), x[rest], y[rest]) >= TRIGRAMS * np.maximum(n[x[rest]], n[y[rest]])
    return out


def bodies(texts: DataFrame, least_words: int, docs: DataFrame) -> DataFrame:
    """(text_hash, text) of the texts in docs (doc)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array(in_scope(b["text"].to_pylist(), least_words))
            raw = b["text"].filter(keep)
            h = K.text_hash(*K.folded(raw.to_pylist())) ^ _salts(b["field"].filter(keep).to_pylist())
            yield pa.record_batch([pa.array(h), raw], names=["text_hash", "text"])

    wanted = docs.withColumnRenamed("doc", "text_hash")
    small = wanted.count() <= BROADCAST_ROWS
    found = texts.select("field", "text").mapInArrow(run, "text_hash bigint, text string").join(F.broadcast(wanted) if small else wanted, "text_hash", "left_semi")
    return written(found.groupBy("text_hash").agg(F.min("text").alias("text")), "bodies")


def confirmed(candidates: DataFrame, texts: DataFrame, least_words: int) -> DataFrame:
    """Candidates (doc_a, doc_b) whose words are nearly the same, written."""
    found = written(candidates, "candidates")
    docs = written(found.select(F.explode(F.array("doc_a", "doc_b")).alias("doc")).distinct(), "docs")
    text = bodies(texts, least_words, docs)
    a, b = (text.select(F.col("text_hash").alias(f"doc_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for at in range(0, x.num_rows, 2_000):
                y = x.slice(at, 2_000)
                keep = pa.array(near_same(y["text_a"].to_pylist(), y["text_b"].to_pylist()))
                yield pa.record_batch([y["doc_a"].filter(keep), y["doc_b"].filter(keep)], names=["doc_a", "doc_b"])

    both = found.join(a, "doc_a").join(b, "doc_b").select("doc_a", "doc_b", "text_a", "text_b")
    return written(both.mapInArrow(run, "doc_a bigint, doc_b bigint"), "links")
