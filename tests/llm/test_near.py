"""Problems 3, 4 and 5 against brute force."""

import itertools
import random
import unicodedata

import numpy as np
import pytest

from pairloom.llm import chunks as C
from pairloom.llm import kernels as K
from pairloom.llm import overlap, signature_tree, spans

from .conftest import edited, sentence, text

SCHEMA = "id long, split string, t string, text_hash string, doc string"


def table(rng):
    rows, n = [], 0
    for g in range(12):
        t = text(rng)
        for c in range(1 + g % 4):
            s = t if c == 1 else edited(rng, t) if c else t
            if c == 3:
                parts = t.split(". ")
                s = ". ".join(parts[5:] + parts[:5]).upper().replace(" ", "  ")
            rows.append((n, ["train", " Test", "DEV ", None][n % 4], s, "x", "y"))
            n += 1
    rows += [(n, "train", None, None, None), (n + 1, "test", "", None, None), (None, "test", rows[0][2], None, None), (n + 2, "dev", "짧은 글이다.", None, None), (n + 3, "train", "짧은 글이다.", None, None)]
    rows.append((n + 4, "train", text(rng, 400), "", ""))
    return rows


def near(s, t):
    """The definition: common chunks, then common words or trigrams."""
    one, two = (C.chunked([x], ["t"], C.MEAN)[4].tolist() for x in (s, t))
    return len(set(one) & set(two)) >= C.LOOSE * max(len(one), len(two)) and bool(C.near_same([s], [t])[0])


def brute(rows):
    """All pairs of rows by the definition."""
    kept = [(i, s, t) for i, s, t, *_ in rows if i is not None and t and len(t.split()) >= 30]
    return {(min(i, j), max(i, j)): (s, r) for (i, s, t), (j, r, u) in itertools.combinations(kept, 2) if near(t, u)}


def test_pairs_across_splits(spark, rng):
    rows = table(rng)
    side = lambda s: {"train": 0, "dev": 1, "test": 1}.get((s or "").strip().lower())
    expected = {p for p, (a, b) in brute(rows).items() if {side(a), side(b)} == {0, 1}}
    df = spark.createDataFrame(rows, SCHEMA)
    got = overlap.cross_split_pairs(df, "id", "t", overlap.split_side()).collect()
    assert len(expected) > 3
    assert {(min(r.id_0, r.id_1), max(r.id_0, r.id_1)) for r in got} == expected and len(got) == len(expected)
    by = {r.id_1: (r.n_pairs, r.fraction) for r in overlap.record_overlaps(*overlap.cross_split_texts(df, "id", "t", overlap.split_side())).collect()}
    for i, (n, fraction) in by.items():
        mine = [r.fraction_1 for r in got if r.id_1 == i]
        assert n == len(mine) and fraction == max(mine)
    assert set(by) == {r.id_1 for r in got} and all(0 < r.fraction_0 <= 1 for r in got)
    report = overlap.split_report(df.withColumnRenamed("doc", "source"), overlap.record_overlaps(*overlap.cross_split_texts(df, "id", "t", overlap.split_side())), "id", "source").collect()
    assert sum(r.n_pairs for r in report) == len(expected)


def test_near_duplicates(spark, rng):
    rows = table(rng)
    expected = set(brute(rows))
    df = spark.createDataFrame(rows, SCHEMA)
    got = signature_tree.near_duplicate_pairs(df, "id", ["t"]).collect()
    assert {(r.id_a, r.id_b) for r in got} == expected and len(got) == len(expected) > 10
    rows = signature_tree.near_duplicate_groups(df, "id", ["t"]).collect()
    groups = {r.id: r.class_id for r in rows}
    assert {r.id: r.n_links for r in rows} == {i: sum(i in p for p in expected) for i in groups}
    assert all(groups[a] == groups[b] for a, b in expected)
    assert len(set(groups.values())) == len(groups) - len({max(p) for p in expected})


def scattered(rng, t, share=0.24):
    """One word in four replaced or misspelt, evenly."""
    words = t.split()
    for i in [int(k / share) for k in range(int(share * len(words)))]:
        words[i] = rng.choice(["구름", "달빛이", "모래를"]) + str(rng.randrange(100)) if i % 2 else words[i] + "뷁"
    return " ".join(words)


def test_quarter_of_words_edited(spark, rng):
    base = [text(rng, 20) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, scattered(rng, t)) for i, t in enumerate(base)]
    far = [(200 + i, scattered(rng, scattered(rng, t), 0.9)) for i, t in enumerate(base)]
    got = signature_tree.near_duplicate_pairs(spark.createDataFrame(rows + far, "id long, t string"), "id", ["t"]).collect()
    assert sorted((r.id_a, r.id_b) for r in got) == [(i, 100 + i) for i in range(12)]


def test_quarter_of_words_edited_across_splits(spark, rng):
    base = [text(rng, 20) for _ in range(12)]
    rows = [(i, "train", t) for i, t in enumerate(base)] + [(100 + i, "test", scattered(rng, t)) for i, t in enumerate(base)]
    got = overlap.cross_split_pairs(spark.createDataFrame(rows, "id long, split string, t string"), "id", "t", overlap.split_side()).collect()
    assert sorted((r.id_0, r.id_1) for r in got) == [(i, 100 + i) for i in range(12)]


def test_fields_do_not_meet(spark, rng):
    t = text(rng)
    df = spark.createDataFrame([(1, t, None), (2, None, t)], "id long, a string, b string")
    assert signature_tree.near_duplicate_pairs(df, "id", ["a", "b"]).count() == 0


@pytest.mark.parametrize("call", [lambda d: overlap.cross_split_pairs(d, "id", "t", overlap.split_side()), lambda d: signature_tree.near_duplicate_pairs(d, "id", ["t"]), lambda d: signature_tree.near_duplicate_groups(d, "id", ["t"])])
def test_empty_table(spark, call):
    assert call(spark.createDataFrame([], SCHEMA)).count() == 0


def tree(sets, groups, loose, kin=None):
    text = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    begin, place = C.signatures(text, K.mix(np.concatenate(sets).astype(np.uint64)).view(np.int64), len(sets))
    n = np.array([len(x) for x in sets])
    return signature_tree.Tree(groups, np.arange(len(sets)), n, n, n * 9, n * 3, begin, place, loose, kin)


def test_gap_coded_signatures():
    rng = np.random.default_rng(1)
    text = np.sort(rng.integers(0, 50, 300)) * 2  # every second text has no token
    begin, place = C.signatures(text, rng.integers(-(1 << 62), 1 << 62, 300), 101)
    for coded in (C.gap_coded(begin, place), C.gap_coded(begin, place).slice(7, 60)):
        b, p = C.gap_decoded(coded)
        lo = 7 if len(coded) == 60 else 0
        assert (b == begin[lo : lo + len(b)] - begin[lo]).all() and (p == place[begin[lo] : begin[lo + len(b) - 1]]).all()


@pytest.mark.parametrize("groups", [1, 9])
def test_tree_prunes_but_loses_nothing(groups):
    rng = np.random.default_rng(3)
    sets = [rng.choice(4000, rng.integers(20, 60), replace=False) for _ in range(150)]
    sets += [np.r_[s[:15], rng.choice(4000, len(s) - 15) + 4000] for s in sets[:60]]
    sets = [np.unique(s) for s in sets]
    order = np.argsort(np.arange(len(sets)) % 150 % groups, kind="stable")
    sets, group = [sets[i] for i in order], (np.arange(len(sets)) % 150 % groups)[order]
    size = np.array([len(s) for s in sets])
    near = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if group[i] == group[j] and len(np.intersect1d(sets[i], sets[j])) >= 0.25 * max(size[i], size[j]) and min(size[i], size[j]) >= 0.75 * max(size[i], size[j])}
    a, b = tree(sets, group, 0.25).pairs()
    got = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    assert near <= got and len(near) > 20
    assert len(got) < 0.05 * len(sets) ** 2 and all(group[x] == group[y] for x, y in got)
    kin = np.arange(len(sets)) % 2
    a, b = tree(sets, group, 0.25, kin).pairs()
    assert {p for p in near if kin[p[0]] != kin[p[1]]} <= {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}


@pytest.mark.parametrize("part, leaves", [(3, 10), (2048, 5)])
def test_parts_and_small_trees(spark, rng, monkeypatch, part, leaves):
    monkeypatch.setattr(C, "PART", part)
    monkeypatch.setattr(signature_tree, "ENTRIES", leaves)
    t = text(rng)
    rows = [(i, edited(rng, t, 0.05)) for i in range(14)]
    got = signature_tree.near_duplicate_pairs(spark.createDataFrame(rows, "id long, t string"), "id", ["t"]).collect()
    assert {(r.id_a, r.id_b) for r in got} == set(brute([(i, None, t) for i, t in rows])) and len(got) == 91
    sides = [(i, ["train", "test"][i % 2], t) for i, t in rows]
    got = overlap.cross_split_pairs(spark.createDataFrame(sides, "id long, split string, t string"), "id", "t", overlap.split_side()).collect()
    assert len({(r.id_0, r.id_1) for r in got}) == len(got) == 49


def test_many_copies(spark, rng, monkeypatch):
    monkeypatch.setattr(C, "PART", 4)
    t = text(rng)
    df = spark.createDataFrame([(i, t) for i in range(20)] + [(50, edited(rng, t, 0.05))], "id long, t string")
    assert signature_tree.near_duplicate_pairs(df, "id", ["t"]).count() == 210
    assert {r.n_links for r in signature_tree.near_duplicate_groups(df, "id", ["t"]).collect()} == {20}


def test_one_long_text(spark, rng, monkeypatch):
    """Prefix rows of a long text have a bounded size."""
    t = text(rng, 8000)
    assert len(t) > 200_000
    df = spark.createDataFrame([(1, t), (2, edited(rng, t, 0.01)), (3, text(rng, 10))], "id long, t string")
    rows, phrase = C.ranked(C.long_form(df, "id", ["t"]), 30, C.MEAN)
    assert max(len(r.bits) for r in C.prefixes(rows, phrase, C.LOOSE, longs=True).select("bits").limit(50).collect()) <= C.BITS
    assert [(r.id_a, r.id_b) for r in signature_tree.near_duplicate_pairs(df, "id", ["t"]).collect()] == [(1, 2)]


def test_near_same():
    t = "가나 다라 마바 사아 자차 카타 파하 거너"
    moved, joined, half = "자차 카타 파하 거너 가나 다라 마바 사아", t.replace(" ", ""), "가나 다라 마바 사아 하나 둘셋 넷다 여섯"
    assert C.near_same([t, t, t, t, "", "같다 같다", t], [moved, joined, half, t.upper(), "", "같다", ""]).tolist() == [True, True, False, True, False, False, False]


def shared_brute(records, span):
    """(record, field) whose text has a run of span that another record has, and the covered length."""
    where = {}
    for r, f, t in records:
        t = unicodedata.normalize("NFC", t or "")
        for i in range(len(t) - span + 1):
            where.setdefault(t[i : i + span], set()).add(r)
    out = {}
    for r, f, t in records:
        t = unicodedata.normalize("NFC", t or "")
        hit = np.zeros(len(t), bool)
        for i in range(len(t) - span + 1):
            if where[t[i : i + span]] - {r}:
                hit[i : i + span] = True
        if hit.any():
            out[r, f] = int(hit.sum())
    return out


def span_rows(rng):
    base = [text(rng, 6) for _ in range(14)]
    rows = [(i, 0, t) for i, t in enumerate(base)]
    for i in range(14, 40):
        t, s = text(rng, 5), rng.choice(base)
        n = rng.choice([60, 79, 80, 81, 95, 130, 200])
        a, at = rng.randrange(len(s) - n), rng.randrange(len(t))
        rows.append((i, rng.randrange(2), t[:at] + s[a : a + n] + t[at:]))
    rows += [(40, 0, base[0]), (0, 1, base[0]), (41, 0, None), (42, 0, ""), (None, 0, base[1]), (43, 1, unicodedata.normalize("NFD", base[2])), (44, 0, "가" * 500), (45, 0, "가" * 300)]
    return rows


@pytest.mark.parametrize("classes", [64, 1])
def test_spans(spark, rng, classes, monkeypatch):
    rows = span_rows(rng)
    plain = spans.verified
    monkeypatch.setattr(spans, "verified", lambda r, s, w: plain(r, s, w, classes))
    df = spark.createDataFrame(rows, "record long, field int, text string").where("record is not null and text is not null")
    got = spans.shared_text([df.where("record < 20"), df.where("record >= 20")]).collect()
    expected = shared_brute([r for r in rows if r[0] is not None], 80)
    assert {(r.record, r.field): r.shared for r in got} == expected and len(got) == len(expected) > 15


def test_hot_spans(spark, rng, monkeypatch):
    monkeypatch.setattr(spans, "HOT", 1)
    rows = [r for r in span_rows(rng) if r[0] is not None and r[2] is not None]
    df = spark.createDataFrame(rows, "record long, field int, text string")
    got = spans.shared_text([df]).collect()
    assert {(r.record, r.field): r.shared for r in got} == shared_brute(rows, 80)


def test_compaction(spark, rng, monkeypatch):
    monkeypatch.setattr(spans, "FANOUT", 1)
    rows = [r for r in span_rows(rng) if r[0] is not None and r[2] is not None]
    df = spark.createDataFrame(rows, "record long, field int, text string")
    got = spans.shared_text([df.where(f"record % 3 = {k}") for k in range(3)]).collect()
    assert {(r.record, r.field): r.shared for r in got} == shared_brute(rows, 80)


def test_index_goes_on_in_its_folder(spark, rng, tmp_path):
    rows = [r for r in span_rows(rng) if r[0] is not None and r[2] is not None]
    df = spark.createDataFrame(rows, "record long, field int, text string")
    first = spans.SpanIndex(spark, path=str(tmp_path / "index"))
    for k in range(5):
        first.add(df.where(f"record % 7 = {k}"))
    assert len(first.parts["runs"]) == 1 and len(list((tmp_path / "index" / "runs").iterdir())) == 1
    for name in first.parts["runs"]:
        spark.sql(f"drop table pairloom_run_{name}")  # as in a session that never saw it
    again = spans.SpanIndex.open(spark, str(tmp_path / "index"))
    met = [again.add(df.where(f"record % 7 = {k}")).count() for k in (5, 6)]
    assert max(met) > 0
    whole = spans.SpanIndex(spark)
    whole.add(df)
    marks = lambda x: {tuple(r) for r in x.marks().drop("hot").collect()}
    assert marks(again) == marks(whole)


def test_no_spans_in_nothing(spark):
    assert spans.shared_text([spark.createDataFrame([], "record long, field int, text string")]).count() == 0


def test_winnowing_guarantee():
    r = random.Random(1)
    shared = "".join(r.choice("가나다라마바사아") for _ in range(80))
    texts = ["".join(r.choice("가나다라마바사아") for _ in range(r.randrange(200))) + shared + "".join(r.choice("가나다라마바사아") for _ in range(r.randrange(200))) for _ in range(60)]
    text_, _, fp = K.winnow(*K.pack(texts), 40, 80)
    sets = [set(fp[text_ == i].tolist()) for i in range(60)]
    assert all(a & b for a, b in itertools.combinations(sets, 2))


def test_long_chunks_are_cut():
    _, _, n = K.content_chunks(*K.pack(["가" * 1000, "", "나다"]), 9)
    assert n.max() <= 255 and n.sum() == 1002
