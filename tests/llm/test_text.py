"""Problems 1, 2 and 8 on hand-written cases and invented corpora."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import defects, reading, truncation

from .conftest import NOUNS, sentence, text

COMPLETE = ["", " #나무 #바다", "\n김○○ 기자", "\n(끝)"]


def corpus(n=1500):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        t = text(rng, 8)
        if i % 10 == 0:
            t, cut = t[: rng.randrange(len(t) // 3, len(t) - 30)].rstrip(), True
            cut = not t.endswith((".", "다"))
            if i % 30 == 0 and cut:
                t += " (이하 생략)"
        elif i % 10 == 1:
            t, cut = t[:-1] + "…", False
        else:
            t, cut = t + rng.choice(COMPLETE), False
        rows.append((i, t, cut))
    return rows


def test_cut_texts(spark):
    rows = corpus()
    odd = [(10_000, None, False), (10_001, "", False), (10_002, " \n", False), (10_003, "...", False), (10_004, sentence(random.Random(1)) + " 나무는 바�", True), (10_005, text(random.Random(2), 3) + " 그는 “나무를 보", True)]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in rows + odd], "id int, t string, share string")
    got = {r.id: r.cut for r in truncation.truncated_rows(df, ["id"], "t").collect()}
    true = {i: c for i, _, c in rows + odd}
    assert got.keys() == true.keys()
    wrong = [i for i in true if got[i] != true[i]]
    assert len(wrong) <= 0.01 * len(true), wrong
    assert all(got[i] == c for i, _, c in odd)


def test_no_rows_no_cuts(spark):
    assert truncation.truncated_rows(spark.createDataFrame([], "id int, t string"), ["id"], "t").count() == 0


def test_composed(spark):
    import unicodedata

    t = "한글 각운 abc"
    df = spark.createDataFrame([(unicodedata.normalize("NFD", t),)], "t string")
    assert df.select(truncation.composed(F.col("t")).alias("t")).first().t == t


def test_defects(spark):
    rng = random.Random(3)
    rows = [(i, text(rng, 8), text(rng, 8), None) for i in range(600)]
    p, k = text(rng, 8), 1000
    cases = [(None, "empty"), ("", "empty"), (" ​\n", "empty"), ("다듬은 글:", "empty"), ("<think>\n생각\n</think>", "empty"), ("```\n```", "empty"), ("N/A", "empty"), ("죄송하지만 '나무 바다'에 관한 글은 다시 써 드릴 수 없습니다.", "refusal"), ("I'm sorry, but I cannot help with '나무'.", "refusal"), ("죄송하다는 말부터 꺼낸 나무조합은 바다지구 신청 516곳을 거절했다.", None), ("“도와드릴 수 없어 죄송합니다”라는 나무본부의 회신이 바다에서 전달되었다.", None), (p, "copy"), ("결과:\n" + ". ".join(p.split(". ")[:4]) + ".", "copy"), (p.upper().replace(" ", "  ").replace(".", "!"), "copy"), (p.split(". ")[0] + ". " + text(rng, 8), None), ("In Fenmoor, 275 people asked the Board to widen the plan before week 12. " * 3, "other_language"), ("花森市では1937人が河川の改善を公社に求め、観光への影響は18474件に達した。", "other_language"), (text(rng, 5)[:-14] + " 나무는 바다", "truncated")]
    rows += [(k + n, a, p, d) for n, (a, d) in enumerate(cases)]
    rows.append((5000, text(rng, 4), None, None))
    df = spark.createDataFrame([(i, a, b, "z") for i, a, b, _ in rows], "id int, answer string, prompt string, defect string")
    got = {r.id: r.defect for r in defects.defective_answers(df, ["id"]).collect()}
    for i, a, _, d in rows:
        if i >= k:
            assert got.get(i) == d, (a, d, got.get(i))
    assert sum(i < k for i in got) <= 6


def test_no_caps(spark):
    """Long quotations, refusals, words and short copies are seen whole."""
    rng = random.Random(8)
    rows = [(i, text(rng, 8), text(rng, 8), None) for i in range(400)]
    long = " ".join(f"그리고 나무{i}와 바다{i}" for i in range(120))
    refusal = "죄송합니다. 이 글은 다시 써 드릴 수 없습니다. " + " ".join(f"규정 {chr(0xAC00 + i)}항을 살펴 주시기 바랍니다." for i in range(60))
    prompt = "나무 바다 하늘 도시 학교 시장 공원 " * 3
    cases = [(refusal, text(rng, 8), "refusal"), ("나무 바다 하늘 도시 학교 시장", prompt + text(rng, 3), "copy")]
    rows += [(1000 + n, a, p, d) for n, (a, p, d) in enumerate(cases)]
    got = {r.id: r.defect for r in defects.defective_answers(spark.createDataFrame([r[:3] for r in rows], "id int, answer string, prompt string"), ["id"]).collect()}
    assert len(refusal) > 600 and [got.get(1000 + n) for n in range(2)] == ["refusal", "copy"]
    whole = [(i, a) for i, a, *_ in rows[:400]] + [(2000, text(rng, 3) + " 그는 “" + long), (2001, text(rng, 3) + " " + "가" * 60 + "했다."), (2002, "가" * 200_000)]
    cut = {r.id: r.cut for r in truncation.truncated_rows(spark.createDataFrame(whole, "id int, t string"), ["id"], "t").collect()}
    assert len(long) > 1000 and cut[2000] and not cut[2001] and 2002 in cut


def test_neighbours_and_limits_decide(spark):
    rng = random.Random(21)
    full = [text(rng, 8) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(full)]
    stop = full[0].index(". ") + 1
    rows += [(900, full[1][: full[1].index("에서") + 1]), (901, full[2][: full[2].index("에서") + 1] + " (이하 생략)"), (902, full[0][:stop])]
    rows += [(1000 + i, (text(rng, 12) + "나무")[:300].rstrip(". ").ljust(300, "가")) for i in range(30)]
    df = spark.createDataFrame([(i, t, text(rng, 8)) for i, t in rows], "id int, answer string, prompt string")
    got = {r.id: (r.defect, r.evidence) for r in defects.evidenced_answers(df, ["id"]).collect()}
    assert got[900] == got[901] == ("truncated", "shortened") and 902 not in got
    assert sum(got.get(1000 + i) == ("truncated", "limit") for i in range(30)) >= 28


def test_shared_beginning():
    rng = random.Random(2)
    for _ in range(200):
        a = "".join(rng.choice("가나") for _ in range(rng.randrange(8)))
        b = "".join(rng.choice("가나") for _ in range(rng.randrange(8)))
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert defects.shared_beginning(a, b) == n


def test_no_answers(spark):
    assert defects.defective_answers(spark.createDataFrame([], "id int, answer string, prompt string"), ["id"]).count() == 0


def test_shortened_versions(spark):
    rng = random.Random(4)
    full = [text(rng, 4) for _ in range(80)]
    short = [t[: rng.randrange(20, len(t) - 1)] for t in full[:30]]
    df = spark.createDataFrame([(t,) for t in full + short + full[:10] + [None, ""]], "t string").repartition(5)
    brute = {s for s in set(full + short) if any(o != s and o.startswith(s) and s.rstrip()[-1] != "." and not o[len(s) :].lstrip().startswith(".") for o in full)}
    hashes = {r.h for r in spark.createDataFrame([(s,) for s in brute], "t string").select(F.xxhash64("t").alias("h")).collect()}
    assert {r.text_hash for r in defects.shortened_versions(df, "t").collect()} == hashes


def test_length_spikes(spark):
    rows = [(n,) for n in range(100, 400)] + [(256,)] * 30
    assert [r.length for r in defects.length_spikes(spark.createDataFrame(rows, "n int"), "n").collect()] == [256]


def graded(n=500):
    rng = random.Random(9)
    tiers = [[f"{a}{b}" for a in NOUNS for b in s] for s in ("집꽃새", "일책길", "법돈값", "성화율", "론성적")]
    docs, marks = [], []
    for i in range(n):
        level = 1 + i % 5
        words = [rng.choice(tiers[min(4, max(0, level - 1 + rng.choice([-1, 0, 0, 0, 1])))]) for _ in range(80)]
        docs.append((i, " ".join(f"{w}는" if j % 7 else f"{w}했다." for j, w in enumerate(words)), level))
        if i % 2:
            marks.append((i, 0, level))
    return docs, marks


def test_levels_on_held_out_texts(spark):
    docs, marks = graded()
    odd = [(1000, None, 0), (1001, "", 0), (1002, "...", 0)]
    d = spark.createDataFrame([(i, t, "s") for i, t, _ in docs + odd], "doc_id long, text string, level string")
    g = spark.createDataFrame([*marks, (1, 1, None), (None, 0, 3), (3, 0, 9)], "doc_id long, rater int, level int")
    got = {r.doc_id: r for r in reading.reading_levels(d, g).collect()}
    held = [(i, level) for i, _, level in docs if not i % 2]
    assert np.mean([got[i].level == level for i, level in held]) > 0.8
    assert np.mean([abs(got[i].level - level) <= 1 for i, level in held]) > 0.97
    assert all(got[i].level is None for i, *_ in odd) and len(got) == len(docs) + 3
    with pytest.raises(ValueError):
        reading.reading_levels(d, g.limit(0))


def test_common_runs_are_those_of_sets(rng):
    """Shares against sets of runs, in less time than a sort of them by two keys takes, which came first before."""
    import time

    from pairloom.llm import kernels as K

    def shares(answers, prompts):
        return defects.gram_shares(*K.pack([t for both in zip(answers, prompts) for t in both]))

    runs = lambda t: {t[i : i + 6] for i in range(len(t) - 5)}
    a = ["", "가나다라마", "가나다라마바", "가나다라마바" * 9, *[text(rng, 4) for _ in range(40)]]
    b = ["가나다라마바", "", "x가나다라마바", "가나다라마바사", *[t[5:90] + text(rng, 2) if i % 2 else t for i, t in enumerate(a[4:])]]
    want = [len(runs(x) & runs(y)) / max(1, len(runs(x))) for x, y in zip(a, b)]
    assert shares(a, b).tolist() == pytest.approx(want)
    assert shares([""], [""]).tolist() == [0.0] and len(shares([], [])) == 0
    long = [text(rng, 400) for _ in range(25)]
    keys = np.random.default_rng(1).integers(0, 2**62, 2 * sum(map(len, long)))
    took = []
    for work in (lambda: np.lexsort((keys, np.arange(len(keys)) * 50 // len(keys))), lambda: shares(long, long)):
        began = time.process_time()
        work()
        took.append(time.process_time() - began)
    assert shares(long, long).tolist() == [1.0] * 25 and took[1] < took[0]
