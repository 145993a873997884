import io
import json
import zipfile
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.functions import kernels as K
from pairloom.functions import text as X
from pairloom.operators import records as R
from pairloom.operators import splits as S
from pairloom.operators import stats as ST
from pairloom.operators.scoring import scored, stand_in
from pairloom.plans.pipeline import Plan, Stage, expanded, merged
from pairloom.sources import readers, sinks
from pairloom.streaming import append


def one(spark, expr, **values):
    df = spark.createDataFrame(pd.DataFrame({k: [v] for k, v in values.items()}))
    return df.select(expr.alias("x")).first()["x"]


def test_collapse():
    assert K.most_repeated_gram("반복 문장 " * 30) > 20
    assert K.most_repeated_gram("평범한 문장 하나가 있다.") == 1
    assert K.most_repeated_gram(None) == 0


def test_loop():
    assert K.longest_loop("가 나 가 나 가 나 다") == 6
    assert K.longest_loop("가 나 다") == 0


@settings(max_examples=60, deadline=None)
@given(st.text("가나다 ", max_size=30), st.text("가나다 ", max_size=30))
def test_longest_common(a, b):
    x, y = a.replace(" ", ""), b.replace(" ", "")
    assert K.longest_common(a, b) == SequenceMatcher(None, x, y, autojunk=False).find_longest_match().size


@settings(max_examples=80, deadline=None)
@given(st.text("가나다 ", max_size=12), st.text("가나다 ", max_size=12))
def test_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    assert K.edit_distance(a, b) == row[-1]


def test_sentence_scores():
    assert K.sentence_scores("같은 문장", "같은 문장") == (1, 0)
    assert K.sentence_scores("문장", "긴 문장 하나") == (1, 0)
    assert K.sentence_scores("가 나 다 라", "마 바 사 아") == (0, 0)
    assert K.sentence_scores("오늘 아침 시장에서 사과를 샀다 그리고", "오늘 아침 시장에서 사과를 샀다 그래서")[1] >= 3


def test_binomial():
    assert K.exact_binomial(0, 4) == 0.125 and K.exact_binomial(2, 4) == 1.0 and K.exact_binomial(0, 0) == 1.0


def test_dialogue_marks(spark):
    got = one(spark, X.without_speakers(F.col("t")), t="A: 첫 발화\nB:: 둘째 발화\n본문 A: 표시는 유지")
    assert got == "첫 발화\n둘째 발화\n본문 A: 표시는 유지"


def test_dialogue(spark):
    fault = lambda t, n: one(spark, X.dialogue_fault(F.col("t"), F.col("n")), t=t, n=n)
    assert fault("A: 가\nB: 나", 2) is None
    assert fault("가\nB: 나", 2) == "unmarked" and fault("A: 가\nB: 나", 3) == "count" and fault("A: 가\nA: 나", 2) == "alternation"
    assert one(spark, X.dialogue_repaired(F.col("t")), t="가\n\nB： 나") == "A: 가\nB： 나"


def test_cleaning(spark):
    assert one(spark, X.cleaned_output(F.col("t")), t="<think>생각</think>\n다듬은 본문:\n글이다.") == "글이다."
    assert one(spark, X.cleaned_output(F.col("t")), t="제목: 무엇\n글이다.") == "글이다."


def test_quote_ratio(spark):
    assert one(spark, X.quote_ratio(F.col("t")), t="“다섯글자임”이다") == pytest.approx(5 / 9)
    assert one(spark, X.quote_ratio(F.col("t")), t="") == 0


def test_sentences(spark):
    assert one(spark, X.sentences(F.col("t")), t=" 하나다. 둘이다!  ") == ["하나다.", "둘이다!"]


def test_article_id(spark):
    ids = ["news-2309.01", "2309.01-x", " News-2309.01 "]
    df = spark.createDataFrame([(i,) for i in ids], "i string")
    assert [r[0] for r in df.select(R.article_id(F.col("i"))).collect()] == ["2309.01", "2309.01-x", "2309.01"]


def test_gates_at_the_bound(spark):
    df = spark.createDataFrame([(1, 0.4, 0.5), (2, 0.5, 0.9), (3, 0.4, 0.6)], "i int, h double, a double")
    assert {r.i for r in R.pair_gate(df, "h", "a", 0.5).collect()} == {1, 3}
    assert {r.i for r in R.loop_gate(df, "h", "a", 0.5).collect()} == {3}


def test_incomplete_join_fails(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="no match"):
        R.joined_complete(a, b, "k").collect()


def test_latest_and_first(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 0, "z")], "k string, n int, v string")
    assert {r.v for r in R.latest(df.where("k is not null"), ["k"], [F.col("n")]).collect()} == {"y"}
    assert {r.v for r in R.first_wins(df, F.col("k"), ["n"]).collect()} == {"x"}


def test_largest_remainder(spark):
    df = spark.createDataFrame([(i, "qwen" if i < 75 else "exaone") for i in range(100)], "i int, g string")
    got = S.largest_remainder(df, "g", 10, "i").collect()
    assert Counter(r.g for r in got) in ({"qwen": 7, "exaone": 3}, {"qwen": 8, "exaone": 2}) and len(got) == 10
    assert {r.i for r in got} == {r.i for r in S.largest_remainder(df, "g", 10, "i").collect()}
    assert S.largest_remainder(df, "g", 0, "i").count() == 100


def test_folds(spark):
    got = S.folds(spark.range(103).withColumnRenamed("id", "k"), "k", 5).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in got) == [20, 20, 21, 21, 21]


def test_md5_mod(spark):
    import hashlib

    df = spark.createDataFrame([(f"k{i}",) for i in range(50)], "k string")
    for r in df.select("k", S.md5_mod(F.col("k"), 10).alias("m")).collect():
        assert r.m == int(hashlib.md5(r.k.encode()).hexdigest(), 16) % 10


def test_group_split():
    sizes = {f"g{i}": 5 + i for i in range(40)}
    out = S.group_split(sizes, measure={g: float(n % 7) for g, n in sizes.items()})
    total = sum(sizes.values())
    share = {s: sum(n for g, n in sizes.items() if out[g] == s) / total for s in ("train", "dev", "test")}
    assert abs(share["train"] - 0.8) < 0.08 and min(share.values()) > 0.03


def test_tau_higher(spark):
    v = np.random.default_rng(1).random(57)
    got = ST.tau_higher(spark.createDataFrame([(float(x),) for x in v], "s double"), "s", 0.05).first()["tau"]
    assert got == np.quantile(v, 0.95, method="higher")


def test_auroc(spark):
    rng = np.random.default_rng(2)
    y, s = rng.integers(0, 2, 200), rng.integers(0, 20, 200) / 20
    brute = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    assert ST.auroc(df, [], "s", "y").first()["auroc"] == pytest.approx(brute)


def test_wilson(spark):
    low, high = ST.wilson(F.col("k"), F.col("n"))
    r = spark.createDataFrame([(35, 50), (0, 0)], "k int, n int").select(low.alias("l"), high.alias("h")).collect()
    assert (round(100 * r[0].l, 1), round(100 * r[0].h, 1)) == (56.2, 80.9) and (r[1].l, r[1].h) == (0, 0)


def test_summary(spark):
    r = ST.score_summary(spark.createDataFrame([(x,) for x in (0.0, 49.0, 50.0, 100.0)], "s double"), [], "s", 50).first()
    assert (r.detected, r.zeros, r.n) == (2, 1, 4)


def test_bootstrap(spark):
    df = spark.createDataFrame([("a", float(i % 10)) for i in range(200)], "g string, v double")
    r = ST.bootstrap_mean(df, "g", "v", samples=4000).first()
    assert r["mean"] == 4.5 and 4.0 < r.low < 4.5 < r.high < 5.0


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "text": "가"}\n\n{"id": "2", "text": ""}\n')
    assert readers.json_lines(spark, str(tmp_path / "a.jsonl"), "id string, text string").count() == 2
    assert readers.json_keys(spark, str(tmp_path / "a.jsonl"), ["id"], True).count() == 1
    assert readers.line_count(spark, str(tmp_path / "a.jsonl")) == 2
    (tmp_path / "ids.json").write_text('{"detector": ["a", "b"]}')
    assert {r.id for r in readers.id_list(spark, str(tmp_path / "ids.json")).collect()} == {"a", "b"}
    body = {"document": [{"id": "d1", "metadata": {"topic": "사회"}, "paragraph": [{"form": "제목"}] + [{"form": "문" * 180}] * 5}]}
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("m.json", json.dumps(body))
    articles = readers.nested_articles(spark, str(tmp_path / "c.zip"))
    assert articles.first().n_para == 6 and readers.corpus_filter(articles, ["사회"]).count() == 1
    assert readers.corpus_filter(articles, ["경제"]).count() == 0
    (tmp_path / "m.csv").write_bytes("﻿file,n\na,1\n".encode())
    assert readers.csv_manifest(spark, str(tmp_path / "m.csv")).columns == ["file", "n"]


def test_bad_json_fails(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"id": "1"}\n{oops\n')
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "b.jsonl"), "id string").collect()


def test_repeated_snapshot_ids_fail(spark, tmp_path):
    row = '{"id": "x", "split": "train", "human_text": "가", "ai_text": "나"}\n'
    (tmp_path / "s.jsonl").write_text(row)
    assert readers.paired_snapshot(spark, str(tmp_path / "s.jsonl")).first().doc_id == "x"
    (tmp_path / "s.jsonl").write_text(row * 2)
    with pytest.raises(Exception, match="repeated"):
        readers.paired_snapshot(spark, str(tmp_path / "s.jsonl")).collect()


def test_tables():
    html = "<table><tr><th>가</th><td> 1 </td></tr></table><table><tr><td>2</td></tr></table>"
    assert readers.html_rows(html) == [(0, 0, ["가", "1"]), (1, 1, ["2"])]
    assert readers.markdown_table("| a | b |\n|---|---|\n| 1 | 2 |\n\n| 3 | 4 |", "| a | b |") == [["1", "2"]]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(str(i), i) for i in range(20)], "k string, v int")
    sinks.json_lines(df, str(tmp_path / "o"), compress=True)
    sinks.json_lines(df, str(tmp_path / "o"), append=True)
    assert spark.read.json(str(tmp_path / "o")).count() == 40
    assert sum(r.n_rows for r in sinks.sharded(df, str(tmp_path / "s"), "k", 4).collect()) == 20
    sinks.status(str(tmp_path / "st.json"), {"a": 1})
    assert json.loads((tmp_path / "st.json").read_text()) == {"a": 1}
    sinks.csv_with_mark(df, str(tmp_path / "x.csv"))
    assert (tmp_path / "x.csv").read_bytes()[:3] == b"\xef\xbb\xbf"


def test_resume(spark):
    prompts = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    outputs = spark.createDataFrame([("a", None, "오류", 1), ("a", "글", None, 2), ("b", None, "오류", 3)], "k string, text string, error string, n int")
    assert {r.k for r in append.pending(prompts, outputs, ["k"]).collect()} == {"b", "c"}
    assert {r.k: r.text for r in append.settled(outputs, ["k"], "n").collect()} == {"a": "글", "b": None}


def test_stream(spark, tmp_path):
    src, out, cp = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    src.mkdir()
    (src / "1.json").write_text('{"k": "a"}\n{"k": "a"}\n{"k": "b"}\n')
    append.stream_new(spark, str(src), "k string", str(out), str(cp), ["k"]).awaitTermination()
    (src / "2.json").write_text('{"k": "b"}\n{"k": "c"}\n')
    append.stream_new(spark, str(src), "k string", str(out), str(cp), ["k"]).awaitTermination()
    assert sorted(r.k for r in spark.read.schema("k string").json(str(out)).collect()) == ["a", "b", "c"]


def test_scorer(spark):
    df = spark.createDataFrame([(1, "가"), (2, None)], "i int, t string")
    got = {r.id: r.score for r in scored(df, "i", "t", "D", lambda: stand_in("D")).collect()}
    assert got["2"] is None and got["1"] == stand_in("D")(["가"])[0]


def test_plan(tmp_path):
    ran = []
    p = Plan([Stage("a", lambda: ran.append("a")), Stage("b", lambda: ran.append("b"), complete=lambda: True), Stage("c", lambda: ran.append("c"), enough=lambda: False)], str(tmp_path / "s.json"))
    assert [x["state"] for x in p.execute()] == ["done", "skipped", "stopped"] and ran == ["a"]
    with pytest.raises(ValueError):
        p.slice("b", "a")
    assert merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    with pytest.raises(KeyError):
        expanded("$NO_SUCH_NAME_HERE/x")


def test_loops_count_from_the_first_match():
    from pairloom.functions import kernels as K

    assert [K.longest_loop(t) for t in ("a b c d a x", "a b a c", "a a", "a b c", "", "x a b a b a y")] == [5, 3, 2, 0, 0, 5]


def test_frequent_characters_are_junk_in_long_sentences():
    from pairloom.functions import kernels as K

    a = "가 나 다 라 마 " * 50
    assert K.sentence_scores("시작 " + a, a + "끝") != K.sentence_scores("시작 " + a, a + "끝", autojunk=False)


def test_gates(spark):
    from pairloom.operators import stats as ST

    rows = [("a", 1.0, False, 0.9, False)] * 20 + [("b", 2.0, True, 0.5, True)] * 20 + [("c", 1.0, False, None, False)]
    df = spark.createDataFrame(rows, "d string, r double, bad boolean, cos double, acute boolean")
    got = {r.d: r for r in ST.quality_gate(df, ["d"], F.col("r"), F.col("bad"), F.col("cos"), F.col("acute")).collect()}
    assert got["a"].passed and got["c"].passed and got["b"].reasons == "length; contaminated; meaning; collapse"
    x = spark.createDataFrame([("a", 0.1, 0.9, 0.5)] * 9 + [("a", 0.6, 0.9, 0.5), ("b", 0.1, 0.9, 0.5)], "d string, h double, x double, tau double")
    assert {r.d: r.collapsed for r in ST.detector_gate(x, ["d"], "h", "x", "tau").collect()} == {"a": True, "b": False}


def test_records_and_samples(spark):
    from pairloom.operators import records as R
    from pairloom.operators import splits as S

    rows = spark.createDataFrame([(i, "ab"[i % 2 if i < 20 else 0]) for i in range(100)], "id long, g string")
    draws = S.resampled(rows, "g", "id", 2000).collect()
    share = sum(r.id < 20 and r.id % 2 == 1 for r in draws) / 2000
    assert len(draws) == 2000 and abs(share - 0.5) < 0.05
    assert S.resampled(rows.limit(0), "g", "id", 5).count() == 0
    cut = {p: n for p, n in S.ratio_cut(rows, "id", (0.8, 0.9)).groupBy("part").count().collect()}
    assert cut == {"train": 80, "dev": 10, "test": 10}
    batches = S.length_batches(rows, "id", "id", 7).collect()
    assert {r.id: r.batch for r in batches} == {i: (99 - i) // 7 for i in range(100)}
    assert R.given_or_sample(rows.limit(0), rows, "id", 5).count() == 5 and R.given_or_sample(rows.limit(3), rows, "id", 5).count() == 3
    with pytest.raises(Exception, match="different ids"):
        R.manifest_rows(rows.limit(3), rows, "id", 4).collect()
    with pytest.raises(Exception, match="no score"):
        R.score_source(rows.withColumn("s", F.lit(None).cast("double")), F.col("id") > 0, "s", "s").collect()
    on = R.numbered_on(rows.where("id > 49"), rows.where("id < 50"), "g", "id").groupBy("g").agg(F.min("candidate").alias("least")).collect()
    assert {r.g: r.least for r in on} == {"a": 41}


def test_text_forms(spark):
    from pairloom.functions import text as X

    df = spark.createDataFrame([("1,985",), ("−1.26%p",), ("x",), (None,)], "t string")
    assert [r.n for r in df.select(X.parsed_number(F.col("t")).alias("n")).collect()] == [1985.0, -1.26, None, None]
    r = spark.createDataFrame([("a<b>&\r\nc\rd", "나는 간다 그리고 왔다. 끝")], "t string, s string").select(X.html_escaped(F.col("t")).alias("h"), X.plain_lines(F.col("t")).alias("l"), F.size(X.style_sentences(F.col("s"))).alias("n"), X.filled("<{a}|{b}>", a=F.lit("1"), b=F.lit("{a}")).alias("f")).first()
    assert (r.h, r.l, r.n, r.f) == ("a&lt;b&gt;&amp;\r\nc\rd", "a<b>&\nc\nd", 3, "<1|{a}>")


def test_runs_side_by_side(tmp_path):
    from pairloom.plans import pipeline as P

    lock, done = str(tmp_path / "lock"), []
    with P.exclusive(lock), pytest.raises(RuntimeError):
        with P.exclusive(lock):
            pass
    with P.exclusive(lock):
        pass
    failed = P.run_all({"a": lambda: done.append(1), "b": lambda: 1 / 0, "c": lambda: done.append(2)})
    assert sorted(done) == [1, 2] and set(failed) == {"b"}
    assert not P.piloted(done.append, lambda: False) and done[-1] == 20
    with pytest.raises(ValueError):
        P.expect_rows({"a": 1}, {"a": 2})
