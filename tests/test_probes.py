import numpy as np
import pyarrow as pa
import pytest

from pairloom.operators import linear as L
from pairloom.operators import probes as P


def _blocks(spark, x, y, fold):
    parts = []
    for rows in np.array_split(np.arange(len(y)), 3):
        at, slot = np.nonzero(x[rows])
        times = x[rows][at, slot].astype(int)
        kept = pa.record_batch([pa.array(rows)], names=["id"])
        parts += L.block(np.repeat(at, times), np.repeat(slot, times), y[rows], fold[rows], kept).to_pylist()
    return spark.createDataFrame(parts, L.BLOCK_SCHEMA).repartition(2)


def test_all_folds_are_fitted_together(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(3)
    x = rng.poisson(0.7, (300, 12)).astype(float)
    x[0, 0] = 400  # more than a byte holds
    x[:, 11] = 2  # no deviation
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 1] - x[:, 2])))).astype(int)
    fold = np.arange(300) % 3
    got = L.fitted(_blocks(spark, x, y, fold), 12, 3, 1e-3, 200)
    for m in range(3):
        rows = [(float(t), Vectors.dense(v)) for t, v, f in zip(y, x, fold) if f != m]
        want = LogisticRegression(regParam=1e-3, maxIter=500, tol=1e-12).fit(spark.createDataFrame(rows, ["label", "features"]))
        assert np.allclose(got[m], [*want.coefficients.toArray(), want.intercept], atol=2e-2)
    scores = {r.id: r.p for r in L.scored(_blocks(spark, x, y, fold), got, "id long, p double").collect()}
    assert len(scores) == 300
    assert np.allclose([scores[i] for i in range(300)], [1 / (1 + np.exp(-(x[i] @ got[i % 3][:-1] + got[i % 3][-1]))) for i in range(300)])


def test_folds_hold_equal_shares_and_probe_tells_labels(spark):
    rows = [(i, f"{'바다 나무' if i % 3 else '하늘 도시'} {i * 7919 % 97} 그림", float(i % 3 > 0)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, text string, y double")
    n = {(r.y, r.fold): r["count"] for r in P.stratified_folds(df, "id", "y", 5).groupBy("y", "fold").count().collect()}
    assert n == {(y, f): 16 if y else 8 for y in (0.0, 1.0) for f in range(5)}
    got = P.cross_validated(df, "id", "text", "y", 5, 1 << 12).first()
    assert got.folds == 5 and got.auroc == pytest.approx(1.0)
    assert P.cross_validated(df.where("y = 1"), "id", "text", "y").first().auroc is None


def test_a_probe_runs_few_jobs_however_many_folds(spark):
    """One pass serves all folds: twice the folds take no more jobs."""
    df = spark.createDataFrame([(i, f"글 {i % 11} 번 {i * 31 % 17}", float(i % 2), i % 6) for i in range(60)], "id long, text string, y double, fold int")
    jobs = []
    for k in (3, 6):
        group = f"probe-{k}"
        spark.sparkContext.setJobGroup(group, group)
        assert P.out_of_fold(df.withColumn("fold", (df.fold % k).cast("int")), "text", "y", "fold", k, 1 << 10).count() == 60
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs[1] <= 1.5 * jobs[0] < 300


def test_telling_words_are_runs_of_words_of_both_labels(spark):
    from collections import Counter

    rows = [(f"하늘\u3000{'참으로 좋은 날' if i % 2 else '또한 이 날'}  {i % 7} 번\n끝", float(i % 2)) for i in range(80)] + [("외톨이 낱말", 1.0), ("", 0.0)]
    df = spark.createDataFrame(rows, "text string, y double")
    runs = lambda t: [" ".join(w[i : i + n]) for w in [t.split()] for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    total, texts = Counter(g for t, _ in rows for g in runs(t)), Counter(g for t, _ in rows for g in set(runs(t)))
    assert len(P._vocabulary(df, "text", 10**6)) == sum(n > 1 for n in texts.values())
    got = P.telling_words(df, "text", "y", 3).collect()
    assert len(got) == 6 and all("또한" in r.word or "이" in r.word.split() for r in got[:3]) and all("참으로" in r.word or "좋은" in r.word for r in got[3:])
    assert all(total[r.word] > 1 for r in got) and got[0].weight < 0 < got[-1].weight
    assert P.telling_words(df.limit(0), "text", "y").count() == 0


def test_telling_words_makes_no_strings_of_runs(spark, monkeypatch):
    """MLlib's vectorizer, which gathers every run of the corpus as a string, isn't used."""
    import pyspark.ml.feature as feature

    monkeypatch.setattr(feature.CountVectorizer, "_fit", lambda *a: pytest.fail("a vectorizer over strings"))
    df = spark.createDataFrame([(f"가 나 {'다' if i % 2 else '라'}", float(i % 2)) for i in range(20)], "text string, y double")
    assert P.telling_words(df, "text", "y", 1).count() == 2
