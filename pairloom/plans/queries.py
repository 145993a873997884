"""Queries over the driver's tables, each with the SQL that DuckDB runs for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.functions import kernels as K
from pairloom.functions import text as X
from pairloom.operators import records as R
from pairloom.operators import splits as S
from pairloom.operators import stats as ST
from pairloom.sources.readers import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pool_scores").where("score is not null and id is not null").groupBy("kind", "id").agg(F.max("score").alias("score"))


SCORES = "scores as (select kind, id, max(score) as score from pool_scores where score is not null and id is not null group by kind, id)"


@query(f"with {SCORES}, t as (select quantile_cont(score, 0.95) as tau from scores where kind = 'human') select kind, count(*) as n, round(avg(score), 9) as mean_score, round(any_value(tau), 9) as tau, round(avg(case when score <= tau then 1.0 else 0.0 end), 9) as pass_rate from scores, t group by kind")
def q_asr_p95(spark, d):
    """Threshold at the human P95, and each kind's rate of passing below it."""
    s = _scores(spark, d)
    tau = s.where("kind = 'human'").agg(ST.p95(F.col("score")).alias("tau"))  # one row
    x = s.crossJoin(F.broadcast(tau))
    return x.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 9).alias("mean_score"), F.round(F.first("tau"), 9).alias("tau"), F.round(ST.rate(F.col("score") <= F.col("tau")), 9).alias("pass_rate"))


@query(f"with {SCORES}, h as (select score, row_number() over (order by score) as r, count(*) over () as n from scores where kind = 'human'), t as (select min(score) as tau from h where r >= ceil(0.95 * (n - 1)) + 1) select kind, round(any_value(tau), 9) as tau, round(avg(case when score > tau then 1.0 else 0.0 end), 9) as above from scores, t group by kind")
def q_tau_higher(spark, d):
    """Threshold for 5 % false positives, and the share above it."""
    s = _scores(spark, d)
    tau = ST.tau_higher(s.where("kind = 'human'"), "score", 0.05)
    return s.crossJoin(F.broadcast(tau)).groupBy("kind").agg(F.round(F.first("tau"), 9).alias("tau"), F.round(ST.rate(F.col("score") > F.col("tau")), 9).alias("above"))


def _labelled(spark, d) -> DataFrame:
    """A row for each (machine kind, label, score): humans stand against each kind."""
    s = _scores(spark, d)
    kinds = F.array(*[F.lit(k) for k in ("g1", "g2", "g3", "g4")])
    human = s.where("kind = 'human'").select(F.explode(kinds).alias("kind"), F.lit(0).alias("y"), "id", "score")
    return human.unionByName(s.where("kind <> 'human'").select("kind", F.lit(1).alias("y"), "id", "score"))


LABELLED = SCORES + ", l as (select k.kind, 0 as y, id, score from scores, (values ('g1'), ('g2'), ('g3'), ('g4')) k(kind) where scores.kind = 'human' union all select kind, 1, id, score from scores where kind <> 'human')"


@query(f"with {LABELLED}, r as (select *, rank() over (partition by kind order by score) + (count(*) over (partition by kind, score) - 1) / 2.0 as r from l) select kind, sum(y)::bigint as n_pos, (count(*) - sum(y))::bigint as n_neg, round((sum(case when y = 1 then r else 0 end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 9) as auroc from r group by kind")
def q_auroc_ties(spark, d):
    """A9b W7."""
    return ST.auroc(_labelled(spark, d), ["kind"], "score", "y").withColumn("auroc", F.round("auroc", 9))


@query(f"with {LABELLED}, r as (select *, row_number() over (partition by kind order by score, y, id) as r from l) select kind, round((sum(case when y = 1 then r else 0 end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 9) as auroc from r group by kind")
def q_auroc_rank(spark, d):
    """Ties in a fixed order (score, label, id), negatives first."""
    c = _labelled(spark, d).groupBy("kind", "score").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    below = F.coalesce(F.sum(F.col("n") - F.col("p")).over(Window.partitionBy("kind").orderBy("score")), F.lit(0))
    w = c.withColumn("w", F.col("p") * below)
    return w.groupBy("kind").agg(F.round(F.sum("w") / (F.sum("p") * F.sum(F.col("n") - F.col("p"))), 9).alias("auroc"))


@query(f"with {LABELLED}, c as (select kind, count(*) filter (where score >= 0.5 and y = 1) as tp, count(*) filter (where score >= 0.5 and y = 0) as fp, count(*) filter (where score < 0.5 and y = 1) as fn, count(*) filter (where score < 0.5 and y = 0) as tn from l group by kind), m as (select *, case when tp + fp > 0 then tp / (tp + fp)::double else 0 end as p, case when tp + fn > 0 then tp / (tp + fn)::double else 0 end as r, case when fp + tn > 0 then fp / (fp + tn)::double else 0 end as f from c) select kind, tp, fp, fn, tn, round(p, 9) as precision, round(r, 9) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 9) as f1, round(f, 9) as fpr from m")
def q_f1_at_half(spark, d):
    """The threshold counts as positive."""
    out = ST.classification(_labelled(spark, d), ["kind"], "score", "y")
    return out.select("kind", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "fpr")])


@query("select coalesce(generator, 'unknown') as arm, count(*) as n, count(*) filter (where d_human < 0.5) as human_ok, count(*) filter (where d_ai >= 0.5) as flipped, count(*) filter (where d_human < 0.5 and d_ai >= 0.5) as passed, round(100.0 * count(*) filter (where d_human < 0.5 and d_ai >= 0.5) / greatest(count(*), 1), 6) as pct from pairs where d_human is not null and d_ai is not null group by 1")
def q_gate_funnel(spark, d):
    """A1 A2 J3."""
    x = table(spark, d, "pairs").where("d_human is not null and d_ai is not null")
    ok, flip = F.col("d_human") < 0.5, F.col("d_ai") >= 0.5
    out = x.groupBy(F.coalesce("generator", F.lit("unknown")).alias("arm")).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("human_ok"), F.count_if(flip).alias("flipped"), F.count_if(ok & flip).alias("passed"))
    return out.withColumn("pct", F.round(100.0 * F.col("passed") / F.greatest("n", F.lit(1)), 6))


@query("select pair_id, d_human, d_ai from pairs where d_human < 0.5 and d_ai >= 0.5")
def q_pair_gate(spark, d):
    """P10."""
    return R.pair_gate(table(spark, d, "pairs"), "d_human", "d_ai", 0.5).select("pair_id", "d_human", "d_ai")


@query("select pair_id, d_human, d_ai from pairs where d_human < 0.5 and d_ai > 0.5 and lower(trim(split)) <> 'test'")
def q_loop_gate(spark, d):
    """Strict, without the test split."""
    x = table(spark, d, "pairs").where(R.clean_split(F.col("split")) != "test")
    return R.loop_gate(x, "d_human", "d_ai", 0.5).select("pair_id", "d_human", "d_ai")


@query("with x as (select pair_id, source, coalesce(d_human < 0.5 and d_ai > 0.5, false) as k, d_ai - d_human as m from pairs), y as (select *, sum(k::int) over (partition by source) as n, row_number() over (partition by source order by k, m desc nulls last, pair_id) as r from x) select pair_id, source, not k as floor from y where k or r <= 5 - n")
def q_floor_fill(spark, d):
    """Sources with fewer than five kept pairs are filled up by margin."""
    kept = (F.col("d_human") < 0.5) & (F.col("d_ai") > 0.5)
    return R.floor_filled(table(spark, d, "pairs"), kept, "source", F.col("d_ai") - F.col("d_human"), 5, "pair_id").select("pair_id", "source", "floor")


@query("with c as (select source, count(*) as n, count(*) filter (where d_ai >= 0.5) as k from pairs where d_ai is not null group by source) select source, n, k, round((k / n::double + 3.8416 / (2 * n) - 1.96 * sqrt((k / n::double) * (1 - k / n::double) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 9) as low, round((k / n::double + 3.8416 / (2 * n) + 1.96 * sqrt((k / n::double) * (1 - k / n::double) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 9) as high from c")
def q_wilson(spark, d):
    """A13 A36."""
    x = table(spark, d, "pairs").where("d_ai is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d_ai") >= 0.5).alias("k"))
    low, high = ST.wilson(F.col("k"), F.col("n"))
    return x.withColumns({"low": F.round(low, 9), "high": F.round(high, 9)})


@query(f"with {SCORES} select kind, count(*) as n, round(avg(score), 9) as mean, round(quantile_cont(score, 0.5), 9) as median, round(quantile_cont(score, 0.25), 9) as q1, round(quantile_cont(score, 0.75), 9) as q3, max(score) as max, count(*) filter (where score = 0) as zeros, count(*) filter (where score >= 0.5) as detected, round(1 - avg(case when score >= 0.5 then 1.0 else 0.0 end), 9) as passed from scores group by kind")
def q_summary_scores(spark, d):
    """A12."""
    out = ST.score_summary(_scores(spark, d), ["kind"], "score", 0.5)
    return out.select("kind", "n", *[F.round(c, 9).alias(c) for c in ("mean", "median", "q1", "q3")], "max", "zeros", "detected", F.round("passed", 9).alias("passed"))


@query(f"with {SCORES}, f as (select avg(case when score >= 0.5 then 100.0 else 0.0 end) as fpr from scores where kind = 'human') select kind, round((avg(case when score >= 0.5 then 100.0 else 0.0 end) + 100 - any_value(fpr)) / 2, 9) as balanced from scores, f where kind <> 'human' group by kind")
def q_balanced_acc(spark, d):
    """A17."""
    s = _scores(spark, d)
    fpr = s.where("kind = 'human'").agg((ST.rate(F.col("score") >= 0.5) * 100).alias("fpr"))
    return s.where("kind <> 'human'").crossJoin(F.broadcast(fpr)).groupBy("kind").agg(F.round((ST.rate(F.col("score") >= 0.5) * 100 + 100 - F.first("fpr")) / 2, 9).alias("balanced"))


@query("with t as (select domain, quantile_cont(d_human, 0.95) as tau from pairs where d_human is not null group by domain), g as (select p.domain, round(avg(case when d_ai > tau then 1.0 else 0.0 end) - avg(case when d_human > tau then 1.0 else 0.0 end), 9) as gap from pairs p join t using (domain) where d_human is not null and d_ai is not null group by p.domain) select domain, gap, case when gap > 0.4 then 'valid' when gap > 0.15 then 'weak' else 'invalid' end as validity from g")
def q_validity(spark, d):
    """How far a detector separates the two sides."""
    p = table(spark, d, "pairs")
    tau = p.where("d_human is not null").groupBy("domain").agg(ST.p95(F.col("d_human")).alias("tau"))
    x = p.where("d_human is not null and d_ai is not null").join(tau, "domain").groupBy("domain").agg(F.round(ST.rate(F.col("d_ai") > F.col("tau")) - ST.rate(F.col("d_human") > F.col("tau")), 9).alias("gap"))
    return x.withColumn("validity", F.when(F.col("gap") > 0.4, "valid").when(F.col("gap") > 0.15, "weak").otherwise("invalid"))


@query("with t as (select domain, quantile_cont(d_human, 0.95) as tau from pairs where d_human is not null group by domain), g as (select p.domain, avg(case when d_ai > tau then 1.0 else 0.0 end) as tpr, avg(case when d_ai > tau then 1.0 else 0.0 end) - avg(case when d_human > tau then 1.0 else 0.0 end) as gap from pairs p join t using (domain) where d_human is not null and d_ai is not null group by p.domain) select count(*) as n_domains, count(*) filter (where gap > 0.15) as n_valid, round(avg(tpr) filter (where gap > 0.15), 9) as macro_tpr from g")
def q_macro_mean(spark, d):
    """Mean over domains of the rates, invalid domains left out."""
    p = table(spark, d, "pairs")
    tau = p.where("d_human is not null").groupBy("domain").agg(ST.p95(F.col("d_human")).alias("tau"))
    x = p.where("d_human is not null and d_ai is not null").join(tau, "domain").groupBy("domain").agg(ST.rate(F.col("d_ai") > F.col("tau")).alias("tpr"), ST.rate(F.col("d_human") > F.col("tau")).alias("fpr"))
    ok = F.col("tpr") - F.col("fpr") > 0.15
    return x.agg(F.count(F.lit(1)).alias("n_domains"), F.count_if(ok).alias("n_valid"), F.round(F.avg(F.when(ok, F.col("tpr"))), 9).alias("macro_tpr"))


@query("with c as (select p.domain as source_domain, q.domain as target_domain, avg(case when p.d_ai > q.tau then 1.0 else 0.0 end) as rate from pairs p, (select domain, quantile_cont(d_human, 0.95) as tau from pairs where d_human is not null group by domain) q where p.d_ai is not null group by 1, 2) select source_domain = target_domain as same, count(*) as cells, round(avg(rate), 9) as macro from c group by 1")
def q_macro_matrix(spark, d):
    """Domain x domain rates at the other domain's threshold; diagonal and off-diagonal means."""
    p = table(spark, d, "pairs")
    tau = p.where("d_human is not null").groupBy(F.col("domain").alias("target_domain")).agg(ST.p95(F.col("d_human")).alias("tau"))
    # one row for each domain is broadcast; the large side is aggregated at once
    c = p.where("d_ai is not null").crossJoin(F.broadcast(tau)).groupBy(F.col("domain").alias("source_domain"), "target_domain").agg(ST.rate(F.col("d_ai") > F.col("tau")).alias("rate"))
    return c.groupBy((F.col("source_domain") == F.col("target_domain")).alias("same")).agg(F.count(F.lit(1)).alias("cells"), F.round(F.avg("rate"), 9).alias("macro"))


def _wide(spark, d) -> DataFrame:
    return _scores(spark, d).groupBy("id").pivot("kind", ["human", "g1", "g2", "g3", "g4"]).agg(F.max("score"))


WIDE = SCORES + ", w as (select id, max(score) filter (where kind = 'human') as human, max(score) filter (where kind = 'g1') as g1, max(score) filter (where kind = 'g2') as g2, max(score) filter (where kind = 'g3') as g3, max(score) filter (where kind = 'g4') as g4 from scores group by id)"


@query(f"with {WIDE} select * from w")
def q_pivot_scores(spark, d):
    """A row for each id."""
    return _wide(spark, d)


@query("select pair_id, 0 as label, human_text as text from pairs where human_text is not null and human_text <> '' union all select pair_id, 1, ai_text from pairs where ai_text is not null and ai_text <> ''")
def q_labelled_texts(spark, d):
    """P21 P22 P23."""
    x = table(spark, d, "pairs")
    pair = F.array(F.struct(F.lit(0).alias("label"), F.col("human_text").alias("text")), F.struct(F.lit(1).alias("label"), F.col("ai_text").alias("text")))
    return x.select("pair_id", F.explode(pair).alias("x")).select("pair_id", "x.label", "x.text").where("text <> ''")


@query(f"with {WIDE} select count(*) as n, round(avg(g2 - g1), 9) as mean_delta, round(quantile_cont(g2 - g1, 0.5), 9) as median_delta, count(*) filter (where g2 > g1) as up, count(*) filter (where g2 < g1) as down, count(*) filter (where g2 = g1) as tied, count(*) filter (where g1 >= 0.5 and g2 >= 0.5) as both, count(*) filter (where g1 >= 0.5 and g2 < 0.5) as cleared, count(*) filter (where g1 < 0.5 and g2 >= 0.5) as raised, count(*) filter (where g1 < 0.5 and g2 < 0.5) as neither from w where g1 is not null and g2 is not null")
def q_transitions(spark, d):
    """Paired deltas, signs and transitions."""
    out = ST.paired(_wide(spark, d), [], "g1", "g2", 0.5)
    return out.withColumns({c: F.round(c, 9) for c in ("mean_delta", "median_delta")})


@query()
def q_mcnemar_exact(spark, d):
    """Exact McNemar and sign tests on the aggregated row."""
    x = ST.paired(_wide(spark, d), [], "g1", "g2", 0.5)
    return x.select("cleared", "raised", K.exact_binomial_udf("cleared", F.col("cleared") + F.col("raised")).alias("mcnemar_p"), K.exact_binomial_udf("up", F.col("up") + F.col("down")).alias("sign_p"))


@query()
def q_bootstrap_mean(spark, d):
    """A15."""
    return ST.bootstrap_mean(_scores(spark, d), "kind", "score")


@query(f"with {WIDE} select count(*) filter (where g1 = g2) as matches, count(*) filter (where g1 <> g2) as mismatches, round(max(abs(g1 - g2)), 9) as max_diff, round(avg(g2 - g1), 9) as mean_diff from w")
def q_reproducibility(spark, d):
    """A35 J12."""
    a, b = F.col("g1"), F.col("g2")
    return _wide(spark, d).agg(F.count_if(a == b).alias("matches"), F.count_if(a != b).alias("mismatches"), F.round(F.max(F.abs(a - b)), 9).alias("max_diff"), F.round(F.avg(b - a), 9).alias("mean_diff"))


ARTICLE = "case when regexp_matches(lower(regexp_replace(doc_id, '\\s+', '', 'g')), '^[0-9]') then lower(regexp_replace(doc_id, '\\s+', '', 'g')) else regexp_replace(lower(regexp_replace(doc_id, '\\s+', '', 'g')), '^[^-]*-', '') end"
SPLIT_SQL = "case when (concat('0x', md5(concat('42:', {k})))::uhugeint % 10) < 8 then 'train' when (concat('0x', md5(concat('42:', {k})))::uhugeint % 10) < 9 then 'dev' else 'test' end"


@query(f"select pair_id, {ARTICLE} as article, {SPLIT_SQL.format(k='(' + ARTICLE + ')')} as new_split from pairs where doc_id is not null")
def q_hash_split(spark, d):
    """P2 R5."""
    x = table(spark, d, "pairs").where("doc_id is not null").select("pair_id", R.article_id(F.col("doc_id")).alias("article"))
    return x.withColumn("new_split", S.hash_split(F.col("article")))


@query(f"select doc_id, case when concat('0x', md5(doc_id::varchar))::uhugeint % 2 = 0 then 'cal' else 'gate' end as half, (concat('0x', substr(sha256(doc_id::varchar), 1, 8))::bigint % 16)::int as shard from documents")
def q_dev_half_shard(spark, d):
    """R6 R7."""
    k = F.col("doc_id").cast("string")
    return table(spark, d, "documents").select("doc_id", S.dev_half(k).alias("half"), S.shard(k, 16).alias("shard"))


@query(f"with x as (select pair_id, domain, file_pos, line_pos, {ARTICLE} as article from pairs where doc_id is not null) select pair_id, domain, article from x qualify row_number() over (partition by domain, article order by file_pos, line_pos, pair_id) = 1")
def q_dedup_first_wins(spark, d):
    """An article's first row by file order."""
    x = table(spark, d, "pairs").where("doc_id is not null").select("pair_id", "domain", "file_pos", "line_pos", R.article_id(F.col("doc_id")).alias("article"))
    return R.first_wins(x, F.struct("domain", "article"), ["file_pos", "line_pos", "pair_id"]).select("pair_id", "domain", "article")


@query(f"with x as (select pair_id, domain, lower(trim(split)) as s, {ARTICLE} as k from pairs) select pair_id from x where s in ('dev', 'test') and not exists (select 1 from x t where t.s = 'train' and t.k = x.k and t.domain = x.domain)")
def q_leak_anti(spark, d):
    """Evaluation rows whose article, of the same domain, isn't in train."""
    x = table(spark, d, "pairs").select("pair_id", "domain", R.article_id(F.col("doc_id")).alias("k"), R.clean_split(F.col("split")).alias("s"))
    return x.where("s in ('dev', 'test')").join(x.where("s = 'train'").select("domain", "k").distinct(), ["domain", "k"], "left_anti").select("pair_id")


@query(f"with s as (select distinct lower(trim(split)) as s, domain, {ARTICLE} as k from pairs where split is not null and doc_id is not null) select a.s as split_a, b.s as split_b, count(*) as shared from s a join s b on a.k = b.k and a.domain = b.domain and a.s < b.s group by 1, 2")
def q_audit_sets(spark, d):
    """Articles that two splits share."""
    s = table(spark, d, "pairs").where("split is not null and doc_id is not null").select(R.clean_split(F.col("split")).alias("s"), "domain", R.article_id(F.col("doc_id")).alias("k")).distinct()
    # at most three splits for each article: aggregated before pairs are made
    sets = s.groupBy("domain", "k").agg(F.sort_array(F.collect_set("s")).alias("ss")).where(F.size("ss") > 1)
    a = sets.select("ss", F.posexplode("ss").alias("i", "split_a"))
    b = a.select("split_a", F.explode(F.slice("ss", F.col("i") + 2, F.greatest(F.size("ss") - F.col("i") - 1, F.lit(0)))).alias("split_b"))
    return b.groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("shared"))


@query("with k as (select distinct doc_id from human_pool where doc_id is not null) select p.pair_id, coalesce(a.doc_id, b.doc_id) as pool_key from pairs p left join k a on p.doc_id = a.doc_id left join k b on regexp_replace(p.doc_id, '^[^0-9-][^-]*-', '') = b.doc_id")
def q_resolve_ids(spark, d):
    """Exact id, else without the prefix, else null."""
    return R.resolved(table(spark, d, "pairs").select("pair_id", "doc_id"), table(spark, d, "human_pool"), "doc_id", "doc_id").select("pair_id", "pool_key")


@query(f"with l as (select distinct {ARTICLE} as k from pairs where doc_id is not null), r as (select distinct {ARTICLE} as k from human_pool where doc_id is not null) select k, 'left' as side from l where k not in (select k from r) union all select k, 'right' from r where k not in (select k from l)")
def q_set_differences(spark, d):
    """Articles that only one of two tables has."""
    of = lambda t: table(spark, d, t).where("doc_id is not null").select(R.article_id(F.col("doc_id")).alias("k"))
    return R.key_differences(of("pairs"), of("human_pool"), "k")


@query("with x as (select pair_id, coalesce(nullif(generator, ''), 'unknown') as g from pairs), c as (select g, count(*) as n from x group by g), e as (select g, n, 300 * n / (sum(n) over ())::double as e from c), q as (select g, (floor(e) + case when row_number() over (order by e - floor(e) desc, g) <= 300 - sum(floor(e)) over () then 1 else 0 end) as q from e) select pair_id, x.g as arm from x join q using (g) qualify row_number() over (partition by x.g order by md5(concat('42:', pair_id::varchar)), pair_id) <= any_value(q.q) over (partition by x.g)")
def q_strat_sample(spark, d):
    """300 rows, largest remainder."""
    out = S.largest_remainder(table(spark, d, "pairs").select("pair_id", "generator"), "generator", 300, "pair_id")
    return out.select("pair_id", F.coalesce(F.nullif(F.col("generator"), F.lit("")), F.lit("unknown")).alias("arm"))


@query("select pair_id, lower(trim(split)) as s from pairs where split is not null qualify row_number() over (partition by lower(trim(split)) order by file_pos, line_pos, pair_id) <= 20")
def q_head_per_split(spark, d):
    """P20 R2 P25."""
    x = table(spark, d, "pairs").where("split is not null").select("pair_id", "file_pos", "line_pos", F.lower(F.trim("split")).alias("s"))
    return S.head_per(x, "s", ["file_pos", "line_pos", "pair_id"], 20).select("pair_id", "s")


@query("with s as (select source, count(*) as n from documents where source is not null group by source), o as (select *, coalesce(sum(n) over (order by n desc, source rows between unbounded preceding and 1 preceding), 0) as before from s) select source, n from o where before < (select count(*) from documents) / 4")
def q_det_groups(spark, d):
    """Largest sources until a quarter of the documents is reached."""
    docs = table(spark, d, "documents")
    s = docs.where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return S.group_quota(s, "source", "n", docs.count() / 4)


@query("select doc_id, ((row_number() over (order by md5(concat('42:', doc_id::varchar)), doc_id) - 1) % 5)::int as fold from documents")
def q_kfold(spark, d):
    """W10 W14 R11."""
    return S.folds(table(spark, d, "documents").select("doc_id"), "doc_id", 5)


@query("select pair_id, length(human_text) as n from pairs where lower(trim(split)) = 'train' and human_text is not null order by length(human_text) desc, pair_id limit 8")
def q_longest_train(spark, d):
    """R14 R1 R13."""
    x = table(spark, d, "pairs").where(R.clean_split(F.col("split")) == "train").where("human_text is not null")
    return x.select("pair_id", F.length("human_text").alias("n")).orderBy(F.desc("n"), "pair_id").limit(8)


@query("select doc_id, source from documents where source is not null qualify row_number() over (partition by source, lang order by crawled_at, doc_id) <= 3")
def q_stratum_heads(spark, d):
    """The first three of each stratum."""
    w = Window.partitionBy("source", "lang").orderBy("crawled_at", "doc_id")
    return table(spark, d, "documents").where("source is not null").withColumn("n", F.row_number().over(w)).where("n <= 3").select("doc_id", "source")


@query("with x as (select *, row_number() over (partition by domain, source order by doc_id) as n from documents), y as (select *, row_number() over (partition by domain order by n, source, doc_id) as t from x where n <= 3) select doc_id, domain, source from y order by t, domain, source, doc_id limit 40")
def q_round_robin(spark, d):
    """Topics in turn, least-used publishers first."""
    return S.round_robin(table(spark, d, "documents").select("doc_id", "domain", "source"), "domain", "source", ["doc_id"], 3, 40)


@query()
def q_group_split(spark, d):
    """Whole sources to splits, digit density balanced."""
    g = table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg(X.digit_density(F.coalesce("text", F.lit("")))).alias("m")).collect()  # a row for each source
    out = S.group_split({r["source"]: r["n"] for r in g}, measure={r["source"]: r["m"] for r in g})
    return spark.createDataFrame([(r["source"], r["n"], out[r["source"]]) for r in g], "source string, n bigint, split string")


@query("select g.gen_id, coalesce(length(g.text) / greatest(length(p.ai_text), 1)::double between 0.5 and 2.0 and length(regexp_replace(g.text, '[^가-힣]', '', 'g')) / length(g.text)::double >= 0.30, false) as valid from gen_test g join pairs p using (pair_id) where g.text <> '' and p.ai_text is not null")
def q_valid_generation(spark, d):
    """P7 F3."""
    g = table(spark, d, "gen_test").where("text <> ''").join(table(spark, d, "pairs").where("ai_text is not null").select("pair_id", "ai_text"), "pair_id")
    ratio = F.length("text") / F.greatest(F.length("ai_text"), F.lit(1))
    return g.select("gen_id", F.coalesce(ratio.between(0.5, 2.0) & (X.hangul_share(F.col("text")) >= 0.30), F.lit(False)).alias("valid"))


@query("select source, round(avg(length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1)::double * 1000), 6) as density from documents where text is not null group by source")
def q_digit_density(spark, d):
    """F2 A32."""
    return table(spark, d, "documents").where("text is not null").groupBy("source").agg(F.round(F.avg(X.digit_density(F.col("text"))), 6).alias("density"))


@query("select pair_id, round(case when length(human_text) > 0 then coalesce(list_sum(list_transform(regexp_extract_all(human_text, '[“‘\"]([^”’\"]{5,})[”’\"]', 1), lambda q: length(q))), 0) / length(human_text)::double else 0 end, 9) as ratio from pairs where human_text is not null")
def q_quote_ratio(spark, d):
    """F1."""
    return table(spark, d, "pairs").where("human_text is not null").select("pair_id", F.round(X.quote_ratio(F.col("human_text")), 9).alias("ratio"))


@query("with x as (select 'documents' as tbl, doc_id as id, text from documents union all select 'gen_test', gen_id, text from gen_test union all select 'pairs', pair_id, ai_text from pairs) select tbl, count(*) as n, count(*) filter (where regexp_matches(text, '(?m)\\*\\*|^#{1,4}[ \\t\\n\\f\\r]|^[ \\t\\n\\f\\r]*[-*•][ \\t\\n\\f\\r]')) as marked, count(*) filter (where regexp_matches(text, '^[ \\t\\n\\f\\r]*#|[*][^*\\n]+[*]|^[-*•]')) as loose from x where text is not null group by tbl")
def q_markdown(spark, d):
    """Texts with Markdown, and by a looser pattern, in each table."""
    of = lambda t, i, c: table(spark, d, t).select(F.lit(t).alias("tbl"), F.col(i).alias("id"), F.col(c).alias("text"))
    x = of("documents", "doc_id", "text").unionByName(of("gen_test", "gen_id", "text")).unionByName(of("pairs", "pair_id", "ai_text")).where("text is not null")
    return x.groupBy("tbl").agg(F.count(F.lit(1)).alias("n"), F.count_if(X.has_markdown(F.col("text"))).alias("marked"), F.count_if(F.col("text").rlike(r"^[ \t\n\f\r]*#|[*][^*\n]+[*]|^[-*•]")).alias("loose"))


@query("with x as (select gen_id, text, length(text) as n, regexp_matches(text, '(?i)(^|\\n)[ \\t\\n\\f\\r]*(#{1,6}[ \\t\\n\\f\\r]*)?(분석 결과|자연도 등급|주요 변경 사항|의미 보존 검증)') as c, text like '%<think>%' as th from gen_test where text is not null) select count(*) as n, count(*) filter (where c) as contaminated, count(*) filter (where th) as had_think, sum(n)::bigint as chars from x")
def q_contamination(spark, d):
    """P18 A29."""
    t = F.col("text")
    return table(spark, d, "gen_test").where("text is not null").agg(F.count(F.lit(1)).alias("n"), F.count_if(t.rlike(X.CONTAMINATION)).alias("contaminated"), F.count_if(F.contains(t, F.lit("<think>"))).alias("had_think"), F.sum(F.length(t)).alias("chars"))


@query()
def q_cleaned_output(spark, d):
    """Answers without reasoning blocks and label lines."""
    return table(spark, d, "gen_test").where("text is not null").select("gen_id", X.cleaned_output(F.col("text")).alias("text"))


@query("select pair_id, coalesce(nullif(human_text, ''), nullif(ai_text, '')) as text, case when lower(generator) like '%qwen%' then 'qwen' when lower(generator) like '%exaone%' then 'exaone' end as engine, case when doc_id like domain || '-%' then doc_id else domain || '-' || doc_id end as full_id from pairs where doc_id is not null and domain is not null")
def q_field_fallback(spark, d):
    """P1 P3 P17."""
    g = F.lower("generator")
    engine = F.when(F.contains(g, F.lit("qwen")), "qwen").when(F.contains(g, F.lit("exaone")), "exaone")
    return table(spark, d, "pairs").where("doc_id is not null and domain is not null").select("pair_id", X.first_filled(F.col("human_text"), F.col("ai_text")).alias("text"), engine.alias("engine"), R.with_prefix(F.col("doc_id"), F.col("domain")).alias("full_id"))


def _candidates(spark, d) -> DataFrame:
    return table(spark, d, "gen_test").select("gen_id", "pair_id", "round", "text").join(table(spark, d, "pairs").select("pair_id", F.col("human_text").alias("chosen")), "pair_id").where("text <> '' and text <> chosen").withColumn("score", F.round(F.length("text") / F.greatest(F.length("chosen"), F.lit(1)), 9))


CANDIDATES = "c as (select gen_id, pair_id, round, text, round(length(text) / greatest(length(human_text), 1)::double, 9) as score from gen_test join pairs using (pair_id) where text <> '' and text <> human_text)"


@query(f"with {CANDIDATES} select pair_id, gen_id, score from c where score > 0.5 qualify row_number() over (partition by pair_id order by score desc, gen_id) <= 2")
def q_topk_negatives(spark, d):
    """W4 P13."""
    w = Window.partitionBy("pair_id").orderBy(F.desc("score"), "gen_id")
    return _candidates(spark, d).where("score > 0.5").withColumn("r", F.row_number().over(w)).where("r <= 2").select("pair_id", "gen_id", "score")


@query(f"with {CANDIDATES} select pair_id, arg_max(gen_id, score * 1e12 - gen_id) as worst, arg_min(gen_id, score * 1e12 + gen_id) as best, count(*) as n, case when count(*) >= 4 then 'full' when count(*) >= 2 then 'more' else 'few' end as state from c group by pair_id")
def q_argmax_negative(spark, d):
    """W5 W6 W9 W13."""
    c = _candidates(spark, d).groupBy("pair_id").agg(F.max_by("gen_id", F.struct("score", -F.col("gen_id"))).alias("worst"), F.min_by("gen_id", F.struct("score", "gen_id")).alias("best"), F.count(F.lit(1)).alias("n"))
    return c.withColumn("state", F.when(F.col("n") >= 4, "full").when(F.col("n") >= 2, "more").otherwise("few"))


@query("with x as (select pair_id, source, row_number() over (partition by source order by pair_id) as i from pairs where source is not null) select pair_id, source, ((i - 1) // 25 + 1)::bigint as batch, source || '-' || lpad(i::varchar, 6, '0') as file from x")
def q_batches(spark, d):
    """Serial names and batches within a source."""
    x = table(spark, d, "pairs").where("source is not null").select("pair_id", "source", F.row_number().over(Window.partitionBy("source").orderBy("pair_id")).alias("i"))
    return x.select("pair_id", "source", (F.floor((F.col("i") - 1) / 25) + 1).alias("batch"), F.concat("source", F.lit("-"), F.lpad(F.col("i").cast("string"), 6, "0")).alias("file"))


@query("with g as (select 'human' as grp, pair_id as id from pairs where human_text <> '' union all select 'para_r' || round, gen_id from gen_test where text <> ''), n as (select count(distinct grp) - 1 as k from g) select grp, count(*) as size, round(case when grp = 'human' then 0.5 / count(*) else 0.5 / (any_value(k) * count(*)) end, 12) as weight from g, n group by grp")
def q_replay_weights(spark, d):
    """Half of the weight to humans, the rest shared by rounds."""
    g = table(spark, d, "pairs").where("human_text <> ''").select(F.lit("human").alias("grp")).unionByName(table(spark, d, "gen_test").where("text <> ''").select(F.concat(F.lit("para_r"), F.col("round")).alias("grp")))
    c = g.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    k = c.agg((F.count("grp") - 1).alias("k"))
    return c.crossJoin(F.broadcast(k)).select("grp", "size", F.round(F.when(F.col("grp") == "human", 0.5 / F.col("size")).otherwise(0.5 / (F.col("k") * F.col("size"))), 12).alias("weight"))


@query("with c as (select case when origin = 'human' then 0 else 1 end as y, count(*) as n from documents where origin is not null group by 1) select y, n, round((sum(n) over ())::double / (2 * n), 9) as weight from c")
def q_class_weights(spark, d):
    """A30."""
    c = table(spark, d, "documents").where("origin is not null").groupBy(F.when(F.col("origin") == "human", 0).otherwise(1).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    whole = c.agg(F.sum("n").alias("whole"))
    return c.crossJoin(F.broadcast(whole)).select("y", "n", F.round(F.col("whole") / (2 * F.col("n")), 9).alias("weight"))


@query("with s as (select gen_id, regexp_replace(text, '\\s+', '', 'g') as s from gen_test where text is not null), g as (select gen_id, unnest([substr(s, i, 6) for i in range(1, greatest(length(s) - 4, 1))]) as g from s where length(s) >= 6), m as (select gen_id, max(n) as m from (select gen_id, g, count(*) as n from g group by all) group by gen_id) select s.gen_id, coalesce(m.m, 0)::int as most, coalesce(m.m, 0) > 20 as acute from s left join m using (gen_id)")
def q_acute_collapse(spark, d):
    """F8 A37."""
    x = table(spark, d, "gen_test").where("text is not null").select("gen_id", K.most_repeated_gram_udf("text").alias("most"))
    return x.withColumn("acute", F.col("most") > 20)


@query("with w as (select gen_id, unnest(regexp_split_to_array(text, '[ \\t\\n\\r]+')) as w from gen_test where text is not null), c as (select gen_id, w, count(*) as n from w where w <> '' group by all) select gen_id, max(n) as most, max(n) > 30 as word_collapse, round(1 - count(*) / sum(n)::double, 9) as rep1 from c group by gen_id")
def q_word_repeat(spark, d):
    """Exploded and counted, with partial aggregation."""
    w = table(spark, d, "gen_test").where("text is not null").select("gen_id", F.explode(F.split("text", r"[ \t\n\r]+")).alias("w")).where("w <> ''")
    c = w.groupBy("gen_id", "w").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("gen_id").agg(F.max("n").alias("most"), (F.max("n") > 30).alias("word_collapse"), F.round(1 - F.count(F.lit(1)) / F.sum("n"), 9).alias("rep1"))


@query("with w as (select gen_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '') as w from gen_test where text is not null), g as (select gen_id, [list_aggregate(w[i:i+2], 'string_agg', ' ') for i in range(1, greatest(len(w) - 1, 1))] as g from w where len(w) >= 3) select gen_id, round(1 - len(list_distinct(g)) / len(g)::double, 9) as rep3 from g")
def q_rep3(spark, d):
    """F11."""
    w = F.filter(F.split("text", r"[ \t\n\r]+"), lambda x: x != "")
    x = table(spark, d, "gen_test").where("text is not null").select("gen_id", w.alias("w")).where(F.size("w") >= 3)
    return x.select("gen_id", F.round(X.repeated_gram_share(F.col("w"), 3), 9).alias("rep3"))


@query(r"with w as (select gen_id, list_filter(regexp_split_to_array(text, '[\s\p{Z}]+'), lambda x: x <> '') as w from gen_test where text is not null), e as (select gen_id, p, unnest(list_filter(range(p + 1, greatest(len(w), p) + 1), lambda i: w[i] = w[i - p])) as i from w, (values (1), (2), (3), (4)) v(p)), g as (select gen_id, p, i - row_number() over (partition by gen_id, p order by i) as g from e), l as (select gen_id, max(n) as l from (select gen_id, p, g, count(*) + p as n from g group by gen_id, p, g) group by gen_id) select gen_test.gen_id, coalesce(l.l, 0)::int as loop from gen_test left join l using (gen_id) where text is not null")
def q_longest_loop(spark, d):
    """Words in the longest stretch that repeats itself."""
    return table(spark, d, "gen_test").where("text is not null").select("gen_id", K.longest_loop_udf("text").alias("loop"))


@query()
def q_loops(spark, d):
    """Longest loop of each output, and the mean by round."""
    x = table(spark, d, "gen_test").where("text is not null").select("round", K.longest_loop_udf("text").alias("loop"), K.most_repeated_gram_udf("text").alias("most"), F.length("text").alias("n"))
    return x.groupBy("round").agg(F.count(F.lit(1)).alias("n"), (100 * ST.rate(F.col("most") > 20)).alias("collapse_pct"), F.avg("loop").alias("mean_loop"), F.avg("n").alias("mean_length"))


@query()
def q_redundancy(spark, d):
    """Sentence reuse for 1,000 pairs by arm, against the first round."""
    x = table(spark, d, "gen_test").where("text is not null").repartition("gen_id").select("round", K.redundancy_udf(X.sentences(F.col("text"))).alias("r"))
    g = x.groupBy("round").agg(F.avg("r.reused").alias("reused"), F.avg("r.approximate").alias("approximate"))
    base = g.where("round = 0").select(F.col("reused").alias("base"))
    return g.join(F.broadcast(base), F.lit(True), "left").select("round", "reused", "approximate", (F.col("reused") / F.nullif(F.col("base"), F.lit(0.0))).alias("times_base"))


@query("with s as (select g.gen_id, regexp_replace(p.ai_text, '\\s+', '', 'g') as a, regexp_replace(g.text, '\\s+', '', 'g') as b from gen_test g join pairs p using (pair_id) where g.text is not null and p.ai_text is not null), n as (select gen_id, list_distinct([substr(a, i, 12) for i in range(1, greatest(length(a) - 10, 1))]) as x, list_distinct([substr(b, i, 12) for i in range(1, greatest(length(b) - 10, 1))]) as y, length(a) as la, length(b) as lb from s) select gen_id, round(case when la < 12 then 0.0 when lb < 12 then 0.0 else 100.0 * len(list_intersect(x, y)) / len(x) end, 6) as overlap from n")
def q_ngram_overlap(spark, d):
    """F17 F18 U9."""
    x = table(spark, d, "gen_test").where("text is not null").join(table(spark, d, "pairs").where("ai_text is not null").select("pair_id", "ai_text"), "pair_id")
    return x.select("gen_id", F.round(X.copied_gram_share(F.regexp_replace("ai_text", r"[ \t\n\f\r]+", ""), F.regexp_replace("text", r"[ \t\n\f\r]+", "")), 6).alias("overlap"))


@query()
def q_preservation(spark, d):
    """What each output keeps of its pair's human text, averaged by round."""
    g = table(spark, d, "gen_test").where("text is not null").join(table(spark, d, "pairs").where("human_text is not null").select("pair_id", "human_text"), "pair_id")
    h, t = F.col("human_text"), F.col("text")
    x = g.select("round", (F.length(t) / F.greatest(F.length(h), F.lit(1)) * 100).alias("len_ratio"), X.multiset_surplus(X.number_tokens(h), X.number_tokens(t)).alias("missing"), X.multiset_surplus(X.number_tokens(t), X.number_tokens(h)).alias("invented"), F.size(X.directions_lost(h, t)).alias("dir_lost"), (F.regexp_count(t, F.lit(X.NEGATION)) - F.regexp_count(h, F.lit(X.NEGATION))).alias("neg_delta"), X.copied_gram_share(h, t).alias("overlap"), K.longest_common_udf(h, t).alias("lcs"))
    return x.groupBy("round").agg(*[F.avg(c).alias(c) for c in ("len_ratio", "missing", "invented", "neg_delta", "overlap", "lcs")], ST.rate(F.col("dir_lost") > 0).alias("any_dir_lost"))


@query("with c as (select label, i, avg(embedding[i]) as m from embeddings, range(1, 65) t(i) where embedding is not null group by label, i), v as (select label, list(m order by i) as m from c group by label) select vec_id, e.label, round(list_inner_product(embedding::double[], m) / (sqrt(list_inner_product(embedding::double[], embedding::double[])) * sqrt(list_inner_product(m, m))), 6) as cos from embeddings e join v using (label)")
def q_cosine_centroid(spark, d):
    """cosine to the mean vector of the label."""
    e = table(spark, d, "embeddings").where("embedding is not null")
    m = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    c = m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("m"))
    return e.join(F.broadcast(c), "label").select("vec_id", "label", F.round(X.cosine(F.col("embedding"), F.col("m")), 6).alias("cos"))


@query("select source, count(*) as n, count(distinct doc_id) as n_ids, round(avg(length(text)), 6) as mean_length, round(stddev_pop(length(text)) + 1e-8, 6) as std_length from documents where text is not null group by source")
def q_source_stats(spark, d):
    """A3 A23 A33."""
    n = F.length("text")
    return table(spark, d, "documents").where("text is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_ids"), F.round(F.avg(n), 6).alias("mean_length"), F.round(F.stddev_pop(n) + 1e-8, 6).alias("std_length"))


@query("with k as (select user_id, event_type, max(event_id) filter (where event_type <> 'error') as done from events group by all) select distinct e.user_id, e.event_type from events e where e.event_type = 'error' or not exists (select 1 from events f where f.user_id = e.user_id and f.event_type = 'purchase')")
def q_resume_pending(spark, d):
    """Keys without a success yet."""
    e = table(spark, d, "events")
    done = e.where("event_type = 'purchase'").select("user_id").distinct()
    return e.where("event_type <> 'error'").join(done, "user_id", "left_anti").select("user_id", "event_type").unionByName(e.where("event_type = 'error'").select("user_id", "event_type")).distinct()


@query("select user_id, arg_max(event_type, case when event_type <> 'error' then 1e15 else 0 end - event_id) as state from events group by user_id")
def q_success_wins(spark, d):
    """The first success of a key; an error only where there is none."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct((F.col("event_type") != "error").cast("int"), -F.col("event_id"))).alias("state"))


@query("select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(avg(l_discount), 9) as avg_disc, count(*) as n from lineitem group by 1, 2")
def q_group_means(spark, d):
    """A3 over the star schema."""
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.avg("l_discount"), 9).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("with c as (select r_name, o_orderpriority as priority, count(*) as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2) select r.r_name as region, p.priority, coalesce(c.n, 0) as n from region r cross join (select distinct o_orderpriority as priority from orders) p left join c on c.r_name = r.r_name and c.priority = p.priority")
def q_dense_matrix(spark, d):
    """Every cell of region x priority, empty ones as 0."""
    orders = table(spark, d, "orders")
    c = orders.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("region"), F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))
    cells = table(spark, d, "region").select(F.col("r_name").alias("region")).crossJoin(orders.select(F.col("o_orderpriority").alias("priority")).distinct())
    return cells.join(c, ["region", "priority"], "left").na.fill(0, ["n"])


@query()
def q_linear_probe(spark, d):
    """Character-gram probe trained on train, AUC on the others."""
    from pairloom.operators.probes import text_probe

    p = table(spark, d, "pairs").withColumn("s", R.clean_split(F.col("split")))
    pair = F.array(F.struct(F.lit(0.0).alias("y"), F.col("human_text").alias("text")), F.struct(F.lit(1.0).alias("y"), F.col("ai_text").alias("text")))
    rows = p.select("s", F.explode(pair).alias("x")).select("s", "x.y", "x.text").where("text <> ''")
    return text_probe(rows.where("s = 'train'"), rows.where("s in ('dev', 'test')"), "text", "y")


@query()
def q_telling_words(spark, d):
    """M4: words that tell human from machine documents."""
    from pairloom.operators.probes import telling_words

    x = table(spark, d, "documents").where("origin is not null and text is not null").select("text", (F.col("origin") != "human").cast("double").alias("y"))
    return telling_words(x, "text", "y")


@query()
def q_out_of_fold(spark, d):
    """Each document scored by a probe fitted without its fold."""
    from pairloom.operators.probes import out_of_fold

    x = table(spark, d, "documents").where("origin is not null and text is not null").select("doc_id", "text", (F.col("origin") != "human").cast("double").alias("y"))
    scored = out_of_fold(S.folds(x, "doc_id", 3), "text", "y", "fold", 3)
    return scored.select("doc_id", "fold", "y", "p")


@query()
def q_cross_validated(spark, d):
    """M3: five-fold AUC of a probe for human against machine documents."""
    from pairloom.operators.probes import cross_validated

    x = table(spark, d, "documents").where("origin is not null and text is not null").select("doc_id", "text", (F.col("origin") != "human").cast("double").alias("y"))
    return cross_validated(x, "doc_id", "text", "y")


from pairloom.plans import gates  # noqa: E402, F401  registers more queries
