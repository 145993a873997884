"""Further queries: gates, training rows, samples, audits and text features. Imported by queries.py."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairloom.functions import kernels as K
from pairloom.functions import text as X
from pairloom.operators import records as R
from pairloom.operators import splits as S
from pairloom.operators import stats as ST
from pairloom.plans.queries import ARTICLE, query
from pairloom.sources.readers import table

# The prompt, the instruction in it, and styles.
TEMPLATE = "다음 글을 다시 쓰세요.\n\n{text}"
STYLE_AI, STYLE_HUMAN = 0, 1
BLANK = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"
NUMBER_SQL = r"\p{Nd}+(?:[.,]\p{Nd}+)*" + BLANK + r"*(?:%|퍼센트|명|건|개|년|월|일|시간|배|원|억|만|천)?"
PAIRED = "select g.gen_id, g.round, g.text as t, p.human_text as h, p.ai_text as x, p.domain from gen_test g join pairs p using (pair_id) where g.text is not null and p.human_text is not null and p.ai_text is not null"


def _paired(spark, d):
    p = table(spark, d, "pairs").where("human_text is not null and ai_text is not null").select("pair_id", "domain", F.col("human_text").alias("h"), F.col("ai_text").alias("x"))
    return table(spark, d, "gen_test").where("text is not null").select("gen_id", "pair_id", "round", F.col("text").alias("t")).join(p, "pair_id")


@query(
    rf"""with r as ({PAIRED}),
    s as (select gen_id, regexp_replace(t, '{BLANK}+', '', 'g') as s from r),
    g as (select gen_id, unnest([substr(s, i, 6) for i in range(1, greatest(length(s) - 4, 1))]) as g from s where length(s) >= 6),
    m as (select gen_id, max(n) as m from (select gen_id, g, count(*) as n from g group by all) group by gen_id),
    v as (select r.gen_id, list_inner_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_inner_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_inner_product(b.embedding::double[], b.embedding::double[]))) as cos from r join embeddings a on a.vec_id = r.gen_id join gen_test q on q.gen_id = r.gen_id join embeddings b on b.vec_id = q.pair_id where a.embedding is not null and b.embedding is not null),
    c as (select domain, count(*) as n, quantile_cont(length(t) / greatest(length(x), 1)::double, 0.5) as ratio, count(*) filter (where regexp_matches(t, '(?i)(^|\n){BLANK}*(#{{1,6}}{BLANK}*)?(분석 결과|자연도 등급|주요 변경 사항|의미 보존 검증)')) as bad, avg(cos) as cos, 100 * avg(case when coalesce(m, 0) > 20 then 1.0 else 0.0 end) as acute from r left join m using (gen_id) left join v using (gen_id) group by domain)
    select domain, n, round(ratio, 9) as ratio, bad, round(cos, 6) as cos, round(acute, 6) as acute, concat_ws('; ', case when ratio between 0.65 and 1.35 then null else 'length' end, case when bad > greatest(1, round(0.05 * n)) then 'contaminated' end, case when cos < 0.85 then 'meaning' end, case when acute > 5 then 'collapse' end) as reasons, ratio between 0.65 and 1.35 and bad <= greatest(1, round(0.05 * n)) and not coalesce(cos < 0.85, false) and acute <= 5 as passed from c"""
)
def q_quality_gate(spark, d):
    """Length, contamination, likeness in meaning, acute collapse; vectors are those of the embeddings table."""
    e = table(spark, d, "embeddings").where("embedding is not null").select("vec_id", "embedding")
    r = _paired(spark, d)
    v = r.select("gen_id", "pair_id").join(e.select(F.col("vec_id").alias("gen_id"), F.col("embedding").alias("a")), "gen_id").join(e.select(F.col("vec_id").alias("pair_id"), F.col("embedding").alias("b")), "pair_id").select("gen_id", X.cosine(F.col("a"), F.col("b")).alias("cos"))
    x = r.join(v, "gen_id", "left").withColumn("most", K.most_repeated_gram_udf("t"))
    out = ST.quality_gate(x, ["domain"], F.length("t") / F.greatest(F.length("x"), F.lit(1)), F.col("t").rlike(X.CONTAMINATION), F.col("cos"), F.col("most") > 20)
    return out.withColumns({"ratio": F.round("ratio", 9), "cos": F.round("cos", 6), "acute": F.round("acute", 6)})


@query(
    """with p as (select domain, d_human, d_ai from pairs where d_human is not null and d_ai is not null),
    o as (select domain, d_human as s, row_number() over (partition by domain order by d_human) as r, count(*) over (partition by domain) as n from p),
    t as (select domain, min(s) as tau from o where r >= ceil(0.95 * (n - 1)) + 1 group by domain),
    g as (select p.domain, any_value(tau) as tau, avg(case when d_human > tau then 1.0 else 0.0 end) as fpr, avg(case when d_ai > tau then 1.0 else 0.0 end) as tpr from p join t using (domain) group by p.domain)
    select domain, round(tau, 9) as tau, round(fpr, 9) as fpr, round(tpr, 9) as tpr, fpr > 0.08 or tpr < 0.80 as collapsed from g"""
)
def q_detector_gate(spark, d):
    """A detector has collapsed if too many humans lie above its threshold or too few rewrites do."""
    p = table(spark, d, "pairs").where("d_human is not null and d_ai is not null").select("domain", "d_human", "d_ai")
    x = p.join(ST.tau_higher_by(p, ["domain"], "d_human", 0.05), "domain")
    return ST.detector_gate(x, ["domain"], "d_human", "d_ai", "tau").withColumns({c: F.round(c, 9) for c in ("tau", "fpr", "tpr")})


@query("select pair_id, 'trans' as kind, ai_text as src, human_text as tgt, 1 as style from pairs where lower(trim(split)) = 'train' and ai_text <> '' and human_text <> '' union all select pair_id, 'recon', ai_text, ai_text, 0 from pairs where lower(trim(split)) = 'train' and ai_text <> '' and human_text <> ''")
def q_training_rows(spark, d):
    """Each training pair as a transfer and a reconstruction."""
    p = table(spark, d, "pairs").where(R.clean_split(F.col("split")) == "train").where("ai_text <> '' and human_text <> ''")
    row = lambda kind, tgt, style: F.struct(F.lit(kind).alias("kind"), F.col("ai_text").alias("src"), F.col(tgt).alias("tgt"), F.lit(style).alias("style"))
    return p.select("pair_id", F.explode(F.array(row("trans", "human_text", STYLE_HUMAN), row("recon", "ai_text", STYLE_AI))).alias("r")).select("pair_id", "r.*")


@query(f"with x as (select pair_id, case when doc_id like domain || '-%' then doc_id else domain || '-' || doc_id end as doc, human_text, row_number() over (partition by domain, doc_id order by file_pos, line_pos, pair_id) as r from pairs where doc_id is not null and domain is not null and human_text <> '') select pair_id, doc, replace('{TEMPLATE}', '{{text}}', human_text) as prompt, length(human_text) as target_char, floor(length(human_text) * 1.6)::int as max_tokens, 42 + pair_id + 1000 * 2 as seed from x where r = 1")
def q_prompts(spark, d):
    """A filled template for each article, with a token budget and the seed of its third attempt."""
    p = table(spark, d, "pairs").where("doc_id is not null and domain is not null and human_text <> ''").select("pair_id", "doc_id", "domain", "human_text", "file_pos", "line_pos")
    one = R.first_wins(p, F.struct("domain", "doc_id"), ["file_pos", "line_pos", "pair_id"])
    n = F.length("human_text")
    return one.select("pair_id", R.with_prefix(F.col("doc_id"), F.col("domain")).alias("doc"), X.filled(TEMPLATE, text=F.col("human_text")).alias("prompt"), n.alias("target_char"), X.token_budget(n, 1.6).alias("max_tokens"), X.attempt_seed(42, F.col("pair_id"), F.lit(2)).alias("seed"))


@query("with l as (select domain, 0 as y, length(human_text) as s from pairs where human_text is not null union all select domain, 1, length(ai_text) from pairs where ai_text is not null), r as (select *, rank() over (partition by domain order by s) + (count(*) over (partition by domain, s) - 1) / 2.0 as r from l) select domain, round((sum(case when y = 1 then r else 0 end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 9) as auroc from r group by domain")
def q_length_auc(spark, d):
    """How well length alone tells the two sides apart."""
    p = table(spark, d, "pairs")
    side = lambda y, c: F.struct(F.lit(y).alias("y"), F.length(c).cast("double").alias("s"))
    x = p.select("domain", F.explode(F.array(side(0, "human_text"), side(1, "ai_text"))).alias("v")).select("domain", "v.*")
    return ST.auroc(x, ["domain"], "s", "y").select("domain", F.round("auroc", 9).alias("auroc"))


@query("with s as (select e.label, list_inner_product(e.embedding::double[], f.embedding::double[]) / (sqrt(list_inner_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_inner_product(f.embedding::double[], f.embedding::double[]))) as c from embeddings e join embeddings f on f.vec_id = e.vec_id + 1 where e.embedding is not null and f.embedding is not null) select label, round(avg(c), 6) as mean, round(quantile_cont(c, 0.1), 6) as p10, round(quantile_cont(c, 0.5), 6) as median from s group by label")
def q_similarity_p10(spark, d):
    """Mean, tenth percentile and median of a similarity (of each vector and the next)."""
    e = table(spark, d, "embeddings").where("embedding is not null")
    x = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("f")), "vec_id").select("label", X.cosine(F.col("embedding"), F.col("f")).alias("c"))
    q = lambda p: F.round(F.percentile("c", F.lit(p)), 6)
    return x.groupBy("label").agg(F.round(F.avg("c"), 6).alias("mean"), q(0.1).alias("p10"), q(0.5).alias("median"))


@query(f"with r as ({PAIRED}), g as (select gen_id, arm from gen_test) select arm, count(*) as n, sum(length(t))::bigint as chars, round(avg(length(t) / greatest(length(x), 1)::double), 9) as mean, round(min(length(t) / greatest(length(x), 1)::double), 9) as least, round(max(length(t) / greatest(length(x), 1)::double), 9) as most from r join g using (gen_id) group by arm")
def q_attainment(spark, d):
    """Characters made, and the lengths reached against those asked for."""
    ratio = F.length("t") / F.greatest(F.length("x"), F.lit(1))
    x = _paired(spark, d).join(table(spark, d, "gen_test").select("gen_id", "arm"), "gen_id")
    return x.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("t")).cast("bigint").alias("chars"), F.round(F.avg(ratio), 9).alias("mean"), F.round(F.min(ratio), 9).alias("least"), F.round(F.max(ratio), 9).alias("most"))


@query("with x as (select pair_id, generator, row_number() over (partition by generator order by file_pos, line_pos, pair_id) as r, count(*) over (partition by generator) as k, count(*) over () as n from pairs where generator is not null), y as (select pair_id, generator from x where r <= greatest(1, round_even(300.0 * k / n, 0))) select pair_id, generator from y order by md5(concat('42:', pair_id::varchar)), pair_id limit 300")
def q_legacy_sample(spark, d):
    """Each group's first rows by rounded share, one at least, in seeded order, cut to size."""
    p = table(spark, d, "pairs").where("generator is not null").select("pair_id", "generator", "file_pos", "line_pos")
    return S.legacy_sample(p, "generator", 300, ["file_pos", "line_pos", "pair_id"], "pair_id").select("pair_id", "generator")


@query("with s as (select source, count(*) as n from documents where source is not null group by source), k as (select *, row_number() over (order by n desc, source) - 1 as i, greatest(1, count(*) over () // 8) as step from s), o as (select *, row_number() over (order by i % step <> 0, i) as place from k), b as (select *, coalesce(sum(n) over (order by place rows between unbounded preceding and 1 preceding), 0) as before from o) select source, n from b where before < (select count(*) from documents) / 4")
def q_det_spread(spark, d):
    """Sources spread over the order of sizes until a quarter of the documents is reached."""
    docs = table(spark, d, "documents")
    s = docs.where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return S.group_quota(s, "source", "n", docs.count() / 4, "spread")


@query("select distinct doc_id from human_pool where doc_id is not null and doc_id not in (select doc_id from pairs where lower(trim(split)) = 'train' and doc_id is not null)")
def q_frozen_only(spark, d):
    """The pool without the documents that a classifier was trained on."""
    trained = table(spark, d, "pairs").where(R.clean_split(F.col("split")) == "train").select("doc_id")
    return R.without_trained(table(spark, d, "human_pool").select("doc_id"), trained, "doc_id")


@query("with k as (select pair_id, generator as g, row_number() over (partition by generator order by pair_id) - 1 as r, count(*) over (partition by generator) as m from pairs where generator is not null), c as (select g, any_value(m) as m, row_number() over (order by g) - 1 as i, count(*) over () as n_groups from k group by g), i as (select unnest(range(0, 1000)) as draw), p as (select draw, (concat('0x', md5(concat('42:g:', draw)))::uhugeint % (select any_value(n_groups) from c)::uhugeint)::int as i, concat('0x', md5(concat('42:r:', draw)))::uhugeint as h from i), q as (select draw, c.g, (h % m::uhugeint)::int as r from p join c using (i)) select q.draw, k.pair_id from q join k on k.g = q.g and k.r = q.r")
def q_resampled(spark, d):
    """1,000 draws with replacement, groups of equal weight however large."""
    p = table(spark, d, "pairs").where("generator is not null").select("pair_id", "generator")
    return S.resampled(p, "generator", "pair_id", 1000).select("draw", "pair_id")


STYLE_SQL = r"""f as (select doc_id, domain, (length(text) - length(replace(text, '또한', ''))) / 2.0 / greatest(length(text), 1) * 1000 as a, ((length(text) - length(replace(text, '것이다', ''))) / 3.0 + (length(text) - length(replace(text, '것으로', ''))) / 3.0) / greatest(length(text), 1) * 1000 as b, greatest(1, len(list_filter(regexp_split_to_array(regexp_replace(trim(text, E' \t\n\r'), '([.!?다])[ \t\n\r]+', E'\\1\x01', 'g'), '\x01'), lambda x: x <> '')))::double as s, greatest(length(text), 1)::double as n from documents where text is not null)"""


@query(f"with {STYLE_SQL} select doc_id, round(a, 6) as ttohan, round(b, 6) as geosida, round(s / n * 1000, 6) as sentences, round(n / s, 6) as sentence_chars from f")
def q_style_features(spark, d):
    """The four features that need no tagger."""
    x = table(spark, d, "documents").where("text is not null")
    return x.select("doc_id", *[F.round(c, 6).alias(n) for n, c in X.style_features(F.col("text")).items()])


@query(f"with {STYLE_SQL}, v as (select doc_id, a, b, s / n * 1000 as c, n / s as e from f), m as (select avg(a) as ma, stddev_pop(a) + 1e-8 as sa, avg(b) as mb, stddev_pop(b) + 1e-8 as sb, avg(c) as mc, stddev_pop(c) + 1e-8 as sc, avg(e) as me, stddev_pop(e) + 1e-8 as se from v) select doc_id, round((abs((a - ma) / sa) + abs((b - mb) / sb) + abs((c - mc) / sc) + abs((e - me) / se)) / 4, 5) as distance from v, m")
def q_style_distance(spark, d):
    """Mean |z| of the features."""
    x = table(spark, d, "documents").where("text is not null")
    f = x.select("doc_id", *[c.alias(n) for n, c in X.style_features(F.col("text")).items()])
    return ST.mean_abs_z(f, [c for c in f.columns if c != "doc_id"]).select("doc_id", F.round("distance", 5).alias("distance"))


@query(f"with r as ({PAIRED}), n as (select gen_id, list_distinct([substr(x, i, 12) for i in range(1, greatest(length(x) - 10, 1))]) as a, t, length(x) as l from r) select gen_id, round(case when l < 12 then 0.0 else len(list_filter(a, lambda v: contains(t, v))) / len(a)::double end, 9) as overlap from n")
def q_overlap_blanks(spark, d):
    """share of an input's runs of twelve characters, blanks kept, that stand in the output."""
    return _paired(spark, d).select("gen_id", F.round(K.copied_share_udf("x", "t") / 100, 9).alias("overlap"))


def _numbers(c: str) -> str:
    return rf"list_transform(regexp_extract_all({c}, '{NUMBER_SQL}'), lambda v: regexp_replace(v, '{BLANK}+', '', 'g'))"


@query(rf"with r as ({PAIRED}), t as (select gen_id, {_numbers('x')} as a, {_numbers('t')} as b from r), u as (select gen_id, 0 as side, unnest(a) as v from t union all select gen_id, 1, unnest(b) from t), c as (select gen_id, v, count(*) filter (where side = 0) as na, count(*) filter (where side = 1) as nb from u group by all) select gen_id, sum(greatest(na - nb, 0))::bigint as missing, sum(greatest(nb - na, 0))::bigint as invented from c group by gen_id")
def q_number_multiset(spark, d):
    """Numbers with their units, lost and invented, as multisets."""
    side = lambda c, a, b: F.transform(X.number_tokens(F.col(c)), lambda v: F.struct(v.alias("v"), F.lit(a).alias("a"), F.lit(b).alias("b")))
    c = _paired(spark, d).select("gen_id", F.explode(F.concat(side("x", 1, 0), side("t", 0, 1))).alias("x")).groupBy("gen_id", "x.v").agg(F.sum("x.a").alias("a"), F.sum("x.b").alias("b"))
    return c.groupBy("gen_id").agg(F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("missing"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("invented"))


DIRECTION_SQL = [("증가", "증가|늘어|상승|높아|많아", None), ("감소", "감소|줄어|하락|낮아|적어", None), ("유의", "유의", "유의(하지|하지 않)"), ("비유의", "유의하지 않|유의미하지 않|비유의", None), ("정적", r"정\(\+\)|정적 (?:상관|영향)|양(?:\(\+\)|의 상관)", None), ("부적", r"부\(-\)|부적 (?:상관|영향)|음(?:\(-\)|의 상관)", None)]


def _says(c: str, p: str, but: str | None) -> str:
    return f"regexp_matches({f'''regexp_replace({c}, '{but}', '', 'g')''' if but else c}, '{p}')"


@query(rf"with r as ({PAIRED}) select gen_id, round_even(length(t) / greatest(length(h), 1)::double * 100, 1) as len_ratio, concat_ws(',', {', '.join(f'''case when {_says('h', p, b)} and not {_says('t', p, b)} then '{k}' end''' for k, p, b in DIRECTION_SQL)}) as dir_lost, (len(regexp_extract_all(t, '않|못하|못한|없|아니|불가|미흡|비유의')) - len(regexp_extract_all(h, '않|못하|못한|없|아니|불가|미흡|비유의')))::int as neg_delta from r")
def q_preserved(spark, d):
    """What each output keeps of its pair's human text: length, directions, negations."""
    h, t = F.col("h"), F.col("t")
    return _paired(spark, d).select("gen_id", F.bround(F.length(t) / F.greatest(F.length(h), F.lit(1)) * 100, 1).alias("len_ratio"), F.array_join(X.directions_lost(h, t), ",").alias("dir_lost"), (F.regexp_count(t, F.lit(X.NEGATION)) - F.regexp_count(h, F.lit(X.NEGATION))).alias("neg_delta"))


@query("select g.gen_id, p.domain, s.display_name from gen_test g join pairs p using (pair_id) join (select source, any_value(display_name) as display_name from sources where source is not null group by source) s on s.source = p.source")
def q_three_way(spark, d):
    """Outputs, pairs and sources, an error where one is missing."""
    s = table(spark, d, "sources").where("source is not null").groupBy("source").agg(F.first("display_name").alias("display_name"))
    p = table(spark, d, "pairs").select("pair_id", "domain", "source")
    x = R.joined_complete(table(spark, d, "gen_test").select("gen_id", "pair_id"), p, "pair_id")
    return R.joined_complete(x, s, "source").select("gen_id", "domain", "display_name")


@query("with s as (select kind, id, max(score) as v from pool_scores where score is not null and kind in ('g1', 'g2') group by all) select p.pair_id, case when lower(trim(p.split)) = 'train' then a.v else b.v end as score, case when lower(trim(p.split)) = 'train' then 'oof' else 'final' end as src from pairs p left join s a on a.kind = 'g1' and a.id = p.pair_id::varchar left join s b on b.kind = 'g2' and b.id = p.pair_id::varchar where p.split is not null and case when lower(trim(p.split)) = 'train' then a.v else b.v end is not null")
def q_score_source(spark, d):
    """The out-of-fold score for train, the final one elsewhere; a row without its score would be an error."""
    s = table(spark, d, "pool_scores").where("score is not null").groupBy(F.col("id").alias("k")).pivot("kind", ["g1", "g2"]).agg(F.max("score"))
    p = table(spark, d, "pairs").where("split is not null").select("pair_id", R.clean_split(F.col("split")).alias("s"), F.col("pair_id").cast("string").alias("k"))
    here = p.join(s, "k").where(F.when(F.col("s") == "train", F.col("g1")).otherwise(F.col("g2")).isNotNull())
    return R.score_source(here, F.col("s") == "train", "g1", "g2").select("pair_id", "score", "src")


@query(f"with t as (select distinct domain, {ARTICLE} as a from pairs where lower(trim(split)) = 'train' and doc_id is not null) select p.pair_id from (select pair_id, domain, {ARTICLE} as a from pairs where lower(trim(split)) = 'test') p where exists (select 1 from t where t.domain = p.domain and t.a = p.a)")
def q_semi_candidates(spark, d):
    """Rows whose article is in a list."""
    x = table(spark, d, "pairs").select("pair_id", "domain", R.article_id(F.col("doc_id")).alias("a"), R.clean_split(F.col("split")).alias("s"))
    return x.where("s = 'test'").join(x.where("s = 'train'").select("domain", "a"), ["domain", "a"], "left_semi").select("pair_id")


@query("with m as (select pair_id, row_number() over (order by md5(concat('7:', pair_id::varchar))) as place from pairs where lower(trim(split)) = 'test' qualify place <= 10) select m.place, m.pair_id, p.source from m join pairs p using (pair_id)")
def q_manifest(spark, d):
    """The ten ids of a manifest, in its order, each of which must be there once and in the test split."""
    p = table(spark, d, "pairs")
    test = p.where(R.clean_split(F.col("split")) == "test")
    m = test.select("pair_id", S.seeded("pair_id", 7).alias("h")).orderBy("h").limit(10)
    m = m.withColumn("place", F.row_number().over(Window.orderBy("h"))).drop("h")  # ten rows
    return R.manifest_rows(m, test.select("pair_id", "source"), "pair_id", 10).select("place", "pair_id", "source")


@query("with r as (select distinct pair_id from gen_test where round = 3), s as (select pair_id from pairs order by md5(concat('42:', pair_id::varchar)), pair_id limit 100) select pair_id from r union all select pair_id from s where not exists (select 1 from r)")
def q_reference_or_sample(spark, d):
    """The ids of a reference run, or a seeded sample where there is none."""
    return R.given_or_sample(table(spark, d, "gen_test").where("round = 3").select("pair_id").distinct(), table(spark, d, "pairs").select("pair_id"), "pair_id", 100)


@query("with g as (select pair_id, round, min(text) as text from gen_test where round in (0, 1) and text is not null group by all) select p.pair_id, p.ai_text as input, a.text as first, b.text as second, p.human_text as human from pairs p join g a on a.pair_id = p.pair_id and a.round = 0 join g b on b.pair_id = p.pair_id and b.round = 1")
def q_review_rows(spark, d):
    """Input, two outputs and the human text side by side."""
    g = table(spark, d, "gen_test").where("round in (0, 1) and text is not null").groupBy("pair_id").pivot("round", [0, 1]).agg(F.min("text"))
    wide = g.where("`0` is not null and `1` is not null")
    return table(spark, d, "pairs").select("pair_id", F.col("ai_text").alias("input"), F.col("human_text").alias("human")).join(wide, "pair_id").select("pair_id", "input", F.col("0").alias("first"), F.col("1").alias("second"), "human")


@query("with h as (select pair_id, count(*) as n from gen_test where round < 2 group by pair_id) select g.gen_id, (coalesce(h.n, 0) + row_number() over (partition by g.pair_id order by g.gen_id))::bigint as candidate from gen_test g left join h using (pair_id) where g.round >= 2")
def q_next_index(spark, d):
    """New candidates are numbered on from those that exist."""
    g = table(spark, d, "gen_test")
    return R.numbered_on(g.where("round >= 2"), g.where("round < 2"), "pair_id", "gen_id").select("gen_id", "candidate")


@query("with x as (select doc_id, (row_number() over (order by length(text) desc, doc_id) - 1) // 32 as batch from documents where text is not null) select doc_id, batch::bigint as batch from x")
def q_length_batches(spark, d):
    """Documents of like length in one batch; their ids restore the order."""
    return S.length_batches(table(spark, d, "documents").where("text is not null").select("doc_id", F.length("text").alias("n")), "n", "doc_id", 32)


@query("with x as (select doc_id, row_number() over (order by md5(concat('42:', doc_id::varchar)), doc_id) as r, count(*) over () as n from documents) select doc_id, case when r <= floor(0.8 * n) then 'train' when r <= floor(0.9 * n) then 'dev' else 'test' end as part from x")
def q_ratio_cut(spark, d):
    """A seeded order cut at 80 and 90 %."""
    return S.ratio_cut(table(spark, d, "documents").select("doc_id"), "doc_id", (0.8, 0.9)).select("doc_id", "part")


@query("with x as (select source, min(pair_id) as first from pairs where source is not null group by source) select source, row_number() over (order by first) as place from x")
def q_ordered_unique(spark, d):
    """Sources in the order of their first row."""
    x = table(spark, d, "pairs").where("source is not null").groupBy("source").agg(F.min("pair_id").alias("first"))  # a row for each source
    return x.select("source", F.row_number().over(Window.orderBy("first")).alias("place"))


@query("select count(*) as n, count(*) filter (where arm in ('xai', 'human')) as reference, count(*) filter (where arm not in ('xai', 'human') and coalesce(trim(text), '') = '') as blank, count(*) filter (where arm not in ('xai', 'human') and trim(text) <> '' and not exists (select 1 from pairs p where p.pair_id = g.pair_id)) as missed from gen_test g")
def q_skipped(spark, d):
    """Rows that are left out, and why."""
    p = table(spark, d, "pairs").select("pair_id", F.lit(True).alias("here"))
    x = table(spark, d, "gen_test").join(p, "pair_id", "left")
    ref, blank = F.col("arm").isin("xai", "human"), F.coalesce(F.trim("text"), F.lit("")) == ""
    return x.agg(F.count(F.lit(1)).alias("n"), F.count_if(ref).alias("reference"), F.count_if(~ref & blank).alias("blank"), F.count_if(~ref & ~blank & F.col("here").isNull()).alias("missed"))


@query("select source, sha256(string_agg(concat(doc_id, ':', sha256(text)), chr(10) order by doc_id)) as digest from documents where text is not null group by source")
def q_source_digest(spark, d):
    """A digest of each source's members in order."""
    return X.member_digest(table(spark, d, "documents").where("text is not null"), "source", "doc_id", "text")


@query(rf"with x as (select pair_id, regexp_extract(human_text, '[0-9][0-9,]*', 0) as raw, replace(replace(replace(human_text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as html, replace(replace(human_text, E'\r\n', E'\n'), E'\r', E'\n') as text from pairs where human_text is not null) select pair_id, case when raw <> '' then try_cast(replace(raw, ',', '') as double) end as number, md5(html) as html, md5(text) as text from x")
def q_plain_forms(spark, d):
    """numbers read, HTML escaped, line ends made alike."""
    t = F.col("human_text")
    raw = F.regexp_extract(t, "[0-9][0-9,]*", 0)
    return table(spark, d, "pairs").where(t.isNotNull()).select("pair_id", X.parsed_number(raw).alias("number"), F.md5(X.html_escaped(t).cast("binary")).alias("html"), F.md5(X.plain_lines(t).cast("binary")).alias("text"))


@query("with a as (select distinct pair_id from gen_test where round = 0), b as (select distinct pair_id from gen_test where round = 1), i as (select pair_id from a join b using (pair_id) order by md5(concat('42:', pair_id::varchar)), pair_id limit 40) select pair_id, round, min(gen_id) as gen_id from gen_test join i using (pair_id) where round in (0, 1) group by all")
def q_paired_sample(spark, d):
    """The same seeded ids of two rounds."""
    g = table(spark, d, "gen_test").where("round in (0, 1)")
    ids = S.seeded_sample(g.groupBy("pair_id").agg(F.countDistinct("round").alias("k")).where("k = 2").select("pair_id"), "pair_id", 40)
    return g.join(F.broadcast(ids), "pair_id").groupBy("pair_id", "round").agg(F.min("gen_id").alias("gen_id"))


@query(f"with s as (select doc_id, regexp_replace(text, '{BLANK}+', '', 'g') as s from documents where text is not null), g as (select doc_id, unnest([substr(s, i, 6) for i in range(1, greatest(length(s) - 4, 1))]) as g from s where length(s) >= 6), m as (select doc_id, max(n) as m from (select doc_id, g, count(*) as n from g group by all) group by doc_id) select s.doc_id, coalesce(m.m, 0)::int as most from s left join m using (doc_id)")
def q_acute_documents(spark, d):
    """F8 over the whole corpus."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", K.most_repeated_gram_udf("text").alias("most"))
