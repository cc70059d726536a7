"""Semantic retrieval: top cards per condition, best cards per company, combination, ranking, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp, cosine
from ..operators import search_session as session
from ..operators.ordered import top_per_group
from ..plans.conditions import Condition, apply_filters
from ..registry import query
from ..sources.shared import cut_lineage
from ..sources.tables import CARDS_SQL, COMPANIES_SQL, CONDITIONS_SQL, cards, companies, conditions, table

FLOOR = 0.15
#: Weight of a card's directness.
DIRECTNESS = {"core": 1.0, "direct": 0.85, "indirect": 0.55, "prospective": 0.30}


def directness_weight(c: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, weight in DIRECTNESS.items():
        out = F.when(c == name, weight).otherwise(out)
    return out


def scored_cards(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of every card to every condition; conditions are literals of the plan, a handful of rows."""
    pairs = cards(spark, d).crossJoin(F.broadcast(conditions(spark, d)))
    return pairs.withColumn("similarity", cosine(F.col("embedding"), F.col("query"))).drop("embedding", "query")


def top_cards(spark: SparkSession, d: str, k: int = 100) -> DataFrame:
    """The k nearest cards of each condition, before any grouping."""
    return top_per_group(scored_cards(spark, d), ["cond_id"], [F.desc("similarity"), F.asc("card_id")], k)


def best_cards(spark: SparkSession, d: str, n: int = 3) -> DataFrame:
    order = [F.desc("similarity"), F.asc("card_id")]
    return top_per_group(top_cards(spark, d), ["cond_id", "company_id"], order, n, "position")


def company_matches(spark: SparkSession, d: str, floor: float = FLOOR) -> DataFrame:
    """Per condition and company: the best card above the evidence floor, and its score."""
    best = best_cards(spark, d, 1).where(F.col("similarity") >= floor)
    score = 0.70 * F.col("similarity") + 0.20 * directness_weight(F.col("directness")) + 0.10 * F.col("confidence")
    return best.withColumn("score", score)


def combined(spark: SparkSession, d: str, floor: float = FLOOR) -> DataFrame:
    """Companies with a match for every required condition, by weighted mean score of the matched ones."""
    required = conditions(spark, d).where("required").agg(F.count(F.lit(1)).alias("needed"))
    w = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    groups = company_matches(spark, d, floor).groupBy("company_id").agg(
        F.count_if("required").alias("met"),
        F.count(F.lit(1)).alias("matched"),
        (F.sum(w * F.col("score")) / F.sum(w)).alias("combined_score"),
    )
    return groups.crossJoin(F.broadcast(required)).where("met = needed").drop("needed", "met")


SCORED_SQL = f"""{CARDS_SQL}, {CONDITIONS_SQL},
scored AS (SELECT card_id, company_id, directness, confidence, cond_id, required, weight,
  list_cosine_similarity(embedding::DOUBLE[], query::DOUBLE[]) AS similarity FROM cards CROSS JOIN conditions),
topk AS (SELECT *, row_number() OVER (PARTITION BY cond_id ORDER BY similarity DESC, card_id) AS rank FROM scored QUALIFY rank <= 100),
best AS (SELECT *, row_number() OVER (PARTITION BY cond_id, company_id ORDER BY similarity DESC, card_id) AS position FROM topk)"""
MATCH_SQL = f"""{SCORED_SQL},
matches AS (SELECT *, 0.70 * similarity + 0.20 * CASE directness WHEN 'core' THEN 1.0 WHEN 'direct' THEN 0.85
  WHEN 'indirect' THEN 0.55 ELSE 0.30 END + 0.10 * confidence AS score FROM best WHERE position = 1 AND similarity >= {FLOOR}),
combined AS (SELECT company_id, count(*) AS matched, sum(CASE WHEN weight > 0 THEN weight ELSE 1.0 END * score)
    / sum(CASE WHEN weight > 0 THEN weight ELSE 1.0 END) AS combined_score
  FROM matches GROUP BY company_id HAVING count(*) FILTER (required) = (SELECT count(*) FROM conditions WHERE required))"""


@query("sem_topk_cards", f"WITH {SCORED_SQL} SELECT cond_id, card_id, rank, round(similarity, 6) AS similarity FROM topk")
def sem_topk_cards(spark: SparkSession, d: str) -> DataFrame:
    return top_cards(spark, d).select("cond_id", "card_id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


@query("sem_best3_per_company", f"WITH {SCORED_SQL} SELECT cond_id, company_id, card_id, position, round(similarity, 6) AS similarity FROM best WHERE position <= 3")
def sem_best3(spark: SparkSession, d: str) -> DataFrame:
    return best_cards(spark, d).select("cond_id", "company_id", "card_id", F.col("position").cast("long").alias("position"), F.round("similarity", 6).alias("similarity"))


@query("sem_company_match", f"WITH {MATCH_SQL} SELECT cond_id, company_id, card_id, round(score, 6) AS score FROM matches")
def sem_company_match(spark: SparkSession, d: str) -> DataFrame:
    return company_matches(spark, d).select("cond_id", "company_id", "card_id", F.round("score", 6).alias("score"))


@query("sem_evidence_floor_055", f"WITH {SCORED_SQL} SELECT cond_id, company_id, card_id FROM best WHERE position = 1 AND similarity >= 0.55")
def sem_floor(spark: SparkSession, d: str) -> DataFrame:
    return company_matches(spark, d, 0.55).select("cond_id", "company_id", "card_id")


@query("sem_combined_rank", f"""WITH {MATCH_SQL} SELECT company_id, matched, round(combined_score, 6) AS combined_score,
  row_number() OVER (ORDER BY combined_score DESC, company_id) AS rank FROM combined QUALIFY rank <= 7""")
def sem_combined(spark: SparkSession, d: str) -> DataFrame:
    best = combined(spark, d).orderBy(F.desc("combined_score"), "company_id").limit(7)
    w = Window.orderBy(F.desc("combined_score"), "company_id")  # seven rows
    return best.select("company_id", "matched", F.round("combined_score", 6).alias("combined_score"), F.row_number().over(w).cast("long").alias("rank"))


@query("sem_condition_union", f"WITH {MATCH_SQL} SELECT DISTINCT company_id FROM matches")
def sem_union(spark: SparkSession, d: str) -> DataFrame:
    return company_matches(spark, d).select("company_id").distinct()


@query("sem_directness_filter", f"WITH {CARDS_SQL} SELECT directness, count(*) AS n, round(avg(confidence), 6) AS confidence FROM cards WHERE directness IN ('core', 'direct') GROUP BY 1")
def sem_directness(spark: SparkSession, d: str) -> DataFrame:
    some = cards(spark, d).where(F.col("directness").isin("core", "direct"))
    return some.groupBy("directness").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("sem_directness_badge", f"""WITH {MATCH_SQL} SELECT company_id, arg_min(CASE directness WHEN 'core' THEN 'direct' ELSE directness END,
  CASE directness WHEN 'core' THEN 0 WHEN 'direct' THEN 1 WHEN 'indirect' THEN 2 ELSE 3 END) AS badge FROM matches GROUP BY 1""")
def sem_badge(spark: SparkSession, d: str) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, DIRECTNESS)), F.col("directness"))
    badge = F.when(F.col("directness") == "core", "direct").otherwise(F.col("directness"))
    return company_matches(spark, d).groupBy("company_id").agg(F.min_by(badge, place).alias("badge"))


@query("final_rank_eligible", f"""WITH {MATCH_SQL}, {COMPANIES_SQL},
f AS (SELECT c.company_id, ticker, combined_score * (0.70 + 0.30 * greatest(0.0, least(1.0, matched / 3.0))) AS final_score,
  market_cap > 0 AS eligible FROM combined c JOIN companies USING (company_id)),
r AS (SELECT *, sum(eligible::INT) OVER (ORDER BY final_score DESC, company_id) AS k FROM f)
SELECT company_id, ticker, round(final_score, 6) AS final_score, eligible, CASE WHEN eligible AND k <= 7 THEN k::BIGINT END AS rank FROM r""")
def final_rank(spark: SparkSession, d: str) -> DataFrame:
    multiplier = 0.70 + 0.30 * clamp(F.col("matched") / 3.0)
    scored = combined(spark, d).join(companies(spark, d), "company_id").select(
        "company_id", "ticker", (F.col("combined_score") * multiplier).alias("final_score"), (F.col("market_cap") > 0).alias("eligible")
    )
    # at most 300 candidates: the top 100 cards of three conditions
    k = F.sum(F.col("eligible").cast("long")).over(Window.orderBy(F.desc("final_score"), "company_id"))
    return scored.select("company_id", "ticker", F.round("final_score", 6).alias("final_score"), "eligible", F.when(F.col("eligible") & (k <= 7), k).alias("rank"))


@query("search_funnel", f"""WITH {MATCH_SQL}, {COMPANIES_SQL}
SELECT (SELECT count(*) FROM companies) AS indexed, (SELECT count(DISTINCT company_id) FROM matches) AS semantic,
  (SELECT count(*) FROM combined) AS matched_all, (SELECT count(*) FROM combined JOIN companies USING (company_id) WHERE market_cap > 0) AS qualified""")
def search_funnel(spark: SparkSession, d: str) -> DataFrame:
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    good = combined(spark, d)
    parts = [
        one(companies(spark, d), "indexed"),
        one(company_matches(spark, d).select("company_id").distinct(), "semantic"),
        one(good, "matched_all"),
        one(good.join(companies(spark, d), "company_id").where("market_cap > 0"), "qualified"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # single rows
    return out


@query("retrieval_recall_at_k", f"""WITH {SCORED_SQL}, l AS (SELECT cond_id, label FROM conditions JOIN embeddings ON vec_id = cond_id),
rel AS (SELECT label, count(*) AS relevant FROM embeddings GROUP BY 1)
SELECT t.cond_id, count(*) FILTER (t.company_id = l.label) AS hits, round(count(*) FILTER (t.company_id = l.label) / any_value(relevant), 6) AS recall,
  round(count(*) FILTER (t.company_id = l.label) / count(*), 6) AS precision FROM topk t JOIN l USING (cond_id) JOIN rel USING (label) GROUP BY 1""")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    emb = table(spark, d, "embeddings").select("vec_id", "label")
    own = conditions(spark, d).select("cond_id").join(emb, F.col("cond_id") == F.col("vec_id")).select("cond_id", "label")
    relevant = emb.groupBy("label").agg(F.count(F.lit(1)).alias("relevant"))
    hit = F.col("company_id") == F.col("label")
    top = top_cards(spark, d).join(F.broadcast(own), "cond_id").join(relevant, "label")
    return top.groupBy("cond_id").agg(
        F.count_if(hit).alias("hits"),
        F.round(F.count_if(hit) / F.max("relevant"), 6).alias("recall"),
        F.round(F.count_if(hit) / F.count(F.lit(1)), 6).alias("precision"),
    )


@query("incremental_rerun", f"""WITH {MATCH_SQL}, old AS (SELECT DISTINCT company_id FROM matches WHERE cond_id = 0), new AS (SELECT company_id FROM combined)
SELECT coalesce(o.company_id, n.company_id) AS company_id,
  CASE WHEN o.company_id IS NULL THEN 'added' WHEN n.company_id IS NULL THEN 'filtered_out' ELSE 'researched' END AS stage
FROM old o FULL JOIN new n ON o.company_id = n.company_id""")
def incremental_rerun(spark: SparkSession, d: str) -> DataFrame:
    old = company_matches(spark, d).where("cond_id = 0").select(F.col("company_id").alias("o")).distinct()
    new = combined(spark, d).select(F.col("company_id").alias("n"))
    stage = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "filtered_out").otherwise("researched")
    return old.join(new, F.col("o") == F.col("n"), "full").select(F.coalesce("o", "n").alias("company_id"), stage.alias("stage"))


@query("peer_rank_scale", f"""WITH {MATCH_SQL}, {COMPANIES_SQL},
t AS (SELECT market_cap AS cap FROM companies WHERE company_id = 1)
SELECT company_id, round(0.78 * combined_score + 0.22 * (1 - least(abs(log10(abs(market_cap) / abs(cap))), 2) / 2), 6) AS peer_score
FROM combined JOIN companies USING (company_id) CROSS JOIN t WHERE market_cap <> 0""")
def peer_rank(spark: SparkSession, d: str) -> DataFrame:
    everyone = companies(spark, d)
    target = everyone.where("company_id = 1").select(F.col("market_cap").alias("cap"))
    size = 1 - F.least(F.abs(F.log10(F.abs("market_cap") / F.abs("cap"))), F.lit(2.0)) / 2
    rows = combined(spark, d).join(everyone, "company_id").where("market_cap <> 0").crossJoin(F.broadcast(target))
    return rows.select("company_id", F.round(0.78 * F.col("combined_score") + 0.22 * size, 6).alias("peer_score"))


@query("evidence_bundle", f"WITH {MATCH_SQL} SELECT company_id, card_id, cond_id, row_number() OVER (PARTITION BY company_id ORDER BY cond_id, card_id) AS citation FROM matches")
def evidence_bundle(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("company_id").orderBy("cond_id", "card_id")
    return company_matches(spark, d).select("company_id", "card_id", "cond_id", F.row_number().over(w).cast("long").alias("citation"))


#: Three runs of one session: the second tightens the first one's filters, the third relaxes some of them again.
PLANS = (
    [Condition("sector", "in", ("asia", "europe"), required=True), Condition("market_cap", "gte", 0.0)],
    [Condition("sector", "in", ("asia", "america"), required=True), Condition("market_cap", "between", (-500.0, 6000.0))],
    [Condition("sector", "in", ("asia", "europe", "america"), required=True), Condition("market_cap", "gte", -500.0)],
)
PLAN_SQL = (
    "(contains(lower(sector), 'asia') OR contains(lower(sector), 'europe')) AND market_cap >= 0",
    "(contains(lower(sector), 'asia') OR contains(lower(sector), 'america')) AND market_cap BETWEEN -500 AND 6000",
    "(contains(lower(sector), 'asia') OR contains(lower(sector), 'europe') OR contains(lower(sector), 'america')) AND market_cap >= -500",
)
CANDIDATES, FINAL = 15, 7


def _run_sql(k: int) -> str:
    old = f"s{k - 1}" if k > 1 else "(SELECT NULL::BIGINT AS company_id, '' AS stage, false AS completed, false AS outcome, 0.0 AS score, 0.0 AS final_score, []::VARCHAR[] AS limitations WHERE false)"
    return f"""f{k} AS (SELECT c.company_id, combined_score FROM combined c JOIN companies USING (company_id) WHERE {PLAN_SQL[k - 1]}),
c{k} AS (SELECT *, row_number() OVER (ORDER BY combined_score DESC, company_id) <= {CANDIDATES} AS candidate FROM f{k}),
m{k} AS (SELECT coalesce(o.company_id, n.company_id) AS company_id, o.company_id IS NOT NULL AS is_old, n.company_id IS NOT NULL AS passes, coalesce(candidate, false) AS candidate, stage, coalesce(completed, false) AS completed, coalesce(outcome, false) AS outcome,
 coalesce(score, combined_score) AS score, final_score, coalesce(limitations, []::VARCHAR[]) AS limitations FROM {old} o FULL JOIN c{k} n ON o.company_id = n.company_id WHERE o.company_id IS NOT NULL OR candidate),
g{k} AS (SELECT * REPLACE (CASE WHEN is_old AND NOT passes THEN 'filtered_out' WHEN NOT is_old THEN 'filtered' WHEN stage = 'filtered_out' THEN CASE WHEN completed THEN 'researched' ELSE 'filtered' END ELSE stage END AS stage,
 CASE WHEN is_old AND NOT passes AND NOT list_contains(limitations, 'Removed by updated structured filters.') THEN list_append(limitations, 'Removed by updated structured filters.') ELSE limitations END AS limitations) FROM m{k}),
r{k} AS (SELECT g.* REPLACE (CASE WHEN met THEN 'researched' ELSE g.stage END AS stage, CASE WHEN met THEN o.completed ELSE g.completed END AS completed, CASE WHEN met THEN o.eligible ELSE g.outcome END AS outcome, CASE WHEN met THEN o.final_score ELSE g.final_score END AS final_score)
 FROM (SELECT g0.*, candidate AND stage NOT IN ('researched', 'qualified') AND EXISTS (SELECT 1 FROM outcomes x WHERE x.company_id = g0.company_id) AS met FROM g{k} g0) g LEFT JOIN outcomes o USING (company_id)),
e{k} AS (SELECT *, outcome AND stage IN ('researched', 'qualified') AS eligible FROM r{k}),
s{k} AS (SELECT company_id, CASE WHEN rk IS NOT NULL THEN 'qualified' WHEN stage = 'qualified' THEN 'researched' ELSE stage END AS stage, completed, outcome, eligible, rk AS rank, score, final_score, limitations
 FROM (SELECT *, CASE WHEN eligible THEN nullif(least(row_number() OVER (PARTITION BY eligible ORDER BY final_score DESC, company_id), {FINAL + 1}), {FINAL + 1}) END AS rk FROM e{k}))"""


SESSION_SQL = f"""{MATCH_SQL}, {COMPANIES_SQL}, outcomes AS (SELECT c.company_id, company_id % 5 <> 0 AS completed, company_id % 5 <> 0 AND market_cap > 500 AS eligible,
 combined_score * (0.70 + 0.30 * greatest(0.0, least(1.0, matched / 3.0))) AS final_score FROM combined c JOIN companies USING (company_id) WHERE company_id % 11 <> 0), {_run_sql(1)}, {_run_sql(2)}, {_run_sql(3)}"""


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What research finds: some companies time out, some are not eligible, some are not reached."""
    multiplier = 0.70 + 0.30 * clamp(F.col("matched") / 3.0)
    both = combined(spark, d).join(companies(spark, d), "company_id").where("company_id % 11 <> 0")
    done = F.col("company_id") % 5 != 0
    return both.select("company_id", done.alias("completed"), (done & (F.col("market_cap") > 500)).alias("eligible"), (F.col("combined_score") * multiplier).alias("final_score"))


def session_runs(spark: SparkSession, d: str) -> list[DataFrame]:
    """The state after each of the three runs; each is written before the next one reads it."""
    results = cut_lineage(combined(spark, d).select("company_id", F.col("combined_score").alias("score")))
    found = cut_lineage(outcomes(spark, d))
    state, states = spark.createDataFrame([], session.STATE), []
    for plan in PLANS:
        passing = apply_filters(companies(spark, d), plan)
        state = cut_lineage(session.run(state, results, passing, found, limit=CANDIDATES, final=FINAL))
        states.append(state)
    return states


@query("search_session", f"""WITH {SESSION_SQL} SELECT s3.company_id, s1.stage AS stage_1, s1.rank AS rank_1, s2.stage AS stage_2, s2.rank AS rank_2, s3.stage AS stage_3, s3.rank AS rank_3, s3.completed, s3.eligible, round(s3.final_score, 6) AS final_score, len(s3.limitations) AS notes
FROM s3 LEFT JOIN s2 USING (company_id) LEFT JOIN s1 USING (company_id)""")
def search_session(spark: SparkSession, d: str) -> DataFrame:
    """A session of three runs: candidates filtered out, brought back and added as the filters change."""
    one, two, three = session_runs(spark, d)
    stage = lambda s, k: s.select("company_id", F.col("stage").alias(f"stage_{k}"), F.col("rank").alias(f"rank_{k}"))
    last = three.select("company_id", F.col("stage").alias("stage_3"), F.col("rank").alias("rank_3"), "completed", "eligible", F.round("final_score", 6).alias("final_score"), F.size("limitations").cast("long").alias("notes"))
    return last.join(stage(two, 2), "company_id", "left").join(stage(one, 1), "company_id", "left")
