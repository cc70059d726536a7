"""A search session: candidates of a plan, carried from run to run as its filters change.

A run ranks the semantic results that pass the filters and keeps the first ``limit`` as candidates.  Its state is merged with the run
before by a full outer join: kept candidates that no longer pass are marked as filtered out, with a note, and lose their rank; those that
pass again come back as they were, without new research; new candidates are added.  Only candidates without research get their outcome
joined, and the ranks of all that are eligible are given anew.

Defined results: a company is in the state once; results with a null id are left out and of several of a company the best counts; a null score ranks last;
ties go to the smaller id; candidates without an outcome stay ``filtered``; without an earlier state the run is the first one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import top_per_group

# Stages of a candidate, and the note of a removed one.
FILTERED, RESEARCHED, QUALIFIED, FILTERED_OUT = "filtered", "researched", "qualified", "filtered_out"
NOTE = "Removed by updated structured filters."
#: ``outcome`` is what research said of a candidate; ``eligible`` is that while it is not filtered out.
STATE = "company_id long, stage string, completed boolean, outcome boolean, eligible boolean, rank long, score double, final_score double, limitations array<string>"


def merged(state: DataFrame, results: DataFrame, passing: DataFrame, *, limit: int) -> DataFrame:
    """The state after the filters: old and new candidates, and whether they are to be researched."""
    c = F.col
    best = results.where("company_id IS NOT NULL").groupBy("company_id").agg(F.max("score").alias("new_score"))
    kept = best.join(passing.select("company_id").distinct(), "company_id", "left_semi")
    first = kept.orderBy(F.desc_nulls_last("new_score"), "company_id").limit(limit).select("company_id", "new_score", F.lit(True).alias("candidate"))
    new = kept.select("company_id", F.lit(True).alias("passes")).join(first, "company_id", "left")
    both = state.withColumn("old", F.lit(True)).join(new, "company_id", "full").where("old OR candidate")
    old, passes = F.coalesce("old", F.lit(False)), F.coalesce("passes", F.lit(False))
    back = F.when(c("completed"), RESEARCHED).otherwise(FILTERED)
    out = old & ~passes
    stage = F.when(out, FILTERED_OUT).when(old, F.when(c("stage") == FILTERED_OUT, back).otherwise(c("stage"))).otherwise(FILTERED)
    notes = F.coalesce("limitations", F.array().cast("array<string>"))
    both = both.select(
        "company_id",
        stage.alias("stage"),
        F.coalesce("completed", F.lit(False)).alias("completed"),
        F.coalesce("outcome", F.lit(False)).alias("outcome"),
        F.coalesce("score", "new_score").alias("score"),
        "final_score",
        F.when(out & ~F.array_contains(notes, NOTE), F.array_append(notes, NOTE)).otherwise(notes).alias("limitations"),
        F.coalesce("candidate", F.lit(False)).alias("candidate"),
    )
    return both.withColumn("to_research", c("candidate") & ~c("stage").isin(RESEARCHED, QUALIFIED)).drop("candidate")


def researched(pending: DataFrame, outcomes: DataFrame, *, final: int) -> DataFrame:
    """The state after research: outcomes (company_id, completed, eligible, final_score) of candidates that had none, and new ranks."""
    c = F.col
    found = outcomes.where("company_id IS NOT NULL").dropDuplicates(["company_id"])
    known = found.select("company_id", c("completed").alias("o_completed"), c("eligible").alias("o_eligible"), c("final_score").alias("o_score"))
    s = pending.join(known, "company_id", "left")
    met = c("to_research") & c("o_completed").isNotNull()
    s = s.select(
        "company_id",
        F.when(met, RESEARCHED).otherwise(c("stage")).alias("stage"),
        F.when(met, c("o_completed")).otherwise(c("completed")).alias("completed"),
        F.when(met, F.coalesce("o_eligible", F.lit(False))).otherwise(c("outcome")).alias("outcome"),
        "score",
        F.when(met, c("o_score")).otherwise(c("final_score")).alias("final_score"),
        "limitations",
    )
    s = s.withColumn("eligible", c("outcome") & c("stage").isin(RESEARCHED, QUALIFIED))
    ranked = top_per_group(s.where("eligible").withColumn("g", F.lit(0)), ["g"], [F.desc_nulls_last("final_score"), F.asc("company_id")], final).select("company_id", c("rank").cast("long").alias("rank"))
    s = s.join(ranked, "company_id", "left")
    stage = F.when(c("rank").isNotNull(), QUALIFIED).when(c("stage") == QUALIFIED, RESEARCHED).otherwise(c("stage"))
    return s.select("company_id", stage.alias("stage"), "completed", "outcome", "eligible", "rank", "score", "final_score", "limitations")


def run(state: DataFrame, results: DataFrame, passing: DataFrame, outcomes: DataFrame, *, limit: int = 15, final: int = 7) -> DataFrame:
    """One run after ``state``."""
    return researched(merged(state, results, passing, limit=limit), outcomes, final=final)


def funnel(results: DataFrame, passing: DataFrame, state: DataFrame) -> DataFrame:
    """(stage, n): how many companies came through each step of a run; steps without any are absent."""
    parts = [results.select(F.lit(0).alias("k")), results.join(passing.select("company_id").distinct(), "company_id", "left_semi").select(F.lit(1).alias("k"))]
    parts += [state.where(cond).select(F.lit(k).alias("k")) for k, cond in ((2, "stage <> 'filtered_out'"), (3, "completed"), (4, "rank IS NOT NULL"))]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    names = F.array(*map(F.lit, ("semantic_matches", "passed_filters", "candidates", "researched", "ranked")))
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).select(F.get(names, F.col("k")).alias("stage"), "n")
