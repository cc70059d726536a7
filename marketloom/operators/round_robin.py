"""Round-robin selection from ranked groups under running constraints: each url once, so many of a domain, no near copies of titles.

The order is the first of each group, then the second of each, and so on; an item is taken unless one taken before it forbids it.  That
is the first maximal set of a conflict graph in that order, and it is found in rounds rather than one by one: in each round all items are
taken that no undecided or taken item before them can forbid, and all that a taken one forbids are dropped.  Only the first
``page`` items of each group take part at first; as later items never change what is decided before them, more are looked
at (twice as many each time) only if too few were taken.

Defined results: items with a null id or group are left out; of equal places in a group the smaller id is first; null urls, domains and titles, and empty
titles, conflict with nothing; of rows with one id one counts; fewer items than the limit come back if there are no more; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut_lineage
from .ordered import top_per_group
from .titles import near_titles

OPEN, TAKEN, DROPPED = 0, 1, 2


def _first(state: DataFrame, key: str) -> DataFrame:
    """The least place of each value of a key among items that are not dropped, and whether it is taken."""
    live = state.where((F.col("status") != DROPPED) & F.col(key).isNotNull())
    return live.groupBy(key).agg(F.min("ord").alias(f"{key}_first"), F.min_by("status", "ord").alias(f"{key}_status"))


def _step(state: DataFrame, edges: DataFrame, cap: int) -> DataFrame:
    """One round: state (id, ord, url, domain, title, status) with more items taken or dropped."""
    c = F.col
    s = state
    for key in ("url", "title"):
        s = s.join(_first(state, key), key, "left")
    w = Window.partitionBy("domain").orderBy("ord")
    live = state.where((c("status") != DROPPED) & c("domain").isNotNull())
    head = live.withColumn("k", F.row_number().over(w)).where(c("k") <= cap)  # limited in each task before the shuffle
    full = head.groupBy("domain").agg(F.max("ord").alias("domain_last"), F.count(F.lit(1)).alias("n"), F.min("status").alias("least"), F.max("status").alias("most"))
    closed = (c("n") == cap) & (c("least") == TAKEN) & (c("most") == TAKEN)
    s = s.join(full.select("domain", "domain_last", closed.alias("domain_closed")), "domain", "left")
    # the nearest titles before each item, among those not dropped
    places = state.where(c("status") != DROPPED).select(c("title").alias("other"), c("ord").alias("other_ord"), c("status").alias("other_status"))
    near = edges.join(places, "other").join(state.where(c("status") == OPEN).select("id", "title", "ord"), "title").where(c("other_ord") < c("ord"))
    near = near.groupBy("id").agg(F.max((c("other_status") == TAKEN).cast("int")).alias("near_taken"), F.lit(1).alias("near_any"))
    s = s.join(near, "id", "left")
    is_first = lambda key: c(f"{key}_first").isNull() | (c(f"{key}_first") == c("ord"))
    behind = lambda key: c(f"{key}_first").isNotNull() & (c(f"{key}_first") < c("ord")) & (c(f"{key}_status") == TAKEN)
    free = is_first("url") & is_first("title") & (c("domain_last").isNull() | (c("ord") <= c("domain_last"))) & c("near_any").isNull()
    forbidden = behind("url") | behind("title") | F.coalesce(c("domain_closed") & (c("ord") > c("domain_last")), F.lit(False)) | (F.coalesce("near_taken", F.lit(0)) == 1)
    status = F.when(c("status") != OPEN, c("status")).when(forbidden, DROPPED).when(free, TAKEN).otherwise(OPEN)
    return s.select("id", "ord", "url", "domain", "title", status.alias("status"))


def conflict_free(items: DataFrame, *, cap: int = 1) -> DataFrame:
    """Items (id, ord, url, domain, title) that the greedy selection in the order of ord takes; ord must tell all items apart."""
    named = items.select("id", "ord", "url", "domain", F.when(F.col("title") != "", F.col("title")).alias("title"))
    state = cut_lineage(named.withColumn("status", F.lit(OPEN)))
    titles = state.where("title IS NOT NULL").groupBy("title").agg(F.min("id").alias("page_id"))
    pairs = near_titles(titles)
    name = lambda c: titles.select(F.col("page_id").alias(c), F.col("title").alias(f"t{c}"))
    both = pairs.join(name("a"), "a").join(name("b"), "b")
    edges = cut_lineage(both.select(F.col("ta").alias("title"), F.col("tb").alias("other")).union(both.select(F.col("tb"), F.col("ta"))))
    while not state.where(F.col("status") == OPEN).isEmpty():
        state = cut_lineage(_step(state, edges, cap))
    return state.where(F.col("status") == TAKEN).drop("status")


def round_robin(items: DataFrame, rank: list[Column], *, limit: int, cap: int = 1, page: int | None = None) -> DataFrame:
    """The first ``limit`` items taken, with their position in the group: items has id, group, url, domain and title; ``rank`` orders a group."""
    whole = items.where("id IS NOT NULL AND group IS NOT NULL").dropDuplicates(["id"])
    longest = whole.groupBy("group").count().agg(F.max("count")).first()[0] or 0
    page = page or 4 * limit
    while True:
        pool = top_per_group(whole, ["group"], [*rank, F.asc("id")], page, "position")
        pool = cut_lineage(pool.withColumn("ord", F.struct(F.col("position"), F.col("group"))))
        taken = conflict_free(pool, cap=cap)
        best = taken.orderBy("ord").limit(limit)
        if page >= longest or best.count() == limit:
            return best.select("id", F.col("ord.group").alias("group"), F.col("ord.position").cast("long").alias("position"))
        page *= 2
