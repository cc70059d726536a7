"""Filter interaction audit by a subset-zeta transform (operator 12).

Every document gets a mask with a bit for each filter that it fails.  Documents are counted by part and mask; a zeta
transform over subsets turns a part's counts into c[T], the documents that fail nothing outside of T.  With a set S
of filters applied c[~S] documents survive, so every step of every order is a difference of two neighbouring
entries, and so are the label counts.  Documents are counted once; orders cost nothing but rows of the report.

A document is a duplicate if a smaller id has the identical text anywhere in the table.  Texts meet as sha256 digests, and only
after equal ones have been counted together map-side by part, labels and least id: a third of all rows with one text is
a few rows in the shuffle.

Defined results: a null text is the empty text and a null part the empty string; null ids neither make nor are
duplicates and have no labels; rows of one id and one text are counted each, and none is a duplicate of
the other; of several labels of an id the largest holds, null labels count as 0; an empty table gives no rows; parts without a failure report
zeros; columns beyond those named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"([^\x20\x09-\x0D]+)"
#: Failure conditions over the columns text (never null) and words (its words).
RULES: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < 200,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
    "C": lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.length(text).cast("long"),
    "D": lambda text, words: text.rlike(r"[#$%&*|]"),
}
DUPLICATE = "E"
COUNTS = ("n", "good", "toxic")


def masks(docs: DataFrame, rules: Mapping[str, Callable[[Column, Column], Column]] = RULES, *, part: str = "lang") -> DataFrame:
    """(doc_id, part, digest, mask) of each document, without the bit for duplicates, which comes after the others."""
    texts = docs.select("doc_id", F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    split = texts.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), 0))
    bits = [F.when(rule(F.col("text"), F.col("words")), 1 << k).otherwise(0) for k, rule in enumerate(rules.values())]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask + bit
    return split.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), mask.alias("mask"))


def mask_counts(masked: DataFrame, labels: DataFrame, duplicate_bit: int) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask, duplicates with their bit, and those of them with each label."""
    each = masked.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("c"))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("at")).agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    # null ids have no labels; their keys are spread by what tells the rows apart
    left = each.withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("digest", "part")).otherwise(0))
    both = left.join(known, (F.col("doc_id") == F.col("id")) & (F.col("spread") == F.col("at")), "left")
    told = both.select("doc_id", "part", "digest", "mask", "c", F.coalesce(F.col("q") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("t") == 1, F.lit(False)).alias("toxic"))
    # a row for each text, part and labels; ids are distinct in it, so min_by gives the rows of the least
    texts = told.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("c").alias("all"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("c")).otherwise(0)).alias("unnamed"),
        F.min("doc_id").alias("least"),
        F.coalesce(F.min_by("c", "doc_id"), F.lit(0)).alias("at_least"),
    )
    first = F.min("least").over(Window.partitionBy("digest"))  # a few rows: one for each part and labels
    kept = F.col("unnamed") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    texts = texts.withColumn("first", first).withColumn("kept", kept)
    sides = F.array(
        F.struct(F.col("mask"), F.col("kept").alias("n")),
        F.struct((F.col("mask") + duplicate_bit).alias("mask"), (F.col("all") - F.col("kept")).alias("n")),
    )
    rows = texts.select("part", "good", "toxic", F.explode(sides).alias("side")).select("part", "good", "toxic", "side.mask", "side.n")
    only = lambda label: F.sum(F.when(F.col(label), F.col("n")).otherwise(0)).alias(label)
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), only("good"), only("toxic"))


def subset_zeta(counts: Column, bit: int) -> Column:
    """One step of the transform: to each entry whose index has the bit, the one without it is added."""
    return F.transform(counts, lambda x, i: x + F.when(i.bitwiseAND(bit) != 0, F.get(counts, i.bitwiseXOR(bit))).otherwise(0))


def report(counts: DataFrame, letters: str) -> DataFrame:
    """The rows of all orders of the filters, from (part, mask, n, good, toxic)."""
    size, full = 1 << len(letters), (1 << len(letters)) - 1
    entries = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*COUNTS))))  # 2 ** filters of a part at most
    parts = counts.groupBy("part").agg(entries.alias("at"))
    dense = lambda c: F.transform(F.sequence(F.lit(0), F.lit(full)), lambda i: F.coalesce(F.col("at")[i][c], F.lit(0).cast("long")))
    parts = parts.select("part", *[dense(c).alias(c) for c in COUNTS])
    parts = parts.withColumn("masks", F.col("n"))
    for k in range(len(letters)):  # n, good and toxic become c[T]: the documents that fail nothing outside of T
        parts = parts.withColumns({c: subset_zeta(F.col(c), 1 << k) for c in COUNTS})

    def lost(c: str, before: Column, bit: Column) -> Column:
        """Survivors of the filters ``before`` that the filter ``bit`` takes."""
        return F.get(c, F.lit(full) - before) - F.get(c, F.lit(full) - before - bit)

    # a subset S comes before a filter in |S|! (k - 1 - |S|)! orders
    times = F.array(*[F.lit(math.factorial(k) * math.factorial(len(letters) - 1 - k)).cast("long") for k in range(len(letters))])

    def over_orders(bit: int) -> Column:
        without = F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda s: s.bitwiseAND(bit) == 0)
        terms = F.transform(without, lambda s: F.get(times, F.bit_count(s)) * lost("n", s, F.lit(bit)))
        return F.aggregate(terms, F.lit(0).cast("long"), lambda a, b: a + b)

    parts = parts.withColumn("shapley", F.array(*[over_orders(1 << k) for k in range(len(letters))]))
    orders = F.explode(F.array(*[F.lit("".join(o)) for o in permutations(letters)]))
    steps = parts.withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    place = lambda letter: F.instr(F.lit(letters), letter) - 1
    bits = F.array(*[F.lit(1 << k) for k in range(len(letters))])
    applied = F.slice(F.split("filter_order", ""), 1, F.col("step") - 1)
    steps = steps.withColumns(
        {
            "k": place(F.substr("filter_order", F.col("step"), F.lit(1))),
            "before": F.aggregate(applied, F.lit(0), lambda a, letter: a + F.get(bits, place(letter))),
        }
    ).withColumn("bit", F.get(bits, F.col("k")))
    failing = F.get("n", F.lit(full)) - F.get("n", F.lit(full) - F.col("bit"))
    removed = lost("n", F.col("before"), F.col("bit"))
    return steps.select(
        "part",
        "filter_order",
        "step",
        F.get("n", F.lit(full) - F.col("before") - F.col("bit")).alias("kept"),
        removed.alias("removed"),
        (failing - removed).alias("redundant"),
        F.get("masks", F.col("bit")).alias("unique_fails"),
        lost("good", F.col("before"), F.col("bit")).alias("good_lost"),
        lost("toxic", F.col("before"), F.col("bit")).alias("toxic_lost"),
        F.get("shapley", F.col("k")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, rules: Mapping[str, Callable[[Column, Column], Column]] = RULES, *, part: str = "lang") -> DataFrame:
    """What each filter removes at each step of every order, by part, for docs (doc_id, text, ``part``) and labels (doc_id, quality, toxic).

    Filters are ``rules``, by letters, and ``DUPLICATE`` after them; k filters have k! orders and 2 ** k masks.
    """
    counts = mask_counts(masks(docs, rules, part=part), labels, 1 << len(rules))
    return report(counts, "".join(rules) + DUPLICATE)
