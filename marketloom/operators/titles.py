"""Titles that are near copies of each other, by an edit-distance ratio, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Two titles conflict at this ratio of one less the edit distance over the longer length.
RATIO = 0.88
#: Edits that a pair whose longer title has ``n`` characters may need, and where segment ``i`` of ``edits`` + 1 begins.
EDITS = "CAST(floor(0.12 * n + 1e-6) AS INT)"
SEGMENT = {"start": "CAST(floor(i * n / (edits + 1)) AS INT)", "size": "CAST(floor((i + 1) * n / (edits + 1)) AS INT) - start"}


def near_candidates(k: DataFrame) -> DataFrame:
    """Pairs of ids (a < b), once each, of all titles that can be within the edit bound of the longer one.

    Fewer edits than segments leave one segment of the longer title unchanged in the other, moved by no more than the edits before it
    and the edits after it allow; so pairs meet on length, segment and text.
    """
    segments = lambda df: df.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("edits")))).withColumn("start", F.expr(SEGMENT["start"])).withColumn("size", F.expr(SEGMENT["size"]))
    long = segments(k.select(F.col("page_id").alias("x"), "title", F.length("title").alias("n")).withColumn("edits", F.expr(EDITS)))
    long = long.select("x", "n", "i", F.expr("substring(title, start + 1, size)").alias("part"))
    short = k.select(F.col("page_id").alias("y"), "title", F.length("title").alias("m"))
    short = short.withColumn("n", F.explode(F.expr("sequence(m, CAST(floor(m / 0.88) AS INT) + 1)"))).withColumn("edits", F.expr(EDITS)).where("n - m <= edits")
    short = segments(short).withColumn("move", F.explode(F.expr("sequence(-edits, edits)")))
    short = short.where("abs(move) + abs(m - n - move) <= edits AND start + move >= 0 AND start + move + size <= m")
    short = short.select("y", "n", "i", F.expr("substring(title, start + move + 1, size)").alias("part"))
    return long.hint("merge").join(short, ["n", "i", "part"]).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_titles(k: DataFrame, *, octets: bool = False) -> DataFrame:
    """(a, b) with a < b: the ids of k (page_id, title), of distinct titles that are not empty, that conflict.

    With ``octets`` edits are counted in UTF-8 bytes, lengths in characters still; candidates then meet on bytes, which allow no fewer edits.
    """
    size = F.length("title")
    if octets:
        k = k.select("page_id", size.alias("size"), F.decode(F.encode("title", "UTF-8"), "ISO-8859-1").alias("title"))
        size = F.col("size")
    a, b = (k.select(F.col("page_id").alias(x), F.col("title").alias(f"t{x}"), size.alias(f"n{x}")) for x in "ab")
    ratio = 1 - F.levenshtein("ta", "tb") / F.greatest("na", "nb").cast("double")
    # titles and their segments grow with the table, so none is sent whole by way of the driver
    return near_candidates(k).hint("merge").join(a, "a").hint("merge").join(b, "b").where(ratio >= RATIO).select("a", "b")
