"""Daily reports: the tables as zipped CSV archives, a day each, read back by the report reader."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources import bhavcopy
from ..sources.tables import table

COLUMNS = ("FinInstrmTp", "TckrSymb", "FinInstrmNm", "XpryDt", "StrkPric", "OptnTp", "ClsPric", "OpnPric", "SttlmPric", "NewBrdLotQty", "TtlTradgVol", "SctySrs", "UndrlygPric", "OpnIntrst")
#: Every tenth day's archive loses its end.
CUT = 10
#: Shares that the days are dealt to: what a worker is sent at once is the days of one.
SHARES = 192


def archives(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): an archive for each ship date, whose lines are futures, options and cash rows by line number; some are cut off."""
    k, line = F.col("l_orderkey"), F.col("l_linenumber")
    kind = F.when(line <= 2, "STF").when(line <= 5, "STO").otherwise("STK")
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100
    fields = {
        "FinInstrmTp": kind,
        "TckrSymb": F.concat(F.lit(" t"), F.col("l_suppkey").cast("string")),
        "FinInstrmNm": F.concat(F.lit('"'), k.cast("string"), F.lit(", "), line.cast("string"), F.lit('"')),
        "XpryDt": F.when(k % 13 > 0, F.date_add("l_shipdate", 30).cast("string")),
        "StrkPric": F.when(line.between(3, 5), (F.col("l_partkey") % 50 * 10).cast("string")),
        "OptnTp": F.when(line.between(3, 5), F.when(k % 2 == 0, "CE").otherwise("PE")),
        "ClsPric": F.when(k % 7 > 0, price.cast("string")),
        "OpnPric": F.when(k % 5 > 0, price.cast("string")).otherwise("-"),
        "SttlmPric": F.when(k % 3 > 0, price.cast("string")),
        "NewBrdLotQty": F.when(k % 11 > 0, F.col("l_quantity").cast("long").cast("string")).otherwise("0"),
        "TtlTradgVol": (k % 9).cast("string"),
        "SctySrs": F.when(line > 5, F.when(k % 4 > 0, "eq").otherwise("BE")),
        "UndrlygPric": F.when(k % 6 > 0, price.cast("string")).otherwise("0"),
        "OpnIntrst": F.when(k % 8 > 0, (k % 17).cast("string")),
    }
    text = F.concat_ws(",", *[F.coalesce(fields[c], F.lit("")) for c in COLUMNS])
    lines = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day"), text.alias("line")).repartition(SHARES, "day")
    days = lines.groupBy("day").agg(F.concat_ws("\n", F.sort_array(F.collect_list("line"))).alias("text"))  # a day's report is one file

    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = ",".join(COLUMNS) + "\n"
        for rb in batches:
            for day, body in zip(rb.column("day").to_pylist(), (x.as_py() for x in rb.column("text")), strict=True):  # one text at a time
                data = bhavcopy.zip_report("report.csv", head + body + "\n")
                data = data[: len(data) * 2 // 3] if day.toordinal() % CUT == 0 else data
                yield pa.RecordBatch.from_arrays([pa.array([f"BhavCopy_{day:%Y%m%d}_F_0000.csv.zip"]), pa.array([data], pa.binary())], ["path", "content"])

    return days.where("day IS NOT NULL").mapInArrow(zipped, "path string, content binary")


REPORT_SQL = f"""rep AS (SELECT l_shipdate::DATE AS report_date, l_orderkey AS k, l_linenumber AS line, upper('t' || l_suppkey) AS ticker, l_suppkey, l_partkey, l_quantity, floor(l_extendedprice / l_quantity * 100) / 100 AS price
 FROM lineitem WHERE (l_shipdate::DATE - DATE '0001-01-01' + 1) % {CUT} <> 0)"""


@query("report_futures", f"""WITH {REPORT_SQL}, f AS (SELECT *, CASE WHEN k % 7 > 0 AND price > 0 THEN price WHEN k % 3 > 0 AND price > 0 THEN price END AS p FROM rep WHERE line <= 2 AND k % 13 > 0 AND k % 11 > 0 AND floor(l_quantity) > 0)
SELECT report_date, ticker, k || ', ' || line AS contract_name, report_date + 30 AS expiry, p AS price, floor(l_quantity)::BIGINT AS lot_size, k % 9 AS traded_volume FROM f WHERE p IS NOT NULL""")
def report_futures(spark: SparkSession, d: str) -> DataFrame:
    """Futures of all whole reports."""
    return bhavcopy.futures_contracts(bhavcopy.unzipped(archives(spark, d), bhavcopy.FUTURES))


@query("report_cash", f"WITH {REPORT_SQL} SELECT report_date, ticker, price AS open, price AS close FROM rep WHERE line > 5 AND k % 4 > 0 AND k % 5 > 0 AND k % 7 > 0 AND price > 0")
def report_cash(spark: SparkSession, d: str) -> DataFrame:
    """Cash session prices of the series EQ."""
    return bhavcopy.session_prices(bhavcopy.unzipped(archives(spark, d), bhavcopy.CASH))


@query("report_options", f"""WITH {REPORT_SQL}, o AS (SELECT report_date, ticker, report_date + 30 AS expiry, l_partkey % 50 * 10.0::DOUBLE AS strike, CASE WHEN k % 2 = 0 THEN 'CE' ELSE 'PE' END AS side, price AS close,
 CASE WHEN k % 6 > 0 THEN price ELSE 0.0 END AS underlying, CASE WHEN k % 8 > 0 THEN k % 17 ELSE 0 END::DOUBLE AS open_interest, (k % 9)::DOUBLE AS volume FROM rep WHERE line BETWEEN 3 AND 5 AND k % 13 > 0 AND k % 7 > 0),
s AS (SELECT report_date, ticker, quantile_cont(underlying, 0.5) AS spot FROM o WHERE underlying > 0 GROUP BY 1, 2)
SELECT o.*, round(spot, 6) AS spot FROM o JOIN s USING (report_date, ticker)""")
def report_options(spark: SparkSession, d: str) -> DataFrame:
    """Complete option rows with the spot of their report and ticker."""
    rows = bhavcopy.unzipped(archives(spark, d), bhavcopy.OPTIONS).where("FinInstrmTp = 'STO'")
    return bhavcopy.option_quotes(rows).withColumn("spot", F.round("spot", 6))


@query("report_latest", f"""WITH {REPORT_SQL}, r AS (SELECT max(report_date) AS m FROM rep WHERE report_date <= DATE '1998-08-31' AND report_date > DATE '1998-08-21' AND isodow(report_date) < 6)
SELECT report_date, count(*) AS lines FROM rep, r WHERE report_date = m GROUP BY 1""")
def report_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last whole weekday's report within ten days, and how many lines it has."""
    rows = bhavcopy.unzipped(archives(spark, d), ("TckrSymb",))
    return bhavcopy.latest_report(rows, "1998-08-31").groupBy("report_date").agg(F.count(F.lit(1)).alias("lines"))
