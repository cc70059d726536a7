"""Daily exchange reports: CSV files in ZIP archives, with a guard for their columns.

Each archive is read where its task runs, row by row from the compressed stream, and its rows leave the task once the member has been read
to its end and its checksum agrees: an archive that is broken anywhere, encrypted, empty or lacks a column is skipped whole, as one
day's report may be, so half a day never counts as a day.  Only the columns asked for leave the task; what is held is one report.
"""

from __future__ import annotations

import csv
import io
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import positive

# Column names and instrument codes of the reports.
FUTURES = ("FinInstrmTp", "TckrSymb", "FinInstrmNm", "XpryDt", "ClsPric", "SttlmPric", "NewBrdLotQty", "TtlTradgVol")
CASH = ("TckrSymb", "SctySrs", "OpnPric", "ClsPric")
OPTIONS = ("FinInstrmTp", "TckrSymb", "XpryDt", "StrkPric", "OptnTp", "ClsPric", "UndrlygPric", "OpnIntrst", "TtlTradgVol")
BATCH = 5000


#: What a damaged, encrypted or foreign file raises while it is read.
BROKEN = (zipfile.BadZipFile, zlib.error, csv.Error, EOFError, OSError, RuntimeError, ValueError)


def report_batches(content: bytes | None, columns: Sequence[str]) -> list[list[list[str | None]]]:
    """The columns of the first member's rows, in lists of ``BATCH`` rows, column by column; nothing of a report that can't be read whole."""
    done: list[list[list[str | None]]] = []
    held: list[list[str | None]] = []
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
            members = archive.namelist()
            if not members:
                return []
            with archive.open(members[0]) as raw:
                reader = csv.DictReader(io.TextIOWrapper(raw, "utf-8", "replace", newline=""))
                if not set(columns) <= set(reader.fieldnames or ()):
                    return []
                for row in reader:
                    held.append([row[c] for c in columns])
                    if len(held) == BATCH:
                        done.append([list(c) for c in zip(*held, strict=True)])
                        held = []
    except BROKEN:
        return []
    return [*done, [list(c) for c in zip(*held, strict=True)]] if held else done


def unzipped(files: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``report_date`` (from the name, ``_yyyymmdd_``) and the named columns, as text, of every archive in files (path, content)."""
    names = ["path", *columns]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content"), strict=True):
                for part in report_batches(content.as_py(), columns):
                    same = pa.array([file.as_py()] * len(part[0]), pa.string())
                    yield pa.RecordBatch.from_arrays([same, *(pa.array(c, pa.string()) for c in part)], names)

    rows = files.select("path", "content").mapInArrow(read, ", ".join(f"`{n}` string" for n in names))
    day = F.try_to_date(F.regexp_extract("path", r"_(\d{8})_[^/]*$", 1), "yyyyMMdd")
    return rows.select(day.alias("report_date"), *columns)


def zipped_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """``unzipped`` rows of every archive below ``path``."""
    return unzipped(spark.read.format("binaryFile").load(path), columns)


def zip_report(name: str, text: str) -> bytes:
    """An archive of one member."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr(zipfile.ZipInfo(name), text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def latest_report(rows: DataFrame, today: str, days: int = 10) -> DataFrame:
    """The rows of the last weekday with a report, at most ``days`` days back (today counts as the first)."""
    back = F.datediff(F.lit(today).cast("date"), "report_date")
    recent = rows.where((back >= 0) & (back < days) & (F.weekday("report_date") < 5))
    last = recent.agg(F.max("report_date").alias("_last"))  # one row
    return recent.join(F.broadcast(last), F.col("report_date") == F.col("_last")).drop("_last")


def _ticker() -> F.Column:
    return F.upper(F.trim("TckrSymb"))


def futures_contracts(rows: DataFrame) -> DataFrame:
    """Stock and index futures with a price (close, else settlement), a lot size and an expiry."""
    futures = rows.where(F.col("FinInstrmTp").isin("STF", "IDF"))
    out = futures.select(
        "report_date",
        _ticker().alias("ticker"),
        F.trim("FinInstrmNm").alias("contract_name"),
        F.col("XpryDt").try_cast("date").alias("expiry"),
        F.coalesce(positive(F.col("ClsPric")), positive(F.col("SttlmPric"))).alias("price"),
        positive(F.col("NewBrdLotQty")).cast("long").alias("lot_size"),
        F.coalesce(positive(F.col("TtlTradgVol")), F.lit(0.0)).cast("long").alias("traded_volume"),
    )
    return out.where("expiry IS NOT NULL AND price IS NOT NULL AND lot_size IS NOT NULL")


def session_prices(rows: DataFrame) -> DataFrame:
    """Open and close of the cash series EQ, both positive."""
    equity = rows.where(F.upper("SctySrs") == "EQ")
    out = equity.select("report_date", _ticker().alias("ticker"), positive(F.col("OpnPric")).alias("open"), positive(F.col("ClsPric")).alias("close"))
    return out.where("open IS NOT NULL AND close IS NOT NULL")


def option_quotes(rows: DataFrame) -> DataFrame:
    """Complete option rows, with the median of the positive underlying prices of their report and ticker as ``spot``."""
    number = lambda c: F.col(c).try_cast("double")
    out = rows.select(
        "report_date",
        _ticker().alias("ticker"),
        F.col("XpryDt").try_cast("date").alias("expiry"),
        number("StrkPric").alias("strike"),
        F.col("OptnTp").alias("side"),
        number("ClsPric").alias("close"),
        number("UndrlygPric").alias("underlying"),
        F.coalesce(number("OpnIntrst"), F.lit(0.0)).alias("open_interest"),
        F.coalesce(number("TtlTradgVol"), F.lit(0.0)).alias("volume"),
    ).dropna(subset=["expiry", "strike", "side", "close", "underlying"])
    whole = Window.partitionBy("report_date", "ticker")
    spot = F.percentile(F.when(F.col("underlying") > 0, F.col("underlying")), F.lit(0.5)).over(whole)
    return out.withColumn("spot", spot).where("spot IS NOT NULL")
