"""Daily reports in ZIP archives: made here, read whole, guarded and reduced to the last good day."""

from __future__ import annotations

import datetime as dt
import io
import zipfile

import pytest

from marketloom.sources import bhavcopy

HEAD = "FinInstrmTp,TckrSymb,FinInstrmNm,XpryDt,ClsPric,SttlmPric,NewBrdLotQty,TtlTradgVol,SctySrs,OpnPric,StrkPric,OptnTp,UndrlygPric,OpnIntrst"


def archive(folder, day, lines, head=HEAD):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("report.csv", "\n".join([head, *lines]) + "\n")
    (folder / f"BhavCopy_{day}_F_0000.csv.zip").write_bytes(data.getvalue())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("reports")
    futures = [
        'STF, abc ,"ABC, June",2024-06-27,100.5,101,50,7,,,,,,',
        "IDF,NIFTY,N JUN,2024-06-27,0,22000,25,,,,,,,",
        "STF,NOPRICE,X,2024-06-27,,-1,25,1,,,,,,",
        "STF,NODATE,X,soon,5,5,25,1,,,,,,",
        "STO,ABC,OPT,2024-06-27,3,3,50,1,,,100,CE,101,9",
        "STO,ABC,OPT,2024-06-27,4,4,50,1,,,110,PE,103,x",
        "STO,ABC,OPT,2024-06-27,4,4,50,1,,,120,PE,-1,",
        "STO,ABC,OPT,2024-06-27,,4,50,1,,,130,PE,105,",
    ]
    archive(d, "20240607", futures)  # a Friday
    archive(d, "20240608", ["STF,ABC,Saturday,2024-06-27,1,1,1,1,,,,,,"])
    archive(d, "20240610", ["STF,ABC,no columns"], head="FinInstrmTp,TckrSymb,Other")
    (d / "BhavCopy_20240611_F_0000.csv.zip").write_bytes(b"not an archive")
    with zipfile.ZipFile(d / "BhavCopy_20240612_F_0000.csv.zip", "w"):
        pass
    archive(d, "20240503", ["STF,OLD,X,2024-06-27,1,1,1,1,,,,,,"])
    return str(d)


def test_futures_of_the_last_good_weekday(spark, folder):
    rows = bhavcopy.latest_report(bhavcopy.zipped_csv(spark, folder, bhavcopy.FUTURES), "2024-06-13")
    got = {r.ticker: r for r in bhavcopy.futures_contracts(rows).collect()}
    assert sorted(got) == ["ABC", "NIFTY"]
    assert got["ABC"].contract_name == "ABC, June" and got["ABC"].expiry == dt.date(2024, 6, 27) and got["ABC"].report_date == dt.date(2024, 6, 7)
    assert (got["NIFTY"].price, got["NIFTY"].lot_size, got["NIFTY"].traded_volume) == (22000.0, 25, 0)
    assert bhavcopy.latest_report(bhavcopy.zipped_csv(spark, folder, bhavcopy.FUTURES), "2024-09-01").collect() == []


def test_session_prices_need_both_sides(spark, tmp_path):
    archive(tmp_path, "20240607", [",abc,,,10,,,,EQ,9,,,,", ",def,,,10,,,,BE,9,,,,", ",ghi,,,10,,,,eq,0,,,,", ",jkl,,,nan,,,,EQ,3,,,,"])
    got = bhavcopy.session_prices(bhavcopy.zipped_csv(spark, str(tmp_path), bhavcopy.CASH)).collect()
    assert [(r.ticker, r.open, r.close) for r in got] == [("ABC", 9.0, 10.0)]


def test_option_quotes_have_the_median_of_positive_spots(spark, folder):
    rows = bhavcopy.latest_report(bhavcopy.zipped_csv(spark, folder, bhavcopy.OPTIONS), "2024-06-13").where("FinInstrmTp = 'STO'")
    got = sorted(bhavcopy.option_quotes(rows).collect(), key=lambda r: r.strike)
    assert [(r.strike, r.side, r.spot, r.open_interest) for r in got] == [(100.0, "CE", 102.0, 9.0), (110.0, "PE", 102.0, 0.0), (120.0, "PE", 102.0, 0.0)]


def damaged(tmp_path):
    """Good, wrong checksum, damaged bytes, cut off, encrypted flag, deflated garbage and an overlong field, a day each."""
    lines = [f"STF,T{k},N,2024-06-27,{k + 1},1,1,1,,,,,," for k in range(20_000)]
    good = bhavcopy.zip_report("report.csv", "\n".join([HEAD, *lines]) + "\n")
    at = good.index(b"PK\x01\x02")
    crc = bytearray(good)
    crc[at + 16] ^= 0xFF
    crc[14] ^= 0xFF
    bytes_ = bytearray(good)
    bytes_[len(good) // 2 : len(good) // 2 + 40] = bytes(40)
    locked = bytearray(good)
    locked[6] |= 1
    locked[at + 8] |= 1
    method = bytearray(good)
    method[8:10] = method[at + 10 : at + 12] = (99).to_bytes(2, "little")
    field = bhavcopy.zip_report("report.csv", HEAD + "\n" + "STF," + "x" * 200_000 + ",N\n")
    made = {"20240603": good, "20240604": bytes(crc), "20240605": bytes(bytes_), "20240606": good[: len(good) // 2], "20240607": bytes(locked), "20240610": bytes(method), "20240611": field, "20249999": good}
    for day, data in made.items():
        (tmp_path / f"BhavCopy_{day}_F_0000.csv.zip").write_bytes(data)
    (tmp_path / "BhavCopy_20240612_F_0000.csv.zip").write_bytes(b"")
    return str(tmp_path)


def test_half_a_report_never_counts(spark, tmp_path):
    rows = bhavcopy.zipped_csv(spark, damaged(tmp_path), bhavcopy.FUTURES)
    assert {(r.report_date, r["count"]) for r in rows.groupBy("report_date").count().collect()} == {(dt.date(2024, 6, 3), 20_000), (None, 20_000)}
    last = bhavcopy.latest_report(rows, "2024-06-12")
    assert last.count() == 20_000 and last.first().report_date == dt.date(2024, 6, 3)


def test_null_and_foreign_content(spark):
    files = spark.createDataFrame([("a_20240607_.zip", None), ("b_20240607_.zip", bytearray(b"PK")), ("c", bytearray(bhavcopy.zip_report("r", "TckrSymb,SctySrs,OpnPric,ClsPric\nx,EQ\n")))], "path string, content binary")
    got = bhavcopy.unzipped(files, bhavcopy.CASH).collect()
    assert [tuple(r) for r in got] == [(None, "x", "EQ", None, None)]
    assert bhavcopy.unzipped(files.limit(0), bhavcopy.CASH).collect() == []
