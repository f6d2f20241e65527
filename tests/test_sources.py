import pytest
from pyspark.sql import functions as F

from ledgerflow.functions.names import canonical_headers, tidy_header
from ledgerflow.operators.learning import downsample
from ledgerflow.sources import transactions as source
from ledgerflow.streaming.ingest import stream_transactions

HEADER = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering"


def write(tmp_path, text, name="x_trans.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_header_names():
    assert tidy_header("  From \t Bank ") == "From Bank"
    assert tidy_header("﻿Timestamp") == "Timestamp"
    assert canonical_headers(["﻿Timestamp", "From  Bank", "Account", "To Bank", "Account", "Odd Name"]) == ["timestamp", "from_bank", "from_account", "to_bank", "to_account", "odd_name"]
    assert canonical_headers(["ACCOUNT", "account.1"]) == ["from_account", "to_account"]
    assert canonical_headers(["Account", "Account_1"]) == ["from_account", "to_account"]
    with pytest.raises(ValueError):
        canonical_headers(["Account", "Account", "Account"])


def test_find_files(tmp_path):
    for name in ("b_trans.csv", "a_trans.csv", "ztrans.csv", "other.csv", "no.txt"):
        (tmp_path / name).write_text("x")
    assert [p.rsplit("/", 1)[1] for p in source.find_files(str(tmp_path))] == ["a_trans.csv", "b_trans.csv", "ztrans.csv", "other.csv"]
    assert source.find_files(str(tmp_path / "no.txt")) == [str(tmp_path / "no.txt")]


def test_dirty_rows(spark, tmp_path):
    rows = [
        "9/3/2022 12:18,1, 007 ,2,B,x,NPR,,NPR,card,0.7",
        "2022/09/03 12:17,1,A,2,B,5,NPR,7,NPR,card,1",
        "soon,1,A,2,B,5,NPR,7,NPR,card,1",
        "9/4/2022 1:00,1,,2,\tB ,,NPR,3,NPR,,bad",
    ]
    tx = source.load_transactions(spark, write(tmp_path, "\n".join([HEADER, *rows]) + "\n")).orderBy("tx_id").collect()
    assert [r["tx_id"] for r in tx] == [0, 1, 2]
    assert [r["from_account"] for r in tx] == ["A", "007", "nan"]
    assert [r["to_account"] for r in tx] == ["B", "B", "B"]
    assert [(r["amount_received"], r["amount_paid"]) for r in tx] == [(5.0, 7.0), (0.0, 0.0), (0.0, 3.0)]
    assert [r["is_laundering"] for r in tx] == [1, 0, 0]
    dropped = source.load_transactions(spark, write(tmp_path, "\n".join([HEADER, *rows]) + "\n"), null_accounts="drop")
    assert dropped.count() == 2


def test_missing_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="timestamp"):
        source.load_transactions(spark, write(tmp_path, "Account,Account\nA,B\n"))
    with pytest.raises(ValueError, match="account"):
        source.load_transactions(spark, write(tmp_path, "Timestamp,Account\n9/3/2022 12:18,B\n"))
    tx = source.load_transactions(spark, write(tmp_path, "Timestamp,Account,Account\n9/3/2022 12:18,A,B\n")).first()
    assert (tx["amount_received"], tx["amount_paid"], tx["is_laundering"]) == (0.0, 0.0, None)


def test_header_only(spark, tmp_path):
    assert source.load_transactions(spark, write(tmp_path, HEADER + "\n")).count() == 0


@pytest.mark.parametrize("n, cuts", [(0, (0, 0)), (1, (0, 0)), (2, (1, 1)), (5, (3, 4)), (10, (6, 8))])
def test_time_split(spark, n, cuts):
    tx = spark.range(n).select(F.col("id").alias("tx_id"), F.expr("timestamp_ntz'2022-01-01 00:00:00'").alias("timestamp"))
    parts = [sorted(r[0] for r in p.select("tx_id").collect()) for p in source.time_split(tx)]
    assert parts == [list(range(cuts[0])), list(range(cuts[0], cuts[1])), list(range(cuts[1], n))]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string")
    source.write_csv(df, str(tmp_path / "out"))
    assert sorted(spark.read.option("header", True).schema("k int, s string").csv(str(tmp_path / "out")).collect()) == sorted(df.collect())
    assert len(list((tmp_path / "out").glob("part-*.csv"))) == 1


def test_stream(spark, tmp_path):
    write(tmp_path, "\n".join([HEADER, "9/3/2022 12:18,1,A,2,B,5,NPR,,NPR,card,1"]) + "\n")
    query = stream_transactions(spark, str(tmp_path), HEADER.split(",")).writeStream.format("memory").queryName("arrived").start()
    query.processAllAvailable()
    query.stop()
    row = spark.table("arrived").first()
    assert (row["from_account"], row["to_account"], row["amount_paid"], row["is_laundering"]) == ("A", "B", 5.0, 1)


def test_downsample(spark):
    tx = spark.range(300).select(F.col("id").alias("tx_id"), (F.col("id") < 10).cast("int").alias("is_laundering"))
    out = [r["is_laundering"] for r in downsample(tx, 5).collect()]
    assert (out.count(1), out.count(0)) == (10, 50)
    same = downsample(tx.repartition(7), 5)
    assert [r[0] for r in same.collect()] == [r[0] for r in downsample(tx, 5).collect()]
    assert downsample(tx, 1000).count() == 300
