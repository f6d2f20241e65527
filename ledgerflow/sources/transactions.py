"""Transaction files: reading, cleaning, time split, writing."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import canonical_headers
from ..operators.tables import numbered
from ..plans.contract import TRANSACTIONS

TIMESTAMP_FORMATS = ("M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "yyyy/MM/dd HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
_TEXTS = ("from_bank", "to_bank", "receiving_currency", "payment_currency", "payment_format", "from_account", "to_account")


def find_files(path: str) -> list[str]:
    """A file itself; of a folder the *_trans.csv files, then *trans.csv, then *.csv, each file once and sorted within its pattern. A path with a scheme is looked up where Spark reads it."""
    if "://" in path:
        return _find_stored(path)
    p = Path(path)
    if p.is_file():
        return [str(p)]
    found: dict[str, None] = {}
    for pattern in ("*_trans.csv", "*trans.csv", "*.csv"):
        found.update(dict.fromkeys(str(f) for f in sorted(p.glob(pattern)) if f.is_file()))
    return list(found)


def _find_stored(path: str) -> list[str]:
    spark = SparkSession.active()
    new = spark._jvm.org.apache.hadoop.fs.Path
    store = new(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(new(path)) and store.getFileStatus(new(path)).isFile():
        return [path]
    found: dict[str, None] = {}
    for pattern in ("*_trans.csv", "*trans.csv", "*.csv"):
        hits = store.globStatus(new(f"{path.rstrip('/')}/{pattern}")) or []
        found.update(dict.fromkeys(sorted(str(x.getPath().toString()) for x in hits if x.isFile())))
    return list(found)


def scan_csv(spark: SparkSession, path) -> DataFrame:
    """Every column as string under its canonical name. The header line is read by itself, as readers rename repeated headers."""
    header = spark.read.option("header", False).csv(path).limit(1).collect()
    if not header:
        raise ValueError(f"no header in {path}")
    names = canonical_headers(["" if v is None else v for v in header[0]])
    schema = ", ".join(f"`c{k}` string" for k in range(len(names)))
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path).toDF(*names)


def check_columns(df: DataFrame) -> None:
    if "timestamp" not in df.columns:
        raise ValueError("the timestamp column is missing")
    missing = [c for c in ("from_account", "to_account") if c not in df.columns]
    if missing:
        raise ValueError(f"an account column is missing: {', '.join(missing)}; two are expected")


def parse_timestamp(column):
    """The first format that fits, as a time without zone; null where none does."""
    text = F.trim(column.cast("string"))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIMESTAMP_FORMATS]).cast("timestamp_ntz")


def tidy_text(column):
    """Outer white space off; null becomes the text nan, as one account of all unknown ones."""
    return F.coalesce(F.regexp_replace(column.cast("string"), r"^\s+|\s+$", ""), F.lit("nan"))


def clean(df: DataFrame, null_accounts: str = "nan") -> DataFrame:
    """Canonical columns and types. null_accounts: "nan" keeps rows without an account under that name, "drop" drops them."""
    check_columns(df)
    if null_accounts == "drop":
        df = df.dropna(subset=["from_account", "to_account"])
    kind = dict(df.dtypes)["timestamp"]
    out = df.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz") if kind.startswith("timestamp") else parse_timestamp(F.col("timestamp"))).dropna(subset=["timestamp"])
    number = lambda c: F.expr(f"try_cast({c} as double)") if c in df.columns else F.lit(None).cast("double")
    finite = lambda x: F.when(~F.isnan(x), x)
    out = out.withColumn("amount_received", F.coalesce(finite(number("amount_received")), F.lit(0.0)))
    out = out.withColumn("amount_paid", F.coalesce(finite(number("amount_paid")), F.col("amount_received")))
    out = out.withColumns({c: tidy_text(F.col(c)) for c in _TEXTS if c in df.columns})
    label = F.expr("coalesce(try_cast(try_cast(is_laundering as double) as int), 0)") if "is_laundering" in df.columns else F.lit(None).cast("int")
    return out.withColumn("is_laundering", label)


def load_transactions(spark: SparkSession, path, null_accounts: str = "nan") -> DataFrame:
    """A cleaned CSV file, folder or glob with tx_id, the position in time order (ties by file order)."""
    raw = scan_csv(spark, path).withColumn("_at", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    out = numbered(clean(raw, null_accounts), ["timestamp", "_at"], "tx_id").drop("_at")
    for f in TRANSACTIONS:
        if f.name not in out.columns:
            out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
    return out.select([f.name for f in TRANSACTIONS] + [c for c in out.columns if c not in TRANSACTIONS.names])


def time_split(tx: DataFrame, train: float = 0.6, validation: float = 0.2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First, middle and last share of rows in (timestamp, tx_id) order, cut at truncated positions."""
    rows = numbered(tx, ["timestamp", "tx_id"], "_position")
    n = rows.count()
    a, b = int(n * train), int(n * (train + validation))
    pick = lambda w: rows.where(w).drop("_position")
    return pick(F.col("_position") < a), pick((F.col("_position") >= a) & (F.col("_position") < b)), pick(F.col("_position") >= b)


def write_csv(df: DataFrame, path: str, single_file: bool = True) -> None:
    """CSV with a header; one file as small reports want it, or one a partition."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)
