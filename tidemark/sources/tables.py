"""Readers and writers: pruned scans, partitioned and signed Parquet, archives, JSON, CSV and staging text."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of an archive row, as text.
ARCHIVE_FIELDS = ["open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trade_count", "taker_buy_base", "taker_buy_quote", "ignored"]


def scan(spark: SparkSession, path: str, columns: list[str], where: Column | None = None) -> DataFrame:
    """A Parquet scan that reads only the named columns and rows; filter and columns reach the scan."""
    df = spark.read.parquet(path)
    return (df if where is None else df.where(where)).select(*columns)


def write_partitioned(df: DataFrame, path: str, by: list[str], signature: str) -> bool:
    """Write zstd Parquet in folders by ``by`` unless the manifest there has the same signature; whether it wrote.

    Rows are brought together by their partition first, so a partition isn't split into a file for each task; adaptive execution splits large ones.
    The manifest is written last: a write that broke off is done again.
    """
    spark = df.sparkSession
    manifest = f"{path}/_manifest"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(manifest)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(hadoop) and spark.read.json(manifest).where(F.col("signature") == signature).limit(1).count():
        return False
    df.hint("rebalance", *by).write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)
    spark.createDataFrame([(signature,)], "signature string").coalesce(1).write.mode("overwrite").json(manifest)
    return True


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_no, fields, error): rows of zipped CSV files of one member each; one task takes whole files.

    A broken archive or one with several members gives one row with the error; a first row that doesn't begin with a number is a header; rows
    with fewer than 12 columns carry an error. Files are read as they come, none is dropped.
    """

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["path"], b["content"], strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names = [n for n in z.namelist() if not n.endswith("/")]
                        if len(names) != 1:
                            rows.append((file, 0, None, f"expected one member, got {len(names)}"))
                        else:
                            with z.open(names[0]) as f:
                                for no, r in enumerate(csv.reader(io.TextIOWrapper(f, encoding="utf-8", newline="")), 1):
                                    if no == 1 and r and not r[0].strip().lstrip("-").isdigit():
                                        continue
                                    rows.append((file, no, r, None if len(r) >= 12 else f"expected 12 columns, got {len(r)}"))
                except zipfile.BadZipFile:
                    rows.append((file, 0, None, "corrupted archive"))
                yield pd.DataFrame(rows, columns=["file", "row_no", "fields", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unzip, "file string, row_no bigint, fields array<string>, error string")


def archive_candles(rows: DataFrame, symbol: Column) -> DataFrame:
    """Archive rows without error as typed candle columns; a field that can't be read is NULL."""
    kinds = {"open_time": "bigint", "close_time": "bigint", "trade_count": "bigint"}
    ok = rows.where("error IS NULL")
    return ok.select("file", "row_no", symbol.alias("symbol"), *[F.col("fields")[k].try_cast(kinds.get(n, "double")).alias(n) for k, n in enumerate(ARCHIVE_FIELDS[:-1])])


def requested_only(candles: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candles whose (symbol, minute) is wanted and occurs once, the keys that occur more than once)."""
    hit = candles.join(wanted.select("symbol", "minute").distinct(), ["symbol", "minute"], "left_semi")
    often = hit.groupBy("symbol", "minute").agg(F.count("*").alias("n")).where("n > 1")
    return hit.join(often, ["symbol", "minute"], "left_anti"), often


def read_rules(text: str) -> list[dict]:
    """Rules from JSON, either a list or an object with a list under 'rules'; anything else raises ValueError."""
    data = json.loads(text)
    rules = data.get("rules") if isinstance(data, dict) else data
    if not isinstance(rules, list) or not all(isinstance(r, dict) for r in rules):
        raise ValueError("no list of rules")
    return rules


def read_manifest(spark: SparkSession, path: str, accepted: list[str]) -> DataFrame:
    """Files of a CSV manifest with an accepted status whose checksum matches what was expected; empty cells stay empty strings."""
    m = spark.read.csv(path, header=True, nullValue=None, emptyValue="", schema="file string, status string, expected_sha256 string, sha256 string")
    return m.where(F.col("status").isin(*accepted) & (F.lower("expected_sha256") == F.lower("sha256")))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"))


def export(df: DataFrame, path: str) -> None:
    """Write as CSV or Parquet by the ending of the path; another ending raises ValueError."""
    ending = PurePosixPath(path).suffix.lower()
    if ending == ".csv":
        df.write.mode("overwrite").option("header", "true").csv(path)
    elif ending in (".parquet", ".pq"):
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown ending {ending!r}")


def staging_text(df: DataFrame) -> DataFrame:
    """One column ``line`` of tab-separated staging text: NULL and NaN as \\N, lists in braces, tabs, line ends and backslashes escaped."""
    cells = []
    for name, kind in df.dtypes:
        c = F.col(name)
        text = F.concat(F.lit("{"), F.array_join(c.cast("array<string>"), ","), F.lit("}")) if kind.startswith("array") else c.cast("string")
        for raw, out in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            text = F.replace(text, F.lit(raw), F.lit(out))
        missing = c.isNull() | F.isnan(c) if kind in ("double", "float") else c.isNull()
        cells.append(F.when(missing, "\\N").otherwise(text))
    return df.select(F.concat_ws("\t", *cells).alias("line"))
