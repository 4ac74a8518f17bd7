"""Cutting lineage and broadcasting only what is proven small."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the one set, else the cluster's ``spark.checkpoint.dir``. Where neither is set, a temporary folder serves a local
    session, whose executors are all in one process; on a cluster that would lie on one machine only, so there it is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, estimates: bool = True) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return it read back; survives the loss of executors.

    A checkpoint keeps the planner's estimate of its size. In a loop that joins checkpoints of checkpoints these numbers get twice as many
    digits with every pass, until planning doesn't end; such loops ask for a table without ``estimates``.
    """
    checkpoint_dir(df.sparkSession)
    done = df.checkpoint(eager=True)
    if estimates:
        return done
    rows = done._jdf.queryExecution().toRdd()
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(rows, done._jdf.schema(), False), df.sparkSession)


#: Rows a side may have to be broadcast; at the widths used here (under 200 bytes) that is at most 10 MB.
BROADCAST_ROWS = 50_000


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else ``df`` itself, joined by shuffle.

    The count stops after ``max_rows + 1`` rows. Call it on tables that are cheap to read again.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
