"""Session settings, table access, lineage cuts and distributed ranks."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the session is handed in."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("loomframe")
    base = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_loomframe_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(home):  # else it was shipped itself
        sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="loomframe-"), "loomframe"), "zip", os.path.dirname(home), "loomframe"))
    sc._loomframe_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory (a file or a directory of parquet)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors reach: the session's `spark.checkpoint.dir`.

    Only a session on one machine may leave it unset and gets a temporary one. Copies in it go when
    nothing refers to them any more.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            root = tempfile.mkdtemp(prefix="loomframe-ckpt-")
        sc.setCheckpointDir(root)
    if not getattr(sc, "_loomframe_cleans", False):
        sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        sc._loomframe_cleans = True
    return sc.getCheckpointDir()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, for files that are written and read again."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and go on from there. The copy survives the loss of executors."""
    ship(df.sparkSession)
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def global_rank(df: DataFrame, order: list, out: str = "rank", by: str | None = None) -> DataFrame:
    """Position of each row in the total order `order`, from 0, without a one-task window.

    Range partitions are written once (a cut); only one count per partition (and value of `by`,
    which must come first in `order` and have few values) reaches the driver. With `by`, ranks
    start again at 0 for each of its values.
    """
    spark = df.sparkSession
    n = shuffle_width(spark)
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = cut(df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("_seq", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_pid", F.shiftright("_seq", 33))
    keys = ["_pid"] + ([by] if by else [])
    heads = ranged.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_seq").alias("_first")).collect()
    seen: dict = {}
    rows = []
    for h in sorted(heads, key=lambda r: r["_pid"]):
        g = h[by] if by else None
        start = seen.get(g, 0)
        rows.append((h["_pid"], *([g] if by else []), start - h["_first"]))
        seen[g] = start + h["_n"]
    kinds = dict(ranged.dtypes)
    schema = "_pid long" + (f", {by} {kinds[by]}" if by else "") + ", _shift long"
    shifts = spark.createDataFrame(rows, schema)
    joined = ranged.join(F.broadcast(shifts), "_pid" if not by else [*keys], "left") if not by else ranged.join(
        F.broadcast(shifts.withColumnsRenamed({by: "_by", "_pid": "_p"})), (F.col("_p") == F.col("_pid")) & F.col("_by").eqNullSafe(F.col(by)), "left"
    ).drop("_by", "_p")
    return joined.withColumn(out, F.col("_seq") + F.col("_shift")).drop("_seq", "_pid", "_shift")
