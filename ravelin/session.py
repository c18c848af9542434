"""Session helpers: sessions for tests, lineage cuts, size-checked broadcast, salted joins."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted (or is limited by construction) to at most this many rows.
BROADCAST_ROWS = 200_000
#: A key is hot if it holds at least 1/HOT_SHARE of the rows, so there are at most HOT_SHARE hot keys; this holds at every size.
HOT_SHARE = 64
#: Items that the sketch of frequent keys tracks; its error is well below 1/HOT_SHARE.
TRACKED = 4096
#: Pieces that a hot key is split into.
SALTS = 32


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", shared: str | None = None) -> SparkSession:
    """A session on one machine, for tests and benchmarks; only there a temporary folder can be the shared one."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ravelin")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", shared or tempfile.mkdtemp(prefix="ravelin-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: that of ``spark.checkpoint.dir``.

    Without one, a session whose master is this machine gets a temporary
    folder; on a cluster that would be a disk of the driver's own, so it is an
    error there.
    """
    named, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if named:
        return named
    if context.getCheckpointDir() is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="ravelin-"))
    return context.getCheckpointDir()


def scratch_table(spark: SparkSession, name: str) -> str:
    """A new path for a table in this application's part of the shared folder, which is removed when the driver ends."""
    root = f"{shared_folder(spark).rstrip('/')}/ravelin-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_remove, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


_ROOTS: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  (the session may have ended already)
        pass


def cut(df: DataFrame, *done: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, its lineage cut.

    A written table rather than a checkpoint: it is compressed, its columns are
    pruned, and what the optimizer has inferred about ``df`` doesn't pile up
    from round to round.  ``done``: earlier cuts that nothing refers to any
    more once this one is written; they are removed.
    """
    spark = df.sparkSession
    path = scratch_table(spark, "cut")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ravelin_path = path
    for old in done:
        _remove(spark, old._ravelin_path)
    return out


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else unchanged (then Spark shuffles)."""
    seen = df.select(F.lit(1)).limit(rows + 1).count()
    return F.broadcast(df) if seen <= rows else df


def hot_keys(df: DataFrame, key: str, share: int = HOT_SHARE) -> list:
    """Keys that hold at least 1/``share`` of the rows with a key; never more than ``share`` of them.

    One pass, a sketch of frequent items (its error is below a tenth of 1/share).
    """
    seen = df.agg(F.expr(f"approx_top_k(`{key}`, {share + 1}, {TRACKED})").alias("top"), F.count(key).alias("n")).first()
    return [r["item"] for r in seen["top"] or [] if r["item"] is not None and r["count"] * share >= seen["n"]][:share]


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str, spread: Column, hot: list | None = None) -> DataFrame:
    """``left JOIN right USING (key)`` with the hot keys of ``left`` split into SALTS pieces.

    ``spread`` is an expression over ``left`` that varies within a key.  Only
    the rows of ``right`` with a hot key (at most HOT_SHARE keys) are copied.
    ``how`` is one of inner, left, left_semi and left_anti.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    salt = F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = right.withColumn("_salt", F.explode(copies))
    return left.withColumn("_salt", salt).join(copied, [key, "_salt"], how).drop("_salt")
