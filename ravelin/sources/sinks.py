"""Writers: immutable generations behind a pointer, partitioned output, findings and reports as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions import text as T


def publish(tables: dict[str, DataFrame], root: str, generation: str) -> None:
    """Writes all tables as one new generation, then adds a pointer to it; readers see the old or the new one, whole.

    A pointer is a table of its own, never overwritten; the one with the
    greatest number counts.  A driver lost before that leaves the old one in force.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/generations/{generation}/{name}")
    number = (_pointer(spark, root) or (0, None))[0] + 1
    spark.createDataFrame([(number, generation)], "number bigint, generation string").coalesce(1).write.mode("errorifexists").parquet(f"{root}/pointers/p={number}")


def _pointer(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """(number, generation) of the greatest pointer that was written in full."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/pointers/p=*/_SUCCESS")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    numbers = [int(str(f.getPath().getParent().getName()).removeprefix("p=")) for f in found or []]
    if not numbers:
        return None
    return max(numbers), spark.read.parquet(f"{root}/pointers/p={max(numbers)}").first()["generation"]


def read_current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the generation that the pointer names."""
    pointer = _pointer(spark, root)
    if pointer is None:
        raise FileNotFoundError(f"nothing was published under {root}")
    return spark.read.parquet(f"{root}/generations/{pointer[1]}/{name}")


def reclaimable(generations: DataFrame, current: DataFrame, leases: DataFrame) -> DataFrame:
    """(generation) of those that are neither current nor leased."""
    kept = current.select("generation").unionByName(leases.select("generation"))
    return generations.select("generation").distinct().join(kept, "generation", "left_anti")


def append_runs(runs: DataFrame, root: str) -> None:
    """Run logs, appended under their run ids."""
    runs.write.mode("append").partitionBy("run_id").json(f"{root}/runs")


def sarif_results(diagnostics: DataFrame) -> DataFrame:
    """(doc_id, result): each diagnostic as a SARIF result object."""
    level = F.when(F.col("severity") == "info", "note").otherwise(F.col("severity"))
    result = F.to_json(F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("detail").alias("text")).alias("message"), F.col("line_no").alias("line")))
    return diagnostics.select("doc_id", result.alias("result"))


def mermaid_lines(edges: DataFrame) -> DataFrame:
    """(line): each distinct edge as a line of a graph text."""
    return edges.select(F.concat(T.mermaid_id("from_id"), F.lit(" -->|"), F.col("kind"), F.lit("| "), T.mermaid_id("to_id")).alias("line")).distinct()


def markdown_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(line): rows as lines of a Markdown table, cells escaped."""
    cells = [T.markdown_cell(F.col(c).cast("string")) for c in columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
