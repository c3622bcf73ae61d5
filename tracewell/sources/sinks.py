"""Writers: partitioned tables, flat exports, atomic replacement."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.cohort import rename_record
from tracewell.operators.intervals import reduce_or


def write_features(df: DataFrame, path: str, by: Sequence[str] = ("metric", "subject")) -> None:
    """Partitioned Parquet; only the partitions that df holds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_scalars_csv(df: DataFrame, path: str) -> None:
    """CSV for people: nested columns become JSON text."""
    flat = [F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, header=True)


def write_traces_csv(traces: DataFrame, inventory: DataFrame, path: str) -> None:
    """Long traces and one row per parameter set."""
    traces.write.mode("overwrite").csv(f"{path}/traces", header=True)
    inventory.write.mode("overwrite").csv(f"{path}/parameters", header=True)


#: One row for each version and table; rows are only ever added.
_VERSIONS = "number long, version string, name string, path string"


def _latest(spark: SparkSession, root: str) -> list:
    """Rows of the highest complete version below root; none before the first."""
    try:
        known = spark.read.schema(_VERSIONS).parquet(f"{root}/VERSIONS")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    last = known.orderBy(F.desc("number"), F.desc("version")).select("number", "version").first()
    return known.where((F.col("number") == last[0]) & (F.col("version") == last[1])).collect() if last else []


def stage_version(spark: SparkSession, tables: dict[str, DataFrame], root: str, write_fn: Callable[[DataFrame, str], None] | None = None) -> list[tuple[int, str, str, str]]:
    """Write tables under a folder of their own; no reader sees them before ``commit_version``. Tables of the version before that are not given stay in the new one.

    ``write_fn`` writes a table to a path, by default as Parquet.
    """
    before = _latest(spark, root)
    version = spark.sql("select uuid() u").first().u
    number = max((r.number for r in before), default=0) + 1
    paths = {r.name: r.path for r in before}
    for name, df in tables.items():
        path = f"{root}/{version}/{name}"
        write_fn(df, path) if write_fn else df.write.parquet(path)
        paths[name] = path
    return [(number, version, name, path) for name, path in paths.items()]


def commit_version(spark: SparkSession, rows: list[tuple[int, str, str, str]], root: str) -> str:
    """Make a staged version the current one: one file is added, none is changed. Of two versions of one number the greater name wins."""
    spark.createDataFrame(rows, _VERSIONS).coalesce(1).write.mode("append").parquet(f"{root}/VERSIONS")
    return rows[0][1]


def replace_all(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> str:
    """Write several tables as one version, complete before any reader goes to it. Returns the version; readers go through ``current``."""
    return commit_version(spark, stage_version(spark, tables, root), root)


def current(spark: SparkSession, name: str, root: str) -> DataFrame:
    """A table of the current version. What was read stays as it is when a later version comes."""
    paths = {r.name: r.path for r in _latest(spark, root)}
    if name not in paths:
        raise ValueError(f"no table {name} below {root}")
    return spark.read.parquet(paths[name])


def rename_stored(spark: SparkSession, root: str, old: str, new: str) -> list[str]:
    """Rename a record in all stored tables that hold it, as one new version; the others keep their files. Returns the names of those rewritten."""
    changed = {}
    for row in _latest(spark, root):
        df = spark.read.parquet(row.path)
        columns = [c for c in ("record", "Record") if c in df.columns]
        if columns and not df.where(reduce_or([F.col(c) == old for c in columns])).isEmpty():
            changed[row.name] = rename_record(df, old, new)
    if changed:
        replace_all(spark, changed, root)
    return sorted(changed)


def sync_artifacts(markers: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """Markers with a ``paired`` flag (side: ref or ext)."""
    used = pairs.select(F.col(f"{side}_id").alias("id"), F.lit(True).alias("paired")).distinct()
    return markers.join(used, "id", "left").withColumn("paired", F.coalesce("paired", F.lit(False)))


def write_coordinates(channels: DataFrame, ordered: DataFrame, unordered: DataFrame, path: str) -> None:
    """The three coordinate tables of a record."""
    for name, df in (("channel", channels), ("ordered_pair", ordered), ("unordered_pair", unordered)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
