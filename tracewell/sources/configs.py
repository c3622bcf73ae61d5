"""Configuration documents (JSON) as rows of parameters: bands, times and other axes of each metric."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Axes on which a name may stand for several intervals.
REPEATED = ("times",)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(source, text): each file whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.col("value").alias("text"))


def axis_rows(documents: DataFrame, axes: Sequence[str] = ("bands", "times"), repeated: Sequence[str] = REPEATED) -> DataFrame:
    """Intervals of documents {metric: {axis: [{name, start, end}, ...]}}: source, metric, axis, rank (from 0), name, start, end.

    Rows are ranked by start, then by their place in the document. Entries without a name, without numbers, or whose end does not exceed their start go; of
    entries of one name the first good one stays, but on a ``repeated`` axis all of them. What is not an object or a list where one is expected, and
    text that is no JSON, gives no row.
    """
    spark = documents.sparkSession
    docs = documents.select("source", F.try_parse_json("text").alias("_doc")).where("_doc is not null")
    metrics = docs.lateralJoin(spark.tvf.variant_explode(F.col("_doc").outer())).select("source", F.col("key").alias("metric"), F.col("value").alias("_metric")).where("metric is not null")
    sections = metrics.lateralJoin(spark.tvf.variant_explode(F.col("_metric").outer())).where(F.col("key").isin(*axes)).select("source", "metric", F.col("key").alias("axis"), F.col("value").alias("_list"))
    entries = sections.lateralJoin(spark.tvf.variant_explode(F.col("_list").outer())).where(F.col("key").isNull())
    get = lambda c, kind: F.try_variant_get("value", f"$.{c}", kind)
    rows = entries.select("source", "metric", "axis", F.col("pos").alias("_place"), F.trim(get("name", "string")).alias("name"), *(get(c, "string").try_cast("double").alias(c) for c in ("start", "end")))
    rows = rows.where("name <> '' and end > start")
    own = Window.partitionBy("source", "metric", "axis")
    first = F.row_number().over(Window.partitionBy("source", "metric", "axis", "name").orderBy("_place"))
    rows = rows.withColumn("_first", first).where(F.col("axis").isin(*repeated) | (F.col("_first") == 1))
    return rows.select("source", "metric", "axis", (F.row_number().over(own.orderBy("start", "_place")) - 1).alias("rank"), "name", "start", "end")
