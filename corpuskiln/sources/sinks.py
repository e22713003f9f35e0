"""Sinks: JSON lines, partitioned indexes, CSV and chat exports, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.operators.state import unseen


def append_unseen(new: DataFrame, path: str, keys: list[str], exists: bool) -> None:
    """Resume: appends only rows whose keys are not there yet."""
    rows = unseen(new, new.sparkSession.read.schema(new.schema).json(path), keys) if exists else new
    rows.write.mode("append").json(path)


def write_index(points: DataFrame, path: str) -> None:
    """A collection partitioned by the filters that searches use, so that they prune."""
    points.repartition("source_type", "valid_from_year", F.pmod(F.xxhash64("act_id"), F.lit(16))).write.mode("overwrite").partitionBy("source_type", "valid_from_year").parquet(path)


def replace_user_documents(rows: DataFrame, path: str) -> None:
    """Private collections: only the (user, document) partitions that the rows name are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("user_id", "doc_id").parquet(path)


def drop_private(spark: SparkSession, path: str, caller: str | None, user_id: str, doc_id: str | None = None) -> bool:
    """Drops the partitions of a user, or of one document of theirs, by their folders: no row is read or written.

    Only the owner may: a caller without identity or another user raises PermissionError before anything is touched. Gives
    False where there is nothing to drop, so a call that is repeated after a failure does no harm."""
    if not caller or caller != user_id:
        raise PermissionError("only the owner may drop a private collection")
    jvm = spark._jvm
    escaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName  # as Spark names partition folders
    folders = [f"user_id={escaped(user_id)}", *([] if doc_id is None else [f"doc_id={escaped(doc_id)}"])]
    folder = jvm.org.apache.hadoop.fs.Path("/".join([path, *folders]))
    return bool(folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True))


def feedback_csv(rows: DataFrame, path: str) -> None:
    rows.withColumn("answer", F.substring("answer", 1, 500)).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def json_text(rows: DataFrame, path: str, *columns: str) -> None:
    rows.select(F.to_json(F.struct(*columns)).alias("value")).write.mode("overwrite").text(path)


def markdown_sources(sources: Column) -> Column:
    """Numbered list of source structs (title, url)."""
    return F.array_join(F.transform(sources, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". ["), s["title"], F.lit("]("), s["url"], F.lit(")"))), "\n")
