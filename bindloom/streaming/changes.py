"""A change feed: batches of replaced files keep a project's tables up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names
from ..index import Project

CHANGE = "file_path string, text string, deleted boolean, version long"


def read_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Changes as JSON lines in files that appear in a folder."""
    return spark.readStream.schema(CHANGE).json(folder)


def latest(changes: DataFrame) -> DataFrame:
    """The last version of each file of a batch."""
    last = Window.partitionBy("file_path").orderBy(F.desc("version"))
    return changes.withColumn("__k", F.row_number().over(last)).where("__k = 1").drop("__k")


def apply(project: Project, sources: DataFrame, changes: DataFrame) -> DataFrame:
    """The source table (file_path, text) after a batch: replaced, added and deleted files."""
    new = latest(changes)
    return sources.join(new.select("file_path"), "file_path", "left_anti").unionByName(new.where("not coalesce(deleted, false)").select("file_path", "text"))


def as_tree(sources: DataFrame) -> DataFrame:
    tree = sources.withColumn("language", names.language_of(F.col("file_path"))).where("language is not null")
    return tree.select("file_path", "language", F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("file_size"), "text")


def start(project: Project, feed: DataFrame, checkpoint: str, *, tier: str = "balanced"):
    """A running query that indexes each batch. The sources table is written before the batch's tables, by
    batch number, so a batch that is played again after a crash gives the same tables."""
    spark = project.spark

    def batch(changes: DataFrame, number: int) -> None:
        root = f"{project.folder.rstrip('/')}/sources"
        before = spark.read.parquet(f"{root}/{number - 1}") if number else spark.createDataFrame([], "file_path string, text string")
        apply(project, before, changes).write.mode("overwrite").parquet(f"{root}/{number}")
        project.index(as_tree(spark.read.parquet(f"{root}/{number}")), tier=tier)

    return feed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()
