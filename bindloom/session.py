"""Sessions with the settings that the operators are laid out for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive plans: coalesced partitions, split skewed joins. Everything else is the cluster's own.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configured(builder: SparkSession.Builder | None = None) -> SparkSession:
    """A session with SETTINGS, from a builder or that of a submitted application."""
    return (builder or SparkSession.builder).config(map=SETTINGS).getOrCreate()


#: For plans over a handful of rows, where compiling costs more than running.
TINY = {
    "spark.sql.codegen.wholeStage": "false",
    "spark.sql.codegen.factoryMode": "NO_CODEGEN",
    "spark.sql.adaptive.enabled": "false",
    "spark.driver.extraJavaOptions": "-XX:TieredStopAtLevel=1",
}


def local_session(name: str, *, cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "4g", tiny: bool = False) -> SparkSession:
    """A session on this machine, for tests (``tiny``) and measurements."""
    own = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = configured(SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=own | (TINY if tiny else {})))
    if tiny:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
    return spark
