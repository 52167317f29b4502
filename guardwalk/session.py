"""Session helpers shared by tests, bench and operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def local_session(cpus: str | int = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A local[cpus] session with the settings the engine is tested under."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("guardwalk")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the session's own setting, else one made for local runs."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(named)
        return named
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor shares")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="guardwalk-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


class Rounds:
    """Results of an iteration's rounds as Parquet in the shared folder: a round's plan holds nothing of the rounds before it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{checkpoint_dir(spark)}/rounds-{uuid.uuid4().hex}", 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path, compression="zstd")
        return self.spark.read.schema(df.schema).parquet(path)

    def kept(self, df: DataFrame) -> DataFrame:
        """A part of the answer, as Parquet that stays when the rounds' files go."""
        self.n += 1
        path = f"{self.folder}-kept/{self.n}"
        df.write.parquet(path, compression="zstd")
        return self.spark.read.schema(df.schema).parquet(path)

    def last(self, df: DataFrame) -> DataFrame:
        """The answer, checkpointed; the rounds' files go."""
        out = df.checkpoint()
        self.close()
        return out

    def close(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: list[str], rounds: Rounds, name: str = "number") -> DataFrame:
    """Rows with their number from 0 in the order of unique `order` columns: ranges are numbered apart, then moved by the sizes of those before them."""
    parts = rounds.cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))  # a row a partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    own = parts.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return own.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") - 1).drop("_part", "_before", "_at")
