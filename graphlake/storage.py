"""Tables written between the rounds of an iteration.

A fixpoint over DataFrames needs its lineage cut once a round. Rounds are
written as Parquet into the folder the cluster names in
``spark.checkpoint.dir``, which all executors share, so that the loss of an
executor costs a re-read and never the state. The folder is taken from the
session; only a local session that names none gets a temporary one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for written rounds."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="graphlake-")
    return _LOCAL[app]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, a Parquet file or folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Rounds:
    """Writes the rounds of one iteration and drops those no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.written = 0

    def write(self, df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
        """The DataFrame read back from its written copy, and metrics of its rows.

        Metrics are observed while the rows are written, without another job.
        """
        path = f"{self.base}/{self.written}"
        self.written += 1
        seen: dict = {}
        if metrics:
            obs = Observation()
            df.observe(obs, *(c.alias(k) for k, c in metrics.items())).write.mode("overwrite").parquet(path)
            seen = obs.get
        else:
            df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._round_path = path
        return out, seen

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete written rounds; DataFrames that were not written here are left alone."""
        for t in tables:
            path = getattr(t, "_round_path", None)
            if path:
                hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)


