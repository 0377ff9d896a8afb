"""Readers of parquet tables and small helpers on the physical layout."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers of all executors this package, served by the driver; once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="tallyfold-code-")) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(_PACKAGE.rglob("*.py")):
            z.write(source, source.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a directory, as a file or as a folder of part files."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores where a small file would give fewer partitions than there are cores.

    On a large table the scan already has more partitions than cores and nothing is
    shuffled; only tables of a few row groups pay for the exchange.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *(F.col(k) for k in keys))


#: Bytes of input files that one partition of ``by_key`` stands for.
BYTES_A_PARTITION = 512 << 20


def input_bytes(df: DataFrame) -> int:
    """Size of the largest thing a plan reads, by the optimizer's statistics of its leaves; 0 if they don't know."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return max((s for s in sizes if s < 1 << 60), default=0)


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Partition once by a key that the next steps group by.

    The number of partitions follows from the size of what is read, and is one for each core
    at least: rows that are few and small but costly to work on would otherwise be merged
    into a handful of tasks.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-input_bytes(df) // BYTES_A_PARTITION)), *(F.col(k) for k in keys))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only where none is set and everything runs in one process."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tallyfold-checkpoint-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named
