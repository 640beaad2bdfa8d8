"""Shared folders, written tables and connected components for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copperline.operators.contraction import star_labels


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only on a local master (tests, a laptop) is a temporary folder set where the session names none; a cluster
    without one raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="copperline-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; ``name`` only helps a reader of the folder."""
    return f"{shared_root(spark)}/copperline/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, scratch: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors.

    ``scratch`` receives the path, for ``drop`` once nothing reads the table any more.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    # Shuffle files go once the JVM has collected the plan that made them; it would not come to that for long.
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, scratch: list[str]) -> None:
    """Delete tables that ``stored`` wrote; what was made of them must itself be stored or checkpointed."""
    for path in scratch:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    scratch.clear()


#: Bytes of an Arrow batch between Spark and its Python workers.
ARROW_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches are bounded by bytes too, so that long texts don't add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a query; queries run with bounded batches."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node reachable.

    Stars are contracted (``contraction.star_labels``), so a chain of any length takes a logarithm of rounds. Each step is a
    stored table, and the one before goes. (A checkpoint keeps the estimated size of the plan that made it; joined
    round after round these estimates are multiplied, to numbers of gigabytes in the driver after a dozen rounds.)
    Rows with a null end are ignored; an empty input gives an empty output.
    """
    before: list[str] = []

    def cut(df: DataFrame) -> DataFrame:
        made: list[str] = []
        out = stored(df, "components", made)
        drop(links.sparkSession, before)  # a step reads the last one alone
        before.extend(made)
        return out

    return star_labels(links.select("a", "b"), [], cut).select("node", F.col("label").alias("component"))
