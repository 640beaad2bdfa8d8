"""An extension: netlist exports that arrive in a folder, as a stream of net pins.

Each new or rewritten ``pstxnet.dat`` below the folder is parsed once; its design is the folder it lies in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copperline.sources import cadence

FILES = "path string, modificationTime timestamp, length long, content binary"


def net_pin_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """(design_id, net, net_ord, refdes, ref_ord, pin, pin_ord), appended as files arrive."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", "pstxnet.dat").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return cadence.stage_nets(files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("design_id"), F.lit("pstxnet").alias("kind"), "content"))
