"""A data source of designs: a question to one design opens that design's files.

``index`` writes a table of ranges, what a task reads of a file, in folders by a hash of the design's id. The sources
``netlist_lines`` (text exports, as rows of lines) and ``netlist_records`` (sheets, as rows of records) read through it.
Planning lists names only: a file of the index holds at most ``RANGES`` ranges and is one partition, so a design of any
size is many tasks. Equality with ids, or a list of them, is pushed into the source: of the index only the folders of
these ids are listed, of their ranges only those of the ids are opened. Other filters stay with Spark.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from copperline.functions import exprs
from copperline.sources import altium, splits
from copperline.sources.files import located, opened

#: Folders of an index, and ranges of one of its files.
BUCKETS, RANGES = 256, 16
_KEY = ("design_id",)
SHEET_KIND = "sheet"


def index(ranges: DataFrame, path: str, buckets: int = BUCKETS) -> str:
    """Write the ranges (design_id, kind, path, size, block, start, length, base) as an index; its path. Rows without an id go.

    The place of a line is ``base`` and the place in its file: files that are parts of one export have bases that rise with them.
    """
    rows = ranges.where("design_id IS NOT NULL").select("design_id", "kind", "path", "size", "block", "start", "length", "base")
    rows = rows.withColumns({"buckets": F.lit(buckets), "bucket": (F.crc32(F.col("design_id").cast("binary")) % buckets).cast("int")})
    # The ranges of a large design are spread over tasks by their files; small designs of a folder may share one.
    rows.repartition("bucket", F.expr(f"start div ({RANGES} * length)")).write.partitionBy("buckets", "bucket").option("maxRecordsPerFile", RANGES).parquet(path)
    return path


def export_ranges(wanted: DataFrame, split: int = splits.SPLIT) -> DataFrame:
    """The ranges of the text exports that rows (design_id, kind, path) name."""
    rows = splits.ranges(wanted.select("design_id", "kind", "path"), split)
    return rows.select("*", F.expr(f"start div {split}").alias("block"), F.lit(split).cast("long").alias("length"), F.lit(0).cast("long").alias("base"))


def sheet_ranges(sheets: DataFrame) -> DataFrame:
    """The ranges of sheets given as (design_id, sheet, sheet_ord), ``sheet`` being a file's path: each is read whole, by seeking."""
    rows = splits.ranges(sheets.select("design_id", F.lit(SHEET_KIND).alias("kind"), F.col("sheet").alias("path"), F.col("sheet_ord").cast("long").alias("block")), 1 << 62)
    return rows.select("*", F.col("size").alias("length"), F.lit(0).cast("long").alias("base"))


@dataclass
class IndexFile(InputPartition):
    path: str


class _Reader(DataSourceReader):
    """Reads the ranges of an index; ``ids`` are the designs that are asked for, None for all."""

    def __init__(self, path: str, sheets: bool) -> None:
        self.path, self.sheets = path, sheets
        self.ids: frozenset[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == _KEY:
                ids = frozenset([f.value] if isinstance(f, EqualTo) else f.value) - {None}
                self.ids = ids if self.ids is None else self.ids & ids
            elif not (isinstance(f, IsNotNull) and f.attribute == _KEY):  # an index holds no null ids
                yield f

    def partitions(self) -> list[IndexFile]:
        from pyarrow import fs

        system, base = located(self.path)
        roots = [f for f in system.get_file_info(fs.FileSelector(base)) if f.base_name.startswith("buckets=")]
        folders = []
        for root in roots:  # one, or none of an empty index
            if self.ids is None:
                folders.append(root.path)
            else:
                n = int(root.base_name.partition("=")[2])
                folders += sorted({f"{root.path}/bucket={zlib.crc32(i.encode()) % n}" for i in self.ids})
        found = [f for d in folders for f in system.get_file_info(fs.FileSelector(d, allow_not_found=True, recursive=True))]
        return [IndexFile(f.path) for f in found if f.base_name.endswith(".parquet")]

    def read(self, partition: IndexFile | None) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        if partition is None:
            return
        system, _ = located(self.path)
        with system.open_input_file(partition.path) as f:
            ranges = pq.ParquetFile(f).read().to_pylist()  # RANGES rows
        for r in ranges:
            if self.ids is not None and r["design_id"] not in self.ids or (r["kind"] == SHEET_KIND) != self.sheets:
                continue
            with opened(r["path"]) as source:
                if self.sheets:
                    yield from altium.read_records(r["design_id"], r["path"], r["block"], source)
                else:
                    for places, lines in splits.line_batches(source, r["size"], r["start"], r["length"]):
                        yield splits.batch(r["design_id"], r["kind"], r["block"], pc.add(places, r["base"]), lines)


class ExportLines(DataSource):
    """``netlist_lines``: rows of ``splits.LINES`` of the text exports of an index, lines as they are."""

    @classmethod
    def name(cls) -> str:
        return "netlist_lines"

    def schema(self) -> str:
        return splits.LINES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], sheets=False)


class SheetRecords(DataSource):
    """``netlist_records``: rows of ``altium.RECORDS`` of the sheets of an index."""

    @classmethod
    def name(cls) -> str:
        return "netlist_records"

    def schema(self) -> str:
        return altium.RECORDS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], sheets=True)


def register(spark: SparkSession) -> None:
    """Make both sources known to the session, and let it push filters into them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ExportLines, SheetRecords):
        spark.dataSource.register(source)


def export_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of an index's text exports, trimmed, for ``cadence.netlist_of_lines``."""
    register(spark)
    return spark.read.format("netlist_lines").load(path).withColumn("line", exprs.trimmed(F.col("line")))


def sheet_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of an index's sheets, for ``altium.netlist_of_records``."""
    register(spark)
    return spark.read.format("netlist_records").load(path)
