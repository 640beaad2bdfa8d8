"""Finding designs: one listing of files, then joins.

A listing has path, dir, name, stem and ext (lower case, with its dot). Tasks list folders and read files' contents.
"""

from __future__ import annotations

import errno
import os
import posixpath
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copperline.operators.matching import greedy
from copperline.operators.xnet import cut
from copperline.sources.files import opened

# File types and the names of a complete data set.
CADENCE_EXTENSIONS = [".dsn", ".cpm"]
ALTIUM_EXTENSIONS = [".prjpcb"]
SHEET_EXTENSION = ".schdoc"
DAT_FILES = ["pstxnet.dat", "pstxprt.dat", "pstchip.dat"]
OLE_MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")

NOT_EXPORTED = "Netlist files not exported. Run export_cadence_netlist to generate them."

LISTING = "path string, dir string, name string, stem string, ext string"


def normal_path(path: str) -> str:
    """Forward slashes, without . and .. steps; a trailing slash stays."""
    plain = path.replace("\\", "/")
    out = posixpath.normpath(plain)
    return out + "/" if plain.endswith("/") and out not in (".", "/") else out


def extension(path: str) -> str:
    name = posixpath.basename(path)
    return posixpath.splitext(name)[1].lower()


#: File systems whose folders tasks open by themselves; folders of others are listed through the driver's.
TASK_SCHEMES = ("", "file", "hdfs", "s3", "s3a", "gs", "abfs")
#: Entries of a folder that leave a task at once.
PAGE = 10_000

_ENTRIES = "folder string, path string, is_folder boolean"


def _entries(folder: str) -> Iterator[tuple[str, bool]]:
    """(path, whether it is a folder) of what lies in a folder; links to folders are not followed, folders that may not be read are empty."""
    if "://" in folder:
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(folder)
        root = folder[: len(folder) - len(name)] if folder.endswith(name) else folder.split("://")[0] + "://"
        for entry in system.get_file_info(fs.FileSelector(name)):
            yield root + entry.path, entry.type == fs.FileType.Directory
        return
    try:
        with os.scandir(folder) as found:
            for entry in found:
                if entry.is_dir(follow_symlinks=False):
                    yield entry.path, True
                elif entry.is_file():
                    yield entry.path, False
    except OSError as e:
        if e.errno != errno.EACCES:
            raise


def _listed_folders(folders: DataFrame) -> DataFrame:
    """The entries of each folder (path), a page at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                entries = _entries(folder)
                while page := list(islice(entries, PAGE)):
                    paths, kinds = zip(*page, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([folder] * len(page), pa.string()), pa.array(paths, pa.string()), pa.array(kinds, pa.bool_())], names=["folder", "path", "is_folder"])

    return folders.select("path").mapInArrow(run, _ENTRIES)


def _driver_listed(spark: SparkSession, base: str) -> Iterator[str]:
    """Files below a folder of a file system that only the JVM opens."""
    jvm = spark.sparkContext._jvm
    system = jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    todo = [jvm.org.apache.hadoop.fs.Path(base)]
    while todo:
        try:
            found = list(system.listStatus(todo.pop()))
        except Exception as e:
            if "AccessControlException" in str(e):
                continue
            raise
        for status in found:
            if status.isDirectory():
                todo.append(status.getPath())
            else:
                yield status.getPath().toString()


def _base(spark: SparkSession, root: str) -> str:
    """A root with its scheme; one without lies on the session's default file system. Local ones are plain paths."""
    if "://" not in root:
        root = posixpath.abspath(normal_path(root))
        default = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(spark.sparkContext._jsc.hadoopConfiguration()).toString()
        root = root if default.startswith("file:") else default.rstrip("/") + root
    if root.startswith("file://"):
        root = root.removeprefix("file://")
    return root.rstrip("/") or "/"


def as_listing(paths: DataFrame) -> DataFrame:
    """Rows of a listing from rows (path)."""
    name = F.regexp_extract("path", "[^/]*$", 0)
    dot = F.regexp_extract(name, r"^\.*[^.].*(\.[^.]*)$", 1)  # a name that begins with its only dot has no type
    folder = F.regexp_replace("path", "/[^/]*$", "")
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(dot))
    return paths.select("path", F.when(folder == "", "/").otherwise(folder).alias("dir"), name.alias("name"), stem.alias("stem"), F.lower(dot).alias("ext"))


def listing(spark: SparkSession, *roots: str) -> DataFrame:
    """All files below the roots, each once. Folders that may not be read are passed over, other errors are raised.

    Folders are rows and tasks list them, a round for each level of the tree; every round's entries are cut, so that a
    lost task lists its own folders again. A folder with very many files leaves its task page by page.
    """
    bases = sorted({_base(spark, r) for r in roots})
    inside = lambda b: any(b != c and b.startswith(c.rstrip("/") + "/") for c in bases)
    bases = [b for b in bases if not inside(b)]
    by_task = [b for b in bases if b.partition("://")[0 if "://" in b else 1] in TASK_SCHEMES]
    files = spark.createDataFrame([(p,) for b in bases if b not in by_task for p in _driver_listed(spark, b)], "path string")
    level = spark.createDataFrame([(b,) for b in by_task], "path string")
    n = len(by_task)
    while n:
        # A folder may hold anything: without a number, adaptive execution would join these few rows into one task.
        entries = cut(_listed_folders(level.repartition(min(n, 1 << 12), "path")))
        files = files.unionByName(entries.where("NOT is_folder").select("path"))
        level = entries.where("is_folder").select("path")
        n = level.count()
    return as_listing(files)


def dat_sets(files: DataFrame) -> DataFrame:
    """(dat_dir, pstxnet, pstxprt, pstchip) of the folders that hold all three files, in any case."""
    lower = F.lower("name")
    found = files.where(lower.isin(DAT_FILES)).groupBy(F.col("dir").alias("dat_dir")).agg(*[F.max(F.when(lower == n, F.col("path"))).alias(n.removesuffix(".dat")) for n in DAT_FILES])
    return found.where("pstxnet IS NOT NULL AND pstxprt IS NOT NULL AND pstchip IS NOT NULL")


def _ancestors(path) -> F.Column:
    """The folder and all folders above it."""
    steps = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.when(n == 1, "/").otherwise(F.array_join(F.slice(steps, F.lit(1), n), "/")))


def dat_candidates(designs: DataFrame, sets: DataFrame) -> DataFrame:
    """Designs (path, dir, stem) with each data set at or below their folder, and its score.

    A data set whose path from the design's folder has a step named like the design is worth 1000; each step
    costs one. The containment is an equality join on the ancestors of the data set.
    """
    above = sets.select("dat_dir", "pstxnet", "pstxprt", "pstchip", F.explode(_ancestors(F.col("dat_dir"))).alias("dir"))
    rows = designs.select("path", "dir", "stem").join(above, "dir")
    relative = F.filter(F.split(F.expr("substring(dat_dir, length(dir) + 1)"), "/"), lambda s: s != "")
    named = F.exists(relative, lambda s: F.lower(s) == F.lower("stem"))
    return rows.withColumn("score", F.when(named, 1000).otherwise(0) - F.size(relative))


def cadence_designs(files: DataFrame) -> DataFrame:
    """(name, format, path, pstxnet, pstxprt, pstchip, error): every design file, each data set given to one at most."""
    designs = files.where(F.col("ext").isin(CADENCE_EXTENSIONS))
    candidates = dat_candidates(designs, dat_sets(files))
    pairs = candidates.select(F.lit("all").alias("root"), F.col("path").alias("design"), F.col("dat_dir").alias("data_set"), "score")
    chosen = greedy(pairs, ["root"]).select(F.col("design").alias("path"), F.col("data_set").alias("dat_dir"))
    rows = designs.join(chosen, "path", "left").join(dat_sets(files), "dat_dir", "left")
    kind = F.when(F.col("ext") == ".dsn", "cadence-cis").otherwise("cadence-hdl")
    return rows.select(F.col("stem").alias("name"), kind.alias("format"), "path", "pstxnet", "pstxprt", "pstchip", F.when(F.col("pstxnet").isNull(), F.lit(NOT_EXPORTED)).alias("error"))


def best_dat_set(files: DataFrame, designs: DataFrame) -> DataFrame:
    """The best data set of each design on its own, whatever other designs use: path, dat_dir and the three files."""
    rows = dat_candidates(designs, dat_sets(files))
    first = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), "dat_dir"))
    return rows.withColumn("n", first).where("n = 1").select("path", "dat_dir", "pstxnet", "pstxprt", "pstchip")


def contents(paths: DataFrame, size: int | None = None) -> DataFrame:
    """(path, content) of the files that ``paths`` (path) names, or of their first ``size`` bytes; missing ones give no row.

    Tasks open the files, so nothing is listed, loaded or read twice for them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with opened(path) as f:
                        content = f.read(size)
                except (FileNotFoundError, IsADirectoryError):
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary())], names=["path", "content"])

    return paths.select("path").distinct().mapInArrow(run, "path string, content binary")


def document_paths(project: str, content: bytes) -> list[str]:
    """The sheets that a project file names, as absolute paths in the order of the file."""
    out: dict[str, None] = {}
    for line in content.decode("utf-8", "replace").split("\n"):
        key, equals, value = line.strip().partition("=")
        if not equals or key.lower() != "documentpath":
            continue
        path = value.strip().strip('"').split("|")[0].strip().replace("\\", "/")
        drive = len(path) > 2 and path[0].isalpha() and path[1:3] == ":/"
        if path.lower().endswith(SHEET_EXTENSION) and not path.startswith("/") and not drive:
            out.setdefault(posixpath.normpath(posixpath.join(posixpath.dirname(project), path)))
    return list(out)


def named_sheets(projects: DataFrame) -> DataFrame:
    """(path, sheet) of project files given as (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sheets = document_paths(path, content or b"")
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(sheets), pa.string()), pa.array(sheets, pa.string())], names=["path", "sheet"])

    return projects.select("path", "content").mapInArrow(run, "path string, sheet string")


def project_sheets(files: DataFrame, read: Callable[[DataFrame, int | None], DataFrame] = contents) -> DataFrame:
    """(path, sheet): the OLE sheets of each project; of one that names none, the only sheet in its folder's tree.

    ``read`` gives the contents of files, or their first bytes. Sheets that a project names may lie outside the listing.
    """
    projects = files.where(F.col("ext").isin(ALTIUM_EXTENSIONS)).select("path", F.col("dir").alias("project_dir"))
    listed = named_sheets(read(projects, None))
    sheets = files.where(F.col("ext") == SHEET_EXTENSION).select(F.col("path").alias("sheet"))
    heads = read(sheets.union(listed.select("sheet")).select(F.col("sheet").alias("path")), len(OLE_MAGIC))
    magic = heads.where(F.col("content") == F.lit(OLE_MAGIC)).select(F.col("path").alias("sheet"))
    own = listed.join(magic, "sheet").select("path", "sheet").distinct()
    inside = magic.join(sheets, "sheet").select("sheet", F.explode(_ancestors(F.regexp_replace("sheet", "/[^/]*$", ""))).alias("project_dir"))
    alone = projects.join(own, "path", "left_anti").join(inside, "project_dir").groupBy("path").agg(F.count("*").alias("n"), F.first("sheet").alias("sheet")).where("n = 1").select("path", "sheet")
    return own.unionByName(alone)


def altium_designs(files: DataFrame, read: Callable[[DataFrame, int | None], DataFrame] = contents) -> DataFrame:
    """(name, format, path, sheets, error) of every project; sheets in collated order."""
    from copperline.functions.exprs import collated

    sheets = project_sheets(files, read).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct(collated(F.col("sheet")).alias("k"), "sheet"))), lambda s: s["sheet"]).alias("sheets"))
    rows = files.where(F.col("ext").isin(ALTIUM_EXTENSIONS)).join(sheets, "path", "left")
    error = F.when(F.col("sheets").isNull(), F.concat(F.lit("No schematic documents found for project '"), "stem", F.lit("'.")))
    return rows.select(F.col("stem").alias("name"), F.lit("altium").alias("format"), "path", F.coalesce("sheets", F.array().cast("array<string>")).alias("sheets"), error.alias("error"))
