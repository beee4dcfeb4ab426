"""A5. Rendered documents on shared storage, with pointers to the current ones.

Every batch of documents is a folder of its own, whose files are never changed.  Pointers say which batch
and which of its files hold a document now.  They stand in buckets by hash of format and path; a commit
rewrites the buckets that its batch touches and names, in a directory of one row per bucket, the build that
holds each bucket.  So a batch costs what it replaces, and a reader neither groups the history nor opens a
file of which all documents have been replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark import model as m
from shelfmark.operators import export
from shelfmark.shared import written
from shelfmark.sources.commits import Conflict, commit, new_name, version

BUCKETS = 256
_KEY, _FILE = ["format", "path"], ["format", "batch", "file"]
_DIRECTORY = "bucket INT, build STRING"
_POINTER = "format STRING, path STRING, bucket INT, batch STRING, file STRING, documents BIGINT"
_DOCUMENT = "path STRING, part BIGINT, content STRING"


def _directory(spark: SparkSession, path: str, number: int) -> DataFrame:
    """``bucket, build`` of a commit; empty for number 0."""
    if number == 0:
        return spark.createDataFrame([], _DIRECTORY)
    name = spark.read.text(f"{path}/commits/{number:020d}", wholetext=True).first()[0]
    return spark.read.schema(_DIRECTORY).parquet(f"{path}/directories/{name}")


def pointers(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """``format, path, bucket, batch, file, documents``: where the documents of a commit stand, by default the
    latest one; a document of several files has a row for each.  ``documents`` is the number in the file."""
    number = version(spark, path) if number is None else number
    directory = _directory(spark, path, number)
    # At most one per bucket.
    builds = [r["build"] for r in directory.select("build").distinct().collect()]
    if not builds:
        return spark.createDataFrame([], _POINTER)
    rows = spark.read.schema(f"{_POINTER}, build STRING").option("basePath", f"{path}/pointers")
    rows = rows.parquet(*[f"{path}/pointers/build={b}" for b in builds])
    return rows.join(directory, ["bucket", "build"], "left_semi").drop("build")


def _of_batch(spark: SparkSession, path: str, batch: str) -> DataFrame:
    """The pointers of a batch that has been written; only paths are read."""
    rows = spark.read.schema(f"{_DOCUMENT}, format STRING").parquet(f"{path}/documents/batch={batch}")
    held = rows.select(*_KEY, F.col("_metadata.file_name").alias("file")).distinct()
    return held.select(
        *_KEY,
        F.pmod(F.xxhash64(*_KEY), F.lit(BUCKETS)).cast("int").alias("bucket"),
        F.lit(batch).alias("batch"),
        "file",
        F.count("*").over(Window.partitionBy("format", "file")).alias("documents"),
    )


def write_exports(documents: DataFrame, path: str) -> int:
    """A5. Add rendered documents ``format, path, part, content`` to the exports in ``path``.

    Documents of the same format and path are replaced; all others stay, whatever their format.  The
    index is not taken over: it is that of the whole bundle, see ``bundle_index``.  When several writers
    commit at once each one's documents are kept, and of the same document those of the last commit.
    The number of the commit.
    """
    spark, batch = documents.sparkSession, new_name()
    part = F.col("part").cast("bigint").alias("part")
    own = documents.where(~((F.col("format") == m.OKF) & (F.col("path") == "index.md")))
    # Written first, as a range shuffle asks for its rows twice: documents are rendered once.
    own = written(own.select("format", "path", part, "content"), "rendered")
    own.repartitionByRange("format", "path", "part").write.partitionBy("format").parquet(
        f"{path}/documents/batch={batch}"
    )
    new = written(_of_batch(spark, path, batch), "pointers")
    buckets = new.select("bucket").distinct()
    while True:
        number, build = version(spark, path), new_name()
        old = pointers(spark, path, number).join(buckets, "bucket", "left_semi")
        others = old.join(new.select(*_KEY).distinct(), _KEY, "left_anti")
        others.unionByName(new).repartitionByRange("bucket", *_KEY).write.parquet(f"{path}/pointers/build={build}")
        kept = _directory(spark, path, number).join(buckets, "bucket", "left_anti")
        directory = kept.unionByName(buckets.withColumn("build", F.lit(build)))
        directory.coalesce(1).write.parquet(f"{path}/directories/{build}")
        try:
            return commit(spark, path, number, build)
        except Conflict:
            continue  # somebody was faster: their documents are pointed to as well


def read_exports(
    spark: SparkSession, path: str, formats: list[str] | None = None, number: int | None = None
) -> DataFrame:
    """A5. The current documents ``format, path, part, content``: of each the last one written.

    Files whose documents are all current are read as they are; only those that hold replaced documents
    as well are joined with the pointers.
    """
    current = pointers(spark, path, number)
    if formats is not None:
        current = current.where(F.col("format").isin(formats))
    # One row per file, of which Spark's own list of files is made.
    files = current.groupBy(*_FILE).agg((F.count("*") == F.max("documents")).alias("whole")).collect()

    def read(whole: bool) -> DataFrame:
        places = [f"{path}/documents/batch={f.batch}/format={f.format}/{f.file}" for f in files if f.whole == whole]
        kind = f"{_DOCUMENT}, batch STRING, format STRING"
        if not places:
            return spark.createDataFrame([], kind)
        return spark.read.schema(kind).option("basePath", f"{path}/documents").parquet(*places)

    columns = ["format", "path", "part", "content"]
    rows = read(True).select(*columns)
    if all(f.whole for f in files):
        return rows
    mixed = read(False).join(current.select(*_KEY, "batch").distinct(), [*_KEY, "batch"], "left_semi")
    return rows.union(mixed.select(*columns))


def bundle_index(spark: SparkSession, path: str) -> DataFrame:
    """A5, E6. The index ``path, part, content`` of all knowledge-bundle documents in the exports."""
    # Front matter stands in a document's first part.
    first = read_exports(spark, path, [m.OKF]).where(F.col("part") == 0)
    return export.render_okf_index(export.index_entries(first.select("path", "content")))
