"""D10-D12. An index of the names in a store, by which a late page costs what the first one does.

The names of every level stand in files of range order, of some ten thousand names each.  A directory
has one row per list (the instances, the schemas of an instance, the tables of a schema) and file: how
many names of the list are in the file and how many stand before it.  A page is then found by a lookup
in the directory and reads the one or two files that hold its names.

Every indexed commit has a directory of its own.  Files are never changed: a new directory names the
files of lists that no commit since has touched again, and new ones for the others, so indexing a scan
costs what the scan changed.  ``commits.vacuum`` removes what no kept commit names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.operators.store import DEFAULT_PAGE, check_page_size
from shelfmark.shared import written
from shelfmark.sources.commits import (
    LEVELS, Conflict, commit, manifest, names, new_name, numbers, touched, version,
)
from shelfmark.sources.store import read_store

FILE_NAMES = 50_000  # names per file, about
PARENTS = {"instance": [], "schema": ["instance"], "table": ["instance", "schema"]}
_LIST = ["level", "instance", "schema"]


def _lists(df: DataFrame) -> DataFrame:
    """``level, instance, schema`` of the lists that the schemas ``df`` are in."""
    levels = [
        df.select(F.lit(level).alias("level"), *[(F.col(c) if c in own else F.lit("")).alias(c) for c in _LIST[1:]])
        for level, own in PARENTS.items()
    ]
    return levels[0].union(levels[1]).union(levels[2]).distinct()


def _names(spark: SparkSession, path: str, number: int, lists: DataFrame) -> DataFrame:
    """``level, instance, schema, name`` of the given lists, each name once."""
    current = manifest(spark, path, number)
    # The lists of tables are those of whole schemas, so only the folders of these are read.
    pairs = lists.where("level = 'table'").select("instance", "schema")
    within = written(current.join(pairs, ["instance", "schema"], "left_semi").select(*LEVELS), "schemas")
    tables = read_store(spark, path, number=number).within(within).tables
    rows = [
        current.select(F.lit("instance").alias("level"), F.lit("").alias("instance"), F.lit("").alias("schema"), F.col("instance").alias("name")),
        current.select(F.lit("schema").alias("level"), "instance", F.lit("").alias("schema"), F.col("schema").alias("name")),
        tables.select(F.lit("table").alias("level"), "instance", "schema", F.col("table").alias("name")),
    ]
    upper = rows[0].union(rows[1]).join(lists, _LIST, "left_semi")
    return upper.union(rows[2]).distinct()


def _directory(spark: SparkSession, path: str, number: int) -> DataFrame:
    name = names(spark, f"{path}/names").where(F.col("number") == number).first()["name"]
    return spark.read.parquet(f"{path}/names/directories/{name}")


def index_names(spark: SparkSession, path: str, number: int | None = None) -> int:
    """Index the names of a commit, by default the latest one; its number.

    Starts from the latest earlier commit that is indexed and still kept.  A commit that is indexed
    already, also by someone else meanwhile, is left as it is.  A run that is lost leaves files that no
    directory names.
    """
    number = version(spark, path) if number is None else number
    done = numbers(spark, f"{path}/names")
    if number == 0 or number in done:
        return number
    kept = numbers(spark, path)
    base = max((n for n in done if n < number and n in kept), default=None)
    schemas = manifest(spark, path, number) if base is None else touched(spark, path, base, number)
    lists = written(_lists(schemas.select(*LEVELS)), "lists")
    build = new_name()
    listed = written(_names(spark, path, number, lists), "names")
    order = [*_LIST, "name"]
    files = max(1, listed.count() // FILE_NAMES)
    listed.repartitionByRange(files, *order).sortWithinPartitions(*order).write.parquet(f"{path}/names/files/{build}")

    pieces = (
        spark.read.schema(listed.schema)
        .parquet(f"{path}/names/files/{build}")
        .groupBy(*_LIST, F.col("_metadata.file_name").alias("file"))
        .agg(F.count("*").alias("rows"), F.min("name").alias("first_name"))
    )
    # One row per list and file, so a list of 10**9 names has some ten thousand.
    of_list = Window.partitionBy(*_LIST)
    directory = pieces.select(
        *_LIST,
        F.lit(build).alias("build"),
        "file",
        "first_name",
        "rows",
        (F.sum("rows").over(of_list.orderBy("first_name")) - F.col("rows")).alias("before"),
        F.sum("rows").over(of_list).alias("total"),
    )
    if base is not None:
        directory = _directory(spark, path, base).join(lists, _LIST, "left_anti").unionByName(directory)
    own = new_name()
    directory.repartitionByRange(*_LIST, "before").sortWithinPartitions(*_LIST, "before").write.parquet(
        f"{path}/names/directories/{own}"
    )
    try:
        return commit(spark, f"{path}/names", number - 1, own)
    except Conflict:
        return number


def page_entries(
    spark: SparkSession, path: str, level: str, number: int, size: int, commit_number: int, **within: str
) -> tuple[int, list]:
    """The total of a list, and the directory's rows of the files that hold a page of it."""
    if list(within) != PARENTS[level]:
        raise ValueError(f"names of level {level} are within {PARENTS[level]}")
    entries = _directory(spark, path, commit_number).where(F.col("level") == level)
    for parent in _LIST[1:]:
        entries = entries.where(F.col(parent) == within.get(parent, ""))
    first = (number - 1) * size
    total = entries.agg(F.max("total")).first()[0] or 0
    # Files hold far more names than a page, so these are one or two, at most as many as the page has names.
    here = entries.where((F.col("before") < first + size) & (F.col("before") + F.col("rows") > first))
    return total, here.orderBy("before").collect()


def names_page(
    spark: SparkSession,
    path: str,
    level: str,
    number: int = 1,
    size: int = DEFAULT_PAGE,
    commit_number: int | None = None,
    **within: str,
) -> DataFrame:
    """D10-D12. A page of a store's names as ``operators.store.page`` gives it, by the index.

    ``level`` is ``instance``, ``schema`` (within ``instance=``) or ``table`` (within ``instance=`` and
    ``schema=``).  A commit that nobody has indexed is indexed first.
    """
    check_page_size(number, size)
    of = index_names(spark, path, commit_number)
    total, entries = page_entries(spark, path, level, number, size, of, **within) if of else (0, [])
    kind = "level STRING, instance STRING, schema STRING, name STRING"
    if entries:
        places = [f"{path}/names/files/{e['build']}/{e['file']}" for e in entries]
        rows = spark.read.schema(kind).parquet(*places).where(F.col("level") == level)
        for parent in _LIST[1:]:
            rows = rows.where(F.col(parent) == within.get(parent, ""))
        rows = rows.orderBy("name").offset((number - 1) * size - entries[0]["before"]).limit(size)
    else:
        rows = spark.createDataFrame([], kind)
    return rows.agg(F.sort_array(F.collect_list("name")).alias("items")).select(
        "items",
        F.lit(total).cast("bigint").alias("total"),
        F.lit(number).alias("page"),
        F.lit(size).alias("page_size"),
        F.lit(-(-total // size)).cast("bigint").alias("pages"),
    )
