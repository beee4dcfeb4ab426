"""A3, A4, A5. The store on shared storage, and documents as files.

A store is a folder with ``tables`` and ``facts``, each partitioned by version, config, instance and
schema, and the commits that say which version of each schema is the current one, see ``commits``.  A
writer adds folders of a name of its own and then commits them; files that belong to a commit are never
changed.  A writer that is lost leaves folders that no commit names, never a half-written store, and
what was read before stays readable until ``commits.vacuum`` removes what is old.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import model as m
from shelfmark.operators.store import Merged, Snapshot, Store
from shelfmark.shared import written
from shelfmark.sources.commits import (
    LEVELS, Conflict, commit, commit_schemas, manifest, new_name, sizes, version,
)
from shelfmark.sources.exports import bundle_index, read_exports, write_exports  # noqa: F401

_ORDER = {"tables": m.K4, "facts": [*m.K4, *m.FACT_ORDER]}
_COLUMNS = {"tables": m.TABLE_COLUMNS, "facts": m.FACT_COLUMNS}
_FIELDS = {"tables": m.TABLE_FIELDS, "facts": {"section": "string", **m.FACT_FIELDS}}
RETRIES = 20  # merges of one scan that may meet a conflict


def _write(df: DataFrame, path: str, part: str, name: str) -> None:
    # A range shuffle in the order of the hierarchy keeps the number of files per folder small, and
    # cuts a schema or table that holds most of the rows over many tasks.
    rows = df.select(*_COLUMNS[part]).repartitionByRange(*_ORDER[part])
    rows.write.partitionBy(*LEVELS).parquet(f"{path}/{part}/version={name}")


def write_store(store: Store, path: str, base: int | None = None) -> int:
    """A4. Write a store whole and commit it; the number of the commit.

    With ``base``, the number the store was made from, a commit in between raises ``Conflict``.  A
    store as it was read knows its number.
    """
    spark = store.tables.sparkSession
    base = getattr(store, "number", None) if base is None else base
    base = version(spark, path) if base is None else base
    name = new_name()
    # A range shuffle asks for its rows twice, and the schemas are asked for as well.
    store = Store(*[written(getattr(store, part).select(*_COLUMNS[part]), part) for part in ("tables", "facts")])
    for part, rows in (("tables", store.tables), ("facts", store.facts)):
        _write(rows, path, part, name)
    schemas = store.tables.select(*LEVELS).distinct()
    schemas.withColumn("version", F.lit(name)).write.parquet(f"{path}/manifests/{name}")
    return commit(spark, path, base, name)


def _put(merged: Merged, path: str, base: int) -> int:
    spark = merged.tables.sparkSession
    name = new_name()
    is_written = F.col("action").isin("insert", "update")
    schemas = written(merged.tables.where(is_written).select(*LEVELS).distinct(), "schemas")
    for part, rows in (("tables", merged.tables), ("facts", merged.facts)):
        _write(rows.join(schemas, LEVELS, "left_semi"), path, part, name)
    return commit_schemas(spark, path, base, name, schemas)


def commit_merge(merged: Merged, path: str, retries: int = RETRIES) -> tuple[Merged, int]:
    """A4. Commit a merge; the merge that was committed and the number of the commit.

    Only the schemas that it changed are written; the new manifest names the others again, also those
    that were committed since the merge's store was read.  If some of these are its own, the scan is
    merged again, with the newer store, and nothing that either writer has saved is lost.
    """
    if merged.number is None:
        raise ValueError("the store that was merged has no number; read it, or give a base to update_store")
    spark = merged.tables.sparkSession
    while True:
        try:
            return merged, _put(merged, path, merged.number)
        except Conflict:
            if retries == 0:
                raise
            retries -= 1
            schemas = merged.scanned.tables.select(*LEVELS).distinct()
            merged = merged.again(read_store(spark, path).within(schemas))


def update_store(merged: Merged, path: str, base: int | None = None) -> int:
    """A4. Commit a merge by writing only the schemas it changed; the number of the commit.

    ``merged`` holds all tables of the schemas it changed, and stays readable.  Without ``base`` it is
    based on the number that was read, and merged again where that is needed, see ``commit_merge``;
    with a ``base`` a later commit of the same schemas raises ``Conflict``.
    """
    return commit_merge(merged, path)[1] if base is None else _put(merged, path, base)


def compact_store(spark: SparkSession, path: str, target: int = 128 << 20) -> int:
    """A4. Rewrite the schemas whose versions have fewer than ``target`` bytes as one version.

    Every merge leaves a version of its own, so a store after many small ones is many small files in
    many folders.  Their current rows go to one version, in files of range order; larger versions stay.  A
    scan that is committed meanwhile wins: compaction starts again from there.  The number of the
    commit, or of the latest one where there was nothing to do.
    """
    while True:
        stored = read_store(spark, path)
        current = manifest(spark, path, stored.number)
        held = sizes(spark, path, [r["version"] for r in current.select("version").distinct().collect()])
        small = [v for v, n in held.items() if n < target]
        if len(small) < 2:
            return stored.number
        schemas = written(current.where(F.col("version").isin(small)).select(*LEVELS), "schemas")
        name, own = new_name(), stored.within(schemas)
        for part, rows in (("tables", own.tables), ("facts", own.facts)):
            _write(rows, path, part, name)
        try:
            return commit_schemas(spark, path, stored.number, name, schemas)
        except Conflict:
            continue


def read_store(
    spark: SparkSession,
    path: str,
    config: str | None = None,
    instance: str | None = None,
    schema: str | None = None,
    number: int | None = None,
) -> Snapshot:
    """A3. The latest commit (or that of ``number``), or its part within the given names, for which
    folders are pruned.  A store that nothing is committed to is empty."""
    number = version(spark, path) if number is None else number
    current = manifest(spark, path, number)
    for level, name in zip(LEVELS, (config, instance, schema)):
        if name is not None:
            current = current.where(F.col(level) == name)
    # As many versions as commits are still current for some schema, which compact_store bounds; their
    # folders only are listed.
    versions = [r["version"] for r in current.select("version").distinct().collect()]

    def read(part: str) -> DataFrame:
        fields = ", ".join(f"{n} {t}" for n, t in _FIELDS[part].items())
        levels = ", ".join(f"`{k}` STRING" for k in ["version", *LEVELS])
        kind = f"`table` STRING, {fields}, {levels}"
        if not versions:
            return spark.createDataFrame([], kind).select(*_COLUMNS[part])
        folders = [f"{path}/{part}/version={v}" for v in versions]
        rows = spark.read.schema(kind).option("basePath", f"{path}/{part}").parquet(*folders)
        for level, name in zip(LEVELS, (config, instance, schema)):
            if name is not None:
                rows = rows.where(F.col(level) == name)
        return rows.join(current, [*LEVELS, "version"], "left_semi").select(*_COLUMNS[part])

    return Snapshot(read("tables"), read("facts"), number)


def publish_files(documents: DataFrame, root: str) -> None:
    """A5. One file per document below its format's folder in ``root``, which executors mount.

    Parts of a document reach one task in order and are streamed to a temporary file beside the
    target, which then replaces it, so a reader sees the old or the new file and a task that runs
    twice does no harm.
    """

    def write(rows) -> None:
        def finish(handle, target: str) -> None:
            handle.close()
            os.chmod(handle.name, 0o644)
            os.replace(handle.name, target)

        handle, target = None, None
        for row in rows:
            path = f"{root}/{m.FORMAT_FOLDERS[row.format]}/{row.path}"
            if path != target:
                if handle:
                    finish(handle, target)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                handle = tempfile.NamedTemporaryFile(
                    "w", encoding="utf-8", newline="", dir=os.path.dirname(path), delete=False
                )
                target = path
            handle.write(row.content)
        if handle:
            finish(handle, target)

    (
        documents.select("format", "path", "part", "content")
        .repartition("format", "path")
        .sortWithinPartitions("format", "path", "part")
        .foreachPartition(write)
    )
