"""A1, A2. Extracts from files with a declared schema."""

import pytest

from helpers import extract, rows
from shelfmark.operators import describe
from shelfmark.shared import new_folder, shared_dir
from shelfmark.sources.extracts import EXTRACTS, read_extract, read_json_extract


@pytest.mark.parametrize("format", ["parquet", "csv", "json", "orc"])
def test_extract_formats(spark, format):
    path = new_folder(spark, "x")
    df = extract(spark, "columns_mysql", ("s", "t", 1, "id", "int", "NO", None), ("s", "t", 2, "n", "text", "YES", "x"))
    df.write.option("header", True).format(format).save(path)
    assert rows(read_extract(spark, path, "columns_mysql", format)) == rows(df)


def test_nested_documents(spark):
    path = new_folder(spark, "x")
    text = '{"config":"c","instance":"i","schema":"s","Name":"t","StorageDescriptor":{"Columns":[{"Name":"a","Type":"int"}],"Extra":1}}'
    spark.createDataFrame([(text,)], "value string").write.text(path)
    assert rows(describe.columns_glue(read_json_extract(spark, path, "glue")), "column_name", "comment") == [("a", None)]


def test_every_extract_kind_parses(spark):
    for kind in EXTRACTS:
        assert extract(spark, kind).columns[:2] == ["config", "instance"]


def test_shared_folder_comes_from_the_session(spark):
    class Conf:
        def __init__(self, **settings):
            self.settings = settings

        def get(self, key, *default):
            return self.settings.get(key.replace(".", "_"), *default)

    class Session:
        def __init__(self, **settings):
            self.conf = Conf(**settings)

    given = Session(spark_checkpoint_dir="hdfs://shared/x", spark_sql_warehouse_dir="hdfs://w")
    assert shared_dir(given) == "hdfs://shared/x"
    assert shared_dir(Session(spark_sql_warehouse_dir="hdfs://w")) == "hdfs://w/shelfmark-run"
    assert new_folder(spark, "a").startswith(f"{shared_dir(spark)}/a-")
