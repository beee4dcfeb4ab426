"""A1, A2. Landed catalogue extracts, read with a declared schema (nothing is inferred)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Columns of the extracts after ``config STRING, instance STRING``, by kind.
EXTRACTS = {
    "columns_mysql": "`schema` STRING, `table` STRING, ord INT, Field STRING, Type STRING,"
    " `Null` STRING, `Default` STRING",
    "columns_postgres": "table_schema STRING, table_name STRING, column_name STRING,"
    " ordinal_position INT, data_type STRING, is_nullable STRING, column_default STRING",
    "stat_tables": "schemaname STRING, relname STRING, relid BIGINT",
    "descriptions": "objoid BIGINT, objsubid INT, description STRING",
    "columns_sqlite": "`schema` STRING, `table` STRING, cid INT, name STRING, type STRING,"
    " notnull INT, dflt_value STRING, pk INT",
    "columns_duckdb": "`schema` STRING, `table` STRING, cid INT, name STRING, type STRING,"
    " notnull BOOLEAN, dflt_value STRING",
    "columns_trino": "table_schema STRING, table_name STRING, column_name STRING,"
    " ordinal_position INT, data_type STRING, is_nullable STRING, column_default STRING,"
    " comment STRING, extra_info STRING",
    "constraints": "constraint_schema STRING, table_name STRING, constraint_name STRING,"
    " constraint_type STRING",
    "constraints_duckdb": "schema_name STRING, table_name STRING, constraint_type STRING,"
    " constraint_column_names ARRAY<STRING>",
    "key_usage": "table_schema STRING, table_name STRING, constraint_name STRING,"
    " column_name STRING, ordinal_position INT, referenced_table STRING, referenced_column STRING",
    "referenced": "constraint_schema STRING, constraint_name STRING, table_schema STRING,"
    " table_name STRING, column_name STRING, ordinal_position INT",
    "foreign_keys_sqlite": "`schema` STRING, `table` STRING, id INT, seq INT, referenced STRING,"
    " `from` STRING, `to` STRING",
    "index_columns": "`schema` STRING, `table` STRING, index_name STRING, column_name STRING,"
    " seq INT, non_unique BOOLEAN, is_primary BOOLEAN, index_type STRING",
    "index_ddl": "`schema` STRING, `table` STRING, index_name STRING, is_unique BOOLEAN,"
    " is_primary BOOLEAN, sql STRING",
    "index_keys_postgres": "`schema` STRING, `table` STRING, relid BIGINT, index_name STRING,"
    " is_unique BOOLEAN, is_primary BOOLEAN, index_type STRING, indkey ARRAY<INT>",
    "partitioned_postgres": "`schema` STRING, `table` STRING, relid BIGINT, partattrs ARRAY<INT>",
    "attributes_postgres": "relid BIGINT, attnum INT, column_name STRING, data_type STRING,"
    " comment STRING",
    # Nested documents.
    "glue": "`schema` STRING, Name STRING,"
    " StorageDescriptor STRUCT<Columns: ARRAY<STRUCT<Name: STRING, Type: STRING, Comment: STRING>>>,"
    " PartitionKeys ARRAY<STRUCT<Name: STRING, Type: STRING, Comment: STRING>>",
    "dynamo": "`schema` STRING, TableName STRING,"
    " AttributeDefinitions ARRAY<STRUCT<AttributeName: STRING, AttributeType: STRING>>,"
    " KeySchema ARRAY<STRUCT<AttributeName: STRING, KeyType: STRING>>,"
    " GlobalSecondaryIndexes ARRAY<STRUCT<IndexName: STRING,"
    " KeySchema: ARRAY<STRUCT<AttributeName: STRING, KeyType: STRING>>>>,"
    " LocalSecondaryIndexes ARRAY<STRUCT<IndexName: STRING,"
    " KeySchema: ARRAY<STRUCT<AttributeName: STRING, KeyType: STRING>>>>",
    "mongo": "db STRING, name STRING, json_schema STRING, indexes STRING, shard_key STRING",
}


def extract_schema(kind: str) -> str:
    """Schema of an extract kind as DDL text."""
    return f"config STRING, instance STRING, {EXTRACTS[kind]}"


def read_extract(
    spark: SparkSession, path: str, kind: str, format: str = "parquet", schema: str | None = None
) -> DataFrame:
    """A1. An extract of many instances from Parquet, CSV, JSON or ORC files."""
    reader = spark.read.schema(schema or extract_schema(kind))
    if format == "csv":
        reader = reader.option("header", True)
    return reader.format(format).load(path)


def read_json_extract(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A2. Nested catalogue documents, one JSON object per line."""
    return spark.read.schema(extract_schema(kind)).json(path)


def read_live(
    spark: SparkSession, url: str, query: str, config: str, instance: str, **options: str
) -> DataFrame:
    """A1, live. One catalogue query over JDBC, if the database's driver is on the class path."""
    from pyspark.sql import functions as F

    rows = spark.read.format("jdbc").options(url=url, query=query, **options).load()
    return rows.select(F.lit(config).alias("config"), F.lit(instance).alias("instance"), "*")
