"""One key with a third of all rows: lists come in parts, nothing is lost, order is kept."""

from pyspark.sql import functions as F

from helpers import store
from shelfmark import model as m
from shelfmark.operators import describe, export, jobs, lists, ranks
from shelfmark.operators.store import Store


def hot_facts(spark, tables=40, hot=900):
    """Every table has 50 columns, one has ``hot`` more, and one index over all of them."""
    few = spark.range(tables * 50).select(
        F.concat(F.lit("t"), F.col("id") % tables).alias("table"), F.floor(F.col("id") / tables).alias("p")
    )
    many = spark.range(50, 50 + hot).select(F.lit("t7").alias("table"), F.col("id").alias("p"))
    placed = few.union(many).select(
        F.lit("c").alias("config"), F.lit("i").alias("instance"), F.lit("s").alias("schema"),
        "table", "p",
    )
    name = F.concat(F.lit("c"), F.format_string("%05d", "p"))
    columns = m.facts(
        placed, m.COLUMN, position=F.col("p"), column_name=name, data_type=F.lit("int")
    )
    index = m.facts(
        placed, m.INDEX, item=F.lit("ix"), position=F.col("p"), column_name=name,
        is_unique=F.lit(True), is_primary=F.lit(False),
    )
    return columns.unionByName(index)


def test_nest_cuts_long_tables_in_order(spark):
    facts = hot_facts(spark)
    got = describe.nest(facts, per_part=300).collect()
    per_table = {}
    for row in sorted(got, key=lambda r: (r.table, r.part)):
        per_table.setdefault(row.table, []).append(row)
    assert {t for t, parts in per_table.items() if len(parts) > 1} == {"t7"}
    assert len(per_table) == 40 and len(per_table["t7"]) >= 2
    names = [c.name for r in per_table["t7"] for c in r.columns]
    assert names == [f"c{p:05d}" for p in range(950)]
    index = [c for r in per_table["t7"] for i in r.indexes for c in i.column_names]
    assert index == names
    assert [c.name for c in per_table["t3"][0].columns] == names[:50]


def test_documents_in_parts_equal_whole_documents(spark):
    facts = hot_facts(spark)
    headers = facts.select(*m.K4).distinct()
    own = Store(m.tables(headers, updated_at=F.lit("2024-01-01").cast("timestamp")), facts)
    for render in (export.render_markdown, export.render_okf):
        whole = {r.path: r.content for r in render(own).collect()}
        parts = {}
        for r in sorted(render(own, per_part=300).collect(), key=lambda r: (r.path, r.part)):
            parts.setdefault(r.path, []).append(r.content)
        assert len(parts["c/i/s/t7.md"]) > 1
        assert {p: "".join(c) for p, c in parts.items()} == whole


def test_index_is_ordered_lines(spark):
    entries = spark.range(500).select(
        F.format_string("c/i/s/t%04d.md", "id").alias("path"),
        F.concat(F.lit("* "), F.col("id")).alias("line"),
    )
    lines = sorted(export.render_okf_index(entries.repartition(7)).collect(), key=lambda r: r.part)
    assert [r.part for r in lines] == list(range(501)) and {r.path for r in lines} == {"index.md"}
    assert [r.content for r in lines[1:]] == [f"* {i}\n" for i in range(500)]


def test_coarse_scopes_are_dealt_over_keys(spark):
    """One scope over everything: no join key holds most of the catalogue."""
    from shelfmark.operators import scope

    catalog = spark.range(4000).select(
        F.lit("c").alias("config"), F.lit("i").alias("instance"), F.lit("s").alias("schema"),
        F.concat(F.lit("t"), "id").alias("table"),
    )
    scopes = spark.createDataFrame(
        [("all", None, None, None, None), ("one", "c", "i", "s", "t7"), ("schema", "c", "i", "s", None)],
        "scope_id string, config string, instance string, schema string, table string",
    )
    expanded = scope.expand_scope(catalog, scopes)
    got = {r["scope_id"]: r["count"] for r in expanded.groupBy("scope_id").count().collect()}
    assert got == {"all": 4000, "schema": 4000, "one": 1}
    assert "s_salt" in expanded._jdf.queryExecution().executedPlan().toString()
    assert scope.expand_scope(catalog, scopes.limit(0)).count() == 0


def test_job_with_very_many_errors(spark):
    errors = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("j"), F.col("id") % 50)).alias("job_id"),
        F.col("id").alias("seq"), F.concat(F.lit("e"), F.col("id")).alias("error"),
    )
    all_jobs = errors.select("job_id").distinct()
    folded = jobs.fold_status(all_jobs, all_jobs.limit(0), errors, ["seq"], per_part=100)
    hot = sorted(folded.where("job_id = 'hot'").collect(), key=lambda r: r.part)
    assert len(hot) > 1 and {r.status for r in hot} == {"failed"}
    assert "; ".join(r.error for r in hot) == "; ".join(f"e{i}" for i in range(0, 1000, 3))


def test_results_of_a_hot_job(spark):
    results = spark.range(900).select(
        F.lit("hot").alias("job_id"), F.col("id").alias("seq"),
        F.col("id").cast("string").alias("document"),
    )
    all_jobs = spark.createDataFrame([("hot",), ("idle",)], "job_id string")
    got = jobs.job_with_results(all_jobs, results, ["seq"], per_part=100).collect()
    parts = [r.results for r in sorted(got, key=lambda r: (r.job_id, r.part)) if r.job_id == "hot"]
    assert len(parts) > 1 and sum(parts, []) == [str(i) for i in range(900)]
    assert [r.results for r in got if r.job_id == "idle"] == [[]]


def test_parts_are_a_function_of_the_data(spark):
    """The same parts as SQL gives, for keys above and below the number of items, however partitioned."""
    import duckdb

    rows = [("hot" if i % 3 else f"k{i % 11}" if i % 2 else None, i * 7919 % 2003) for i in range(2000)]
    db = duckdb.connect()
    db.execute("CREATE TABLE t (k VARCHAR, v BIGINT)")
    db.executemany("INSERT INTO t VALUES (?, ?)", rows)
    want = db.execute(
        "SELECT k, part, list(v ORDER BY v) FROM (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY v) - 1)"
        " // 100 AS part FROM t) GROUP BY k, part"
    ).fetchall()
    for n in (1, 5, 13):
        df = spark.createDataFrame(rows, "k string, v long").repartition(n)
        got = lists.ordered_lists(df, ["k"], ["v"], F.col("v"), "items", per_part=100).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert max(p for k, p, _ in want if k == "hot") > 5


def test_ranks_and_sums(spark):
    rows = [(i % 3 or None, i * 31 % 97, i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v int, w int").repartition(6)
    got = ranks.ranked(df, ["k"], ["v", "w"], weight="w").collect()
    for k in {r.k for r in got}:
        own = sorted((r for r in got if r.k == k), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, len(own) + 1)) and {r.rank_rows for r in own} == {len(own)}
        assert [(r.v, r.w) for r in own] == sorted((r.v, r.w) for r in own)
        assert [r.before for r in own] == [sum(x.w for x in own[:i]) for i in range(len(own))]
        assert {r.rank_weight for r in own} == {sum(r.w for r in own)}
    assert ranks.ranked(df.limit(0), [], ["v"]).count() == 0


def test_copies_of_an_index_column(spark):
    """Copies of one fact are listed as often as they occur."""
    fact = {"item": "ix", "position": 1, "column_name": "a", "is_unique": False}
    own = store(spark, [("t", {})], [("t", "index", fact)] * 3 + [("t", "index", {**fact, "position": 2})])
    text = export.render_markdown(own).first().content
    assert "- `ix`: `a`, `a`, `a`, `a`\n" in text
