"""The registered queries of the operators for training data, beside the SQL that gives the same rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import (
    chat, classifier, collocations, decontaminate, licences, lines, minmax, mixing, quality, shards, surrogates, tokens,
    whitening,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query with its SQL, if there is one."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers import this package; in local mode they may have been started elsewhere.
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_chat_format")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that speaks in control strings, formatted and read back."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)], conversations.schema
    )
    formatted = chat.format_conversations(conversations.union(extra))

    def digest(row: dict) -> dict:
        text, spans = row["formatted"], row["turns"]
        turns = [turn for s in spans for turn in chat.parse(text[s["start"] : s["end"]])]
        trained = [(s["text_start"], s["text_end"]) for s in spans if s["text_start"] is not None]
        loss = "".join(chat.unescape(text[a:b]) for a, b in trained)
        said = "".join(f"{role}\n{words}\n" for role, words in turns)
        return {
            "conv_id": row["conv_id"],
            "n_turns": len(turns),
            "turns_sha256": hashlib.sha256(said.encode()).hexdigest(),
            "loss_chars": len(loss),
            "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(),
            "formatted_chars": len(text),
            "rewritten_at": row["rewritten_at"],
        }

    numbers = ["n_turns", "loss_chars", "formatted_chars", "rewritten_at"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten_at"]
    out = pa.schema([(n, pa.int64() if n in ("conv_id", *numbers) else pa.string()) for n in names])

    def digests(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([digest(r) for r in batch.to_pylist()], out)

    return formatted.select("conv_id", "formatted", "turns", "rewritten_at").mapInArrow(
        digests,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, rewritten_at long",
    )


# The base measures and the verdict of the base rules; the fitted verdict is tested by brute force.
@query("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of every document, and the verdict of the fitted rules."""
    return quality.judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "quality",
    )


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokens.token_counts(table(spark, sf_dir, "documents"), path, limit=512)


@query("op4_nearest_neighbour_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, from labels that are not held out."""
    documents, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    return classifier.scores(documents, classifier.learn(documents, labels))


@query("op5_shards")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot."""
    placed = shards.shards(table(spark, sf_dir, "documents"), n_shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


@query(
    "op6_line_winnowing",
    r"""
    WITH numbered AS (
      SELECT doc_id, pos - 1 AS pos,
             regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line,
             len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
      FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
    summed AS (
      SELECT *, row_number() OVER w AS k, (sum(n) OVER w)::BIGINT AS after, (sum(n) OVER w - n)::BIGINT AS before
      FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    windows AS (
      SELECT doc_id, min(k) OVER f AS a, max(k) OVER f AS b, min(pos) OVER f AS p, max(pos) OVER f AS q,
             sum(n) OVER f AS words, list(line) OVER f AS content
      FROM summed WINDOW f AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
      UNION ALL
      SELECT doc_id, min(k) OVER f, max(k) OVER f, min(pos) OVER f, max(pos) OVER f, sum(n) OVER f, list(line) OVER f
      FROM summed WINDOW f AS (PARTITION BY doc_id ORDER BY after RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
    whole AS (SELECT DISTINCT doc_id, a, b, p, q, content FROM windows WHERE words >= 50),
    later AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, a) AS nth FROM whole)
      WHERE nth > 1),
    hit AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS k FROM later),
    runs AS (  -- consecutive lines with words; what lies between them goes too
      SELECT doc_id, min(pos) AS p, max(pos) AS q, count(*) AS n FROM (
        SELECT doc_id, pos, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run
        FROM hit JOIN summed USING (doc_id, k))
      GROUP BY doc_id, run),
    gone AS (SELECT doc_id, unnest(range(p, q + 1)) AS pos FROM runs),
    gone_lines AS (SELECT doc_id, sum(n) AS n_removed, count(*) AS n_runs FROM runs GROUP BY doc_id),
    kept AS (
      SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY pos)) AS text_md5
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
      ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(s.n_lines, 0)::BIGINT AS n_lines, coalesce(g.n_removed, 0)::BIGINT AS n_removed,
           coalesce(g.n_runs, 0)::BIGINT AS n_runs,
           CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text_md5, md5('')) END AS text_md5
    FROM documents d
    LEFT JOIN (SELECT doc_id, count(*) AS n_lines FROM numbered GROUP BY doc_id) s USING (doc_id)
    LEFT JOIN gone_lines g USING (doc_id) LEFT JOIN kept k USING (doc_id)
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines and the digest of its text without repeated runs."""
    cleaned = lines.without_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", "n_runs", F.md5("text").alias("text_md5"))


@query("op7_min_max_near_duplicates")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near copies."""
    return minmax.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op8_decontamination",
    """
    WITH split AS (
      SELECT doc_id, regexp_extract_all(
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM documents),
    items AS (
      SELECT item_id, regexp_extract_all(
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark),
    windows AS (
      SELECT DISTINCT item_id, least(len(w), 10) AS n,
             array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS phrase
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
            FROM items WHERE len(w) > 0)),
    lengths AS (SELECT DISTINCT n FROM windows),
    runs AS (
      SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
            FROM split, lengths WHERE len(w) >= n)),
    hits AS (SELECT doc_id, i, n, item_id FROM runs JOIN windows USING (n, phrase)),
    words AS (
      SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
    found AS (
      SELECT doc_id, count(DISTINCT item_id) AS n_items,
             sha256(array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',')) AS s
      FROM hits GROUP BY doc_id)
    SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
           coalesce(n_items, 0)::BIGINT AS n_items, coalesce(s, sha256('')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM split LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document is in the benchmark."""
    documents, benchmark = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontaminate.contamination(decontaminate.build_index(documents, benchmark)).drop("variant")


# DuckDB's md5 keys give the same order, blocks and draws, so every taken word can be recounted.
@query(
    "op9_mixture",
    f"""
    WITH docs AS (
      SELECT doc_id, source, md5('9|' || coalesce(doc_id::VARCHAR, '')) AS k,
             coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size
      FROM documents),
    stream AS (
      SELECT doc_id, source, size,
             sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size
                             ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start
      FROM docs),
    sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
    listed AS (
      SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS w,
             (SELECT sum(source_size) FROM sizes) AS total
      FROM sizes),
    level AS (  -- the level at which limits and shares add up, tried with each source as the first one below
      SELECT a.source, (any_value(a.total) - coalesce(sum(b.source_size * 3) FILTER (
               b.source_size * 3 / b.w < a.source_size * 3 / a.w), 0))
             / sum(b.w) FILTER (b.source_size * 3 / b.w >= a.source_size * 3 / a.w) AS lvl,
             any_value(a.source_size * 3 / a.w) AS ratio
      FROM listed a, listed b GROUP BY a.source),
    targets AS (
      SELECT source, source_size, coalesce(least(source_size * 3.0, w * (
               SELECT min_by(lvl, ratio) FROM level WHERE ratio >= lvl)), 0)::DOUBLE AS target,
             (source_size + {mixing.BLOCK - 1}) // {mixing.BLOCK} AS blocks
      FROM listed),
    draws AS (
      SELECT *, CASE WHEN source_size = 0 THEN 0
                ELSE round(target * blocks / source_size)::BIGINT END AS n
      FROM targets),
    places AS (
      SELECT source, blocks, n, j // blocks AS turn, j % blocks AS block FROM
      (SELECT source, blocks, n, unnest(range(((n + blocks - 1) // blocks) * blocks)) AS j FROM draws WHERE n > 0)),
    slots AS (
      SELECT *, row_number() OVER (PARTITION BY source, turn ORDER BY
                  md5('9|' || coalesce(source, '') || '|' || turn || '|' || block), block) - 1 AS place
      FROM places),
    uses AS (
      SELECT source, block, count(*) AS uses FROM slots WHERE turn * blocks + place < n GROUP BY source, block),
    pieces AS (
      SELECT doc_id, source, size, start,
             unnest(range(start // {mixing.BLOCK}, (start + size - 1) // {mixing.BLOCK} + 1)) AS block
      FROM stream WHERE size > 0),
    got AS (
      SELECT p.source, p.start, sum(uses * (
               least(p.start + p.size, (p.block + 1) * {mixing.BLOCK})
               - greatest(p.start, p.block * {mixing.BLOCK}))) AS taken
      FROM pieces p JOIN uses u ON p.source IS NOT DISTINCT FROM u.source AND p.block = u.block
      GROUP BY p.source, p.start)
    SELECT s.doc_id, s.size::BIGINT AS size, t.source_size, round(t.target, 3) AS target,
           (CASE WHEN s.size = 0 THEN 0 ELSE coalesce(g.taken, 0) END)::BIGINT AS taken, s.source
    FROM stream s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
    LEFT JOIN got g ON s.source IS NOT DISTINCT FROM g.source AND s.start = g.start
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    got = mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))
    return got.select(
        "doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken", "source"
    )


@query("op10_surrogates")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for the personal data in it."""
    return surrogates.with_surrogates(table(spark, sf_dir, "documents"))


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector's first eight whitened components."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


@query("op12_licences")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licences: the places of the base phrases, and labels of all that is found."""
    found = licences.licences(table(spark, sf_dir, "documents"))
    listed = lambda names: F.array_join(F.array_sort(F.array_distinct(names)), ",")
    base, more = (F.transform(c, lambda x: x["label"]) for c in ("phrases", "spans"))
    starts = F.transform("phrases", lambda p: p["first"])
    covered = F.coalesce(F.array_max(F.transform("spans", lambda s: s["covered"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.concat(base, more)).alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(covered).alias("score"),
        F.size("spans").cast("long").alias("n_spans"),
    )


@query(
    "op13_collocations",
    r"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents),
    split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
    windows AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM places),
    totals AS (SELECT lang, count(*) AS n FROM windows GROUP BY lang),
    f1 AS (SELECT lang, w1, count(*) AS f FROM windows GROUP BY ALL),
    f2 AS (SELECT lang, w1, w2, count(*) AS f FROM windows WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
    f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM windows WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
    cuts AS (
      SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, 1 AS k, x.f AS l, y.f AS r
      FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
      UNION ALL
      SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, 1, x.f, y.f
      FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1
        JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
      UNION ALL
      SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, 2, x.f, y.f
      FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2
        JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3),
    scored AS (
      SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth
      FROM (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts)),
    longer AS (
      SELECT lang, phrase, max(f) AS most FROM (
        SELECT lang, w1 || ' ' || w2 AS phrase, f FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3)
      GROUP BY ALL),
    ranked AS (
      SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
      FROM scored s LEFT JOIN longer USING (lang, phrase)
      WHERE nth = 1 AND NOT coalesce(100 * most >= 50 * a, false))
    SELECT r.lang, rank, phrase, a, l, r, n, score::BIGINT AS score
    FROM ranked r JOIN totals USING (lang) WHERE rank <= 2000
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language's best collocations."""
    return collocations.collocations(table(spark, sf_dir, "documents"))
