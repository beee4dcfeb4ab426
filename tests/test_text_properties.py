"""Text expressions against Python's own, over many characters and random texts."""

import json
import random
import re
import sys
import unicodedata

from pyspark.sql import functions as F

from shelfmark.functions.text import md_escape, quoted, sanitize, unquoted


def texts(n=400, seed=7):
    """Random texts of letters of many scripts, marks, punctuation and control characters."""
    rng = random.Random(seed)
    alphabet = "aZ9_.- \t\n\r|\\\"'`#:/*{}[]é\u00a0\u0085\u2028\u3042\u0663\u00bd\U0001f600\u0301Ωж\x01\x7f"
    return ["".join(rng.choices(alphabet, k=rng.randrange(30))) for _ in range(n)]


def test_sanitize_every_character(spark):
    """All characters that have been assigned for long: newer ones depend on the Unicode version."""
    old = unicodedata.ucd_3_2_0
    chars = [
        chr(c) for c in range(sys.maxunicode + 1)
        if not 0xD800 <= c <= 0xDFFF and old.category(chr(c)) not in ("Cn", "Co")
    ]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    wrong = [r.c for r in df.select("c", sanitize("c").alias("s")).collect()
             if r.s != re.sub(r"[^\w.\-]", "_", r.c)]
    assert wrong == []


def test_random_texts(spark):
    df = spark.createDataFrame([(t,) for t in texts()], "t string")
    got = df.select(
        "t", sanitize("t").alias("safe"), md_escape("t").alias("cell"), quoted("t").alias("q"),
        unquoted(quoted("t")).alias("back"),
    ).collect()
    for r in got:
        assert r.safe == re.sub(r"[^\w.\-]", "_", r.t)
        assert r.cell == r.t.replace("|", "\\|").replace("\n", " ")
        assert json.loads(r.q) == r.t == r.back
        assert "\n" not in r.q
    assert df.where(F.col("t") == "").count() < 40
