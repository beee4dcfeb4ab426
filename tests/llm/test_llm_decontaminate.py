from __future__ import annotations

import hashlib
import random
import re

from shelfmark.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items):
    w, hit, found = split(text), set(), set()
    for item_id, item in items:
        x = split(item)
        n = min(len(x), 10)
        for k in range(len(x) - n + 1 if n else 0):
            for at in range(len(w) - n + 1):
                if w[at : at + n] == x[k : k + n]:
                    hit.update(range(at, at + n))
                    found.add(item_id)
    ids = ",".join(sorted(map(str, found)))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def test_phrases(spark, make_docs):
    rnd = random.Random(2)
    word = lambda: rnd.choice(["the", "of", "a"] * 6 + [f"w{k}" for k in range(40)])
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 3, 9, 10, 11, 25, 40])))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "the the the the the the the the the the the the"), (93, "Ünïcode-WORDS 漢字"),
              (94, items[7][1]), (95, items[8][1]), (95, items[8][1]), (None, "null item words")]
    rows = []
    for i in range(120):
        w = [word() for _ in range(rnd.randrange(0, 60))]
        for _ in range(rnd.randrange(0, 3)):
            x = split(rnd.choice(items)[1])
            lo = rnd.randrange(0, max(1, len(x) - 9))
            at = rnd.randrange(0, len(w) + 1)
            w[at:at] = [y.upper() if rnd.random() < 0.2 else y for y in x[lo : rnd.choice([lo + 9, lo + 10, len(x)])]]
        rows.append((i, rnd.choice([" ", ", ", "\n"]).join(w), None))
    rows += [(200, None, None), (201, "", None), (202, "the " * 40, None), (203, "ünïcode words 漢字. WORDS 漢字", None),
             (None, "null item words", None), (3, rows[3][1], None), (4, "the of " + (items[6][1] or ""), None),
             (204, "filler " * 30_000 + items[5][1] + " filler" * 30_000, None)]
    rows = [r for r in rows if r[0] != 92]
    benchmark = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc_id string, pos int")
    got = decontaminate.contamination(decontaminate.build_index(make_docs(rows), benchmark)).collect()
    known = [(i, t) for i, t in items if i is not None]
    by_row = sorted(((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in got), key=str)
    with_null = [(i, *[brute(t, items)[k] for k in (0, 1, 4)]) for i, t, _ in rows]
    assert by_row == sorted(with_null, key=str)
    texts = {(i, brute(t, known)[0]): t for i, t, _ in rows}
    for r in got:
        want = brute(texts[r.doc_id, r.n_words], known)
        if r.doc_id is not None:
            assert (r.n_items, r.items_sha256) == want[2:4], r


def test_empty_sides(spark, make_docs):
    benchmark = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.contamination(decontaminate.build_index(make_docs([]), benchmark)).count() == 0
    index = decontaminate.build_index(make_docs([(1, "a b c", None)]), benchmark.limit(0))
    (row,) = decontaminate.contamination(index).collect()
    assert (row.n_words, row.n_hit, row.contaminated) == (3, 0, False)
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest()


def test_proximity(spark, make_docs):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    broken = item.replace("gamma", "gamma extra words")
    rows = [(1, item, None), (2, broken, None), (3, "kappa " + "x " * 50 + "alpha", None), (4, "x y z", None)]
    rows += [(9, "beta gamma delta epsilon zeta eta theta iota kappa", None)]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    index = decontaminate.build_index(make_docs(rows), benchmark)
    exact = {r.doc_id for r in decontaminate.phrases(index).collect()}
    assert exact == {1}
    (window,) = decontaminate._windows(index).collect()
    terms = {r.term: r.word for r in index.terms.collect()}
    rare = [(terms[window.term1], window.off1), (terms[window.term2], window.off2)]

    def apart(text):
        w = split(text)
        at = [[p - off for p, x in enumerate(w) if x == t] for t, off in rare]
        return [abs(a - b) for a in at[0] for b in at[1]]

    for slop in (0, 2, 5):
        got = {r.doc_id for r in decontaminate.proximity(index, slop).collect()}
        assert got == {i for i, t, _ in rows if any(d <= slop for d in apart(t))}


def test_repeated_rows(spark, make_docs):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, f"so {item} end", None)] * 2 + [(2, f"{item} lambda", None)] * 3 + [(3, "short one", None)] * 2
    rows += [(1, "another text", None), (4, item, None)] + [(None, f"x {item}", None)] * 2
    benchmark = spark.createDataFrame([(1, item), (2, "short one")], "item_id long, text string")
    index = decontaminate.build_index(make_docs(rows), benchmark)
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(index).collect()]
    want = [(1, 12, 10, 1, True)] * 2 + [(2, 11, 10, 1, True)] * 3 + [(3, 2, 2, 1, True)] * 2
    want += [(1, 2, 0, 0, False), (4, 10, 10, 1, True)] + [(None, 11, 10, 1, True)] * 2
    assert sorted(got, key=str) == sorted(want, key=str)
