from __future__ import annotations

import random
from itertools import combinations

import numpy as np
from tests_llm_words import WORDS

from shelfmark.llm import minmax
from shelfmark.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORDS.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows):
    """Component of every row, over all pairs of rows."""
    sets = [shingles(t) for _, t, _ in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        shared, whole = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if whole and 100 * shared >= 85 * whole:
            label[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        root = find(k)
        ids = [x for x in (least.get(root), i) if x is not None]
        least[root] = min(ids) if ids else None
    return [(i, len(s), least[find(k)] if s else i) for k, ((i, _, _), s) in enumerate(zip(rows, sets, strict=True))]


def near_copies(rnd, n, words=120, vocabulary=4000):
    """Copies of one text with other rates of changed words, so that similarities spread around 0.85."""
    base = [f"w{rnd.randrange(vocabulary)}" for _ in range(words)]
    for _ in range(n):
        rate = rnd.choice([0, 0.005, 0.01, 0.02, 0.04])
        yield " ".join(f"x{rnd.randrange(10**6)}" if rnd.random() < rate else w for w in base)


def check(make_docs, rows):
    got = minmax.near_duplicates(make_docs(rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(brute(rows), key=str)
    assert all(r.kept == (r.component_id is None or r.doc_id == r.component_id) for r in got)


def test_groups_of_near_copies(make_docs):
    rnd = random.Random(3)
    texts = [*near_copies(rnd, 150), *near_copies(rnd, 60, words=30), *near_copies(rnd, 40, words=700)]
    texts += [" ".join(f"u{rnd.randrange(10**6)}" for _ in range(50)) for _ in range(60)]
    texts += [texts[0]] * 30 + [texts[3].upper().replace(" ", "\n")] * 2
    rnd.shuffle(texts)
    check(make_docs, [(i, t, None) for i, t in enumerate(texts)])


def test_blocks_of_large_buckets(make_docs, monkeypatch):
    monkeypatch.setattr(minmax, "BLOCK", 7)
    rnd = random.Random(8)
    texts = list(near_copies(rnd, 90, words=80))
    check(make_docs, [(i, t, None) for i, t in enumerate(texts)])


def test_edges(make_docs):
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \n\t", "a"), (4, "one", "a"), (5, "ONE", "a"), (6, "one two", "a"),
        (7, "a b c d e", "a"), (8, "A b\x0bc\x0cd e", "a"), (9, "a b c d e f", "a"), (10, "É b c d e", "a"),
        (11, "é b c d e", "a"), (12, long, None), (13, long + " end", None), (14, long, None), (12, long, None),
        (20, "same same same same same same same", None), (21, "same same same same same", None),
        (None, "no id here at all", None), (30, "no id here at all", None), (None, "alone without any id", None),
    ]
    check(make_docs, rows)
    assert minmax.near_duplicates(make_docs([])).count() == 0
    assert minmax.near_duplicates(make_docs([(1, None, None)])).count() == 1


def test_sketches_never_exceed_the_difference():
    rnd = np.random.default_rng(2)
    for n in (10, 200, 255, 256, 257, 5000):
        a = np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(0.9 * len(a))], rnd.integers(0, 2**63, n // 7 + 1, dtype=np.uint64)]))
        differing = len(np.setxor1d(a, b))
        x, y = minmax._sketch(a), minmax._sketch(b)
        size = min(len(x), len(y))
        x, y = (s if len(s) == size else minmax._folded(s, size) for s in (x, y))
        assert (int.from_bytes(x) ^ int.from_bytes(y)).bit_count() <= differing


def test_min_and_max_agree_as_often_as_sets_are_alike():
    rnd = np.random.default_rng(4)
    shared = []
    for _ in range(60):
        pool = np.unique(rnd.integers(0, 2**63, 1000, dtype=np.uint64))
        a, b = np.sort(pool[:800]), np.sort(pool[200:])
        shared.append(np.mean(minmax._signature(a) == minmax._signature(b)))
    assert abs(np.mean(shared) - 0.6) < 0.03


def test_components(spark):
    rnd = random.Random(6)
    edges = [(i, i + 1) for i in range(200)] + [(1000, x) for x in range(1001, 1100)]
    edges += [(rnd.randrange(2000, 2300), rnd.randrange(2000, 2300)) for _ in range(200)] + [(5, 5), (1, 0)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
        if not changed:
            break
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: low for x, low in label.items() if x not in alone}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_an_outsider_meets_a_large_component_once(spark):
    """2000 members of one component and one outsider: every member is in one block, the outsider in each."""
    rows = [(7, i, 0) for i in range(2000)] + [(7, 5000, 5000)] + [(8, i, i) for i in range(300)] + [(9, 1, 1), (9, 2, 1)]
    inner = spark.createDataFrame(rows, "key long, id long, component long")
    dealt = minmax._dealt(inner).collect()
    chunks = -(-2000 // minmax.BLOCK)
    assert sum(r.key == 7 for r in dealt) == 2000 + chunks + 1  # the last: the outsider with itself
    met = set()
    for block in {(r.key, r.lo, r.hi) for r in dealt}:
        inside = [r for r in dealt if (r.key, r.lo, r.hi) == block]
        left = [r for r in inside if r.chunk == block[1]]
        right = [r for r in inside if r.chunk == block[2]]
        met |= {(block[0], *sorted((a.id, b.id))) for a in left for b in right if a.component != b.component}
    want = {(7, i, 5000) for i in range(2000)} | {(8, i, j) for j in range(300) for i in range(j)}
    assert met == want
