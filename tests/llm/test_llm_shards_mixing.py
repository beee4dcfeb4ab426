from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

from shelfmark.llm import mixing, shards


def corpus(n=600):
    rnd = random.Random(5)
    rows = []
    for i in range(n):
        source = None if i % 17 == 0 else "hot" if i % 3 else f"s{i % 5}"
        rows.append((i, " ".join("w" * rnd.randrange(1, 9) for _ in range(rnd.randrange(0, 400))), source))
    rows += [(n, None, "s1"), (n + 1, "", "hot"), (None, "no id", "s2"), (3, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2])]
    return rows


def test_shards(make_docs):
    rows = corpus()
    got = shards.shards(make_docs(rows), n_shards=7).collect()
    assert Counter((r.doc_id, r.source, r.size, r.text_crc32) for r in got) == Counter(
        (i, s, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, s in rows
    )
    by_shard, by_both = defaultdict(list), Counter()
    for r in got:
        by_shard[r.shard].append(r.slot)
        by_both[r.source, r.shard] += 1
    assert sorted(by_shard) == list(range(7))
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    for source in {r.source for r in got}:
        each = [by_both[source, k] for k in range(7)]
        assert max(each) - min(each) <= 2, (source, each)
    again = shards.shards(make_docs(rows, partitions=8), n_shards=7).collect()
    key = lambda r: (r.doc_id, r.text_crc32, r.shard, r.slot)
    assert Counter(map(key, again)) == Counter(map(key, got))


def test_few_rows_and_none(make_docs):
    got = shards.shards(make_docs([(1, "a", "x"), (2, "b", None)]), n_shards=24).collect()
    assert sorted(r.slot for r in got) == [0, 0] and len({r.shard for r in got}) == 2
    assert shards.shards(make_docs([])).count() == 0


def filled(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s] + 1e-9}
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_targets(spark):
    rnd = random.Random(1)
    for n in (1, 2, 5, 40):
        sizes = {f"s{i:02d}" if i else None: rnd.choice([0, 1, 5, 100, 1000, 9000]) for i in range(n)}
        sizes[None] += 7
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = filled(sizes)
        assert got.keys() == want.keys()
        for s in want:
            assert abs(got[s] - want[s]) < 1e-6 * max(1, want[s]), (n, s)


def test_mix(make_docs):
    rows = corpus()
    mixed = mixing.mix(make_docs(rows), block=16, n_shards=5)
    got = mixing.taken(mixed).collect()
    size = lambda t: len((t or "").split())
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, size(t)) for i, t, s in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want, taken = filled(sizes), Counter()
    for r in got:
        assert r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * r.target
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 32 + 0.01 * want[s] for s in want), (taken, want)
    again = mixing.taken(mixing.mix(make_docs(rows, partitions=7), block=16, n_shards=5)).collect()
    key = lambda r: (r.doc_id, r.source, r.taken, r.place)
    assert sorted(map(key, again), key=str) == sorted(map(key, got), key=str)
    # Every pass over a source is a permutation: no block twice in one pass.
    draws = mixed.draws.collect()
    assert len({(d.source, d.turn, d.block) for d in draws}) == len(draws)
    assert {d.shard for d in draws} == set(range(5))
    whole = mixing.copies(mixed).collect()
    assert max(r.copies for r in whole) <= 3 and len(whole) == len(rows)


def test_mix_of_nothing(make_docs):
    assert mixing.taken(mixing.mix(make_docs([]))).count() == 0
    got = mixing.taken(mixing.mix(make_docs([(1, None, "a"), (2, "", None)]))).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_draws_are_never_broadcast(make_docs):
    mixed = mixing.mix(make_docs(corpus()), block=16, n_shards=5)
    for frame in (mixing.taken(mixed), mixing.copies(mixed)):
        plan = frame._jdf.queryExecution().sparkPlan().toString()
        joins = [line for line in plan.split("\n") if "Join" in line and "_block" in line]
        assert joins and all("SortMergeJoin" in line for line in joins), joins


def test_permutations_are_no_rotations(make_docs):
    """For numbers of blocks at which a fixed step would be a rotation, neighbouring draws take distant blocks."""
    counts = [30, 75, 90, 210, 330]
    rows = [(100 * k + i, "w " * 16, f"s{k}") for k, n in enumerate(counts) for i in range(n)]
    mixed = mixing.mix(make_docs(rows), block=16, n_shards=5)
    blocks = {r.source: r.blocks for r in mixed.sources.collect()}
    draws = mixed.draws.collect()
    assert [blocks[f"s{k}"] for k in range(len(counts))] == counts
    by_pass = defaultdict(set)
    for d in draws:
        by_pass[d.source, d.turn].add(d.block)
    partial = {key: found for key, found in by_pass.items() if len(found) < blocks[key[0]]}
    assert partial and len(draws) == sum(map(len, by_pass.values()))
    for (source, _), found in partial.items():
        # A rotation takes one arc: only one taken block would have a neighbour that is not taken.
        ends = sum((b + 1) % blocks[source] not in found for b in found)
        assert ends > min(len(found), blocks[source] - len(found)) / 5, (source, len(found), ends)
