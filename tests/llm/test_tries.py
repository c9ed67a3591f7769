import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flowspark.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string, node long, depth string, bytes int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", 2) for r in rows], SCHEMA).repartition(5)


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [t[1:] for t in sorted(ts)] for c, ts in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        full = turns.get(c - c % 5, [])[:h] + own[h:]
        for d in range(len(full) + 1):
            members[tuple(full[:d])].append(c)
        ends[tuple(full)].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, who in members.items())


def check(spark, rows):
    got = tries.prefix_trie(frame(spark, rows))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def talk(rng, c, n, pool):
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(pool)) for t in range(n)]


def test_equals_brute_force(spark):
    rng = random.Random(1)
    pool = ["yes", "no", "é" * 5, "maybe so", "", "well"]
    rows = [r for c in range(60) for r in talk(rng, c, rng.choice([1, 2, 5, 9, 14]), pool)]
    # Copies of conversations, families without their first, null numbers, roles and texts, ties, repeats, no conversation.
    rows += [(c, t, "user", f"same {t}") for c in range(100, 160) for t in range(4)]
    rows += [(171, 0, "user", "a"), (172, None, None, None), (172, 3, None, "b"), (172, 3, None, "b"), (173, None, "user", "z")]
    rows += [(None, 1, "user", "lost"), (181, 5, "user", "one turn only"), (1_000_003, 1, "x", "far"), (1_000_000, 2, "x", "far")]
    check(spark, rows)


def test_long_conversations_in_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(tries, "BLOCK_TURNS", 7)
    rng = random.Random(2)
    rows = talk(rng, 5, 400, ["a", "bb"]) + talk(rng, 6, 150, ["a", "bb"]) + talk(rng, 12, 3, ["a"])
    check(spark, rows)


def test_hot_parents_and_hot_ends(spark, monkeypatch):
    monkeypatch.setattr(tries, "HOT_NODES", 4)
    monkeypatch.setattr(tries, "CHUNK_IDS", 10)
    rows = [(c, 0, "system", "the same start") for c in range(0, 300)] + [(c, 1, "user", f"own {c}") for c in range(0, 300, 2)]
    check(spark, rows)


@pytest.mark.parametrize("shape", ["chain", "star", "comb", "random", "nested"])
def test_contraction(spark, shape):
    rng, n = random.Random(3), 300
    parent = {"chain": lambda i: i - 1, "star": lambda i: 0, "comb": lambda i: i - 1 if i % 2 else max(0, i - 2),
              "random": lambda i: rng.randrange(i), "nested": lambda i: rng.randrange(max(0, i - 3), i)}[shape]
    up = {0: None} | {i: parent(i) for i in range(1, n)}
    depth = {0: 0}
    for i in range(1, n):
        depth[i] = depth[up[i]] + 1
    want = {i: [i, 1] for i in up}
    for i in range(n - 1, 0, -1):
        want[up[i]] = [a + b for a, b in zip(want[up[i]], want[i])]
    tree = spark.createDataFrame([(i, p, depth[i], i, 1) for i, p in up.items()], "node long, parent long, depth long, v long, one long")
    got = {r.node: [r.v, r.one] for r in tries.subtree_totals(tree, ["v", "one"]).collect()}
    assert got == want


def test_empty_table(spark):
    assert tries.prefix_trie(frame(spark, [])).count() == 0
    assert tries.prefix_trie(frame(spark, [(None, 1, "user", "x")])).count() == 0


def test_same_rows_on_one_partition(spark):
    rows = [(c, t, "user", f"{c % 3} {t}") for c in range(20) for t in range(6)]
    assert sorted(map(tuple, tries.prefix_trie(frame(spark, rows).coalesce(1)).collect())) == brute(rows)
    assert tries.prefix_trie(frame(spark, rows).withColumn("more", F.lit(1))).count() == len(brute(rows))
