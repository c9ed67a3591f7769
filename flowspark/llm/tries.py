"""The prefix trie of conversations; totals of its subtrees by parallel tree contraction."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.common import shuffle_partitions, written

#: Consecutive turns of a conversation that one window adds up.
BLOCK_TURNS = 1024
#: A node with more than this share of all nodes as children is hot; there are at most so many of them.
HOT_NODES = 1024
#: Ids that are joined to one string before they are hashed.
CHUNK_IDS = 1 << 13
_FAMILY, _SHARED = 5, 9


def numbered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, h1, h2, bytes) of every turn, numbered from 0 in each conversation; null numbers first, equal ones by role and text
    hash. Null roles and texts are empty; turns without a conversation are left out.

    Turns are range-partitioned by conversation and turn, so that one conversation may span many parts; it is
    numbered part by part, and each part is shifted by the sizes of those before.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"),
        F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit("turn"), text, role).alias("h2"),
        F.octet_length(text).cast("long").alias("bytes"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("h1"), F.col("h2")]
    # The ranges come from a sample: they are fixed by being stored.
    dealt = written(rows.repartitionByRange(shuffle_partitions(turns.sparkSession), "conv", *order)
                    .withColumn("part", F.spark_partition_id()), "turns")
    own = Window.partitionBy("conv", "part")
    sizes = dealt.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("conv", "part", F.coalesce(F.sum("n").over(
        Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return dealt.withColumn("at", F.row_number().over(own.orderBy(*order))).join(before, ["conv", "part"]).select(
        "conv", (F.col("before") + F.col("at") - 1).alias("pos"), "h1", "h2", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From numbered turns: (conv, pos, h1, h2, bytes) of the rebuilt conversations, and (conv, length) of all of them, turnless
    ones as well. A conversation c begins with the first turns of c - c % 5, crc32(c) % 9 at most, and goes on with its own turns after as many."""
    convs = written(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("size")).select(
        "conv", "size", (F.col("conv") - F.col("conv") % _FAMILY).alias("base"),
        (F.crc32(F.col("conv").cast("string").cast("binary")) % _SHARED).alias("h")), "conversations")
    bases = convs.select(F.col("conv").alias("base"), F.col("size").alias("base_size"))
    convs = convs.join(bases, "base", "left").select(
        "conv", "base", "h", F.least("h", F.coalesce("base_size", F.lit(0))).alias("taken"),
        F.greatest(F.col("size") - F.col("h"), F.lit(0)).alias("own"))
    # Few turns of each base, few conversations to each base; own turns keep their partitioning by conversation.
    first = turns.where(F.col("pos") < _SHARED - 1).withColumnRenamed("conv", "base").join(
        convs.select("conv", "base", "h"), "base").where("pos < h").select("conv", "pos", "h1", "h2", "bytes")
    shift = convs.select(F.col("conv").alias("c"), F.col("h"), F.col("taken"))
    # A conversation may hold a large share of all turns: it meets its one row block by block.
    blocks = turns.withColumn("block", F.floor(F.col("pos") / BLOCK_TURNS))
    held = blocks.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("_n")).join(shift, F.col("conv") == F.col("c")).select(
        "conv", "block", "h", "taken")
    own = blocks.join(held, ["conv", "block"]).where("pos >= h").select(
        "conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "h1", "h2", "bytes")
    return first.unionByName(own), convs.select("conv", (F.col("taken") + F.col("own")).alias("length"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, p1, p2, bytes): keys of the first ``depth`` turns and of one turn fewer.

    A key is 128 bits: the exclusive or of hashes of each turn with its place, so it adds up block by block.
    Two of n prefixes fall together with a chance of n^2 / 2^128.
    """
    placed = turns.select("conv", "pos", F.floor(F.col("pos") / BLOCK_TURNS).alias("block"), "bytes",
                          F.xxhash64("pos", "h1", "h2").alias("h1"), F.xxhash64(F.lit("at"), "pos", "h2", "h1").alias("h2"))
    whole = placed.groupBy("conv", "block").agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select("conv", "block", *[F.coalesce(F.bit_xor(f"b{i}").over(earlier), F.lit(0)).alias(f"b{i}") for i in (1, 2)])
    run = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keyed = placed.select("conv", "block", "pos", "bytes", "h1", "h2", F.bit_xor("h1").over(run).alias("x1"),
                          F.bit_xor("h2").over(run).alias("x2")).join(before, ["conv", "block"])
    k = {f"k{i}": F.col(f"x{i}").bitwiseXOR(F.col(f"b{i}")) for i in (1, 2)}
    return keyed.select("conv", (F.col("pos") + 1).alias("depth"), k["k1"].alias("k1"), k["k2"].alias("k2"),
                        k["k1"].bitwiseXOR(F.col("h1")).alias("p1"), k["k2"].bitwiseXOR(F.col("h2")).alias("p2"), "bytes")


def nodes(keyed: DataFrame, lengths: DataFrame) -> DataFrame:
    """(node, conv_id, depth, k1, k2, n_convs, bytes, n_children, parent, parent_conv_id), stored; the root has depth 0 and key 0."""
    made = keyed.groupBy("depth", "k1", "k2").agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"), F.min("p1").alias("p1"),
        F.min("p2").alias("p2"))
    root = lengths.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id", "n_convs",
        F.lit(0).cast("long").alias("bytes"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    made = written(made.unionByName(root).withColumn("node", F.monotonically_increasing_id()), "nodes")
    total = made.count()
    children = made.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    counted = written(made.join(children, ["depth", "k1", "k2"], "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0))), "counted")
    parents = counted.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("node").alias("parent"),
        F.col("conv_id").alias("parent_conv_id"), "n_children")
    # Fewer than HOT_NODES nodes can each have more than 1/HOT_NODES of all nodes as children: these are broadcast, and no
    # other key brings more than that share to a task.
    bound = max(total // HOT_NODES, HOT_NODES)
    hot = F.broadcast(parents.where(F.col("n_children") > bound).drop("n_children").withColumn("hot", F.lit(True)))
    cool = parents.where(F.col("n_children") <= bound).drop("n_children")
    first = counted.join(hot, ["depth", "p1", "p2"], "left")
    met = first.where("hot").drop("hot")
    others = first.where("hot IS NULL").drop("hot", "parent", "parent_conv_id").join(cool, ["depth", "p1", "p2"], "left")
    return written(met.unionByName(others).drop("p1", "p2"), "tree")


def subtree_totals(tree: DataFrame, values: list[str], id_col: str = "node", parent_col: str = "parent") -> DataFrame:
    """(id_col, *values): the sums of ``values`` over each node's subtree, itself included. A root has a null parent.

    Parallel tree contraction. A round rakes all leaves, which give their totals to their parents, and compresses unary
    chains: of nodes with one child left, those whose coin falls and whose parent's does not leave, and their child
    hangs on with what they had. Coins alternate between a bit of the node's depth in the chain (half of a plain chain goes) and a
    hash (a quarter of any chain is expected to). The nodes left shrink by a share each round, so rounds grow with the
    logarithm of the tree's size, whatever its depth. Then rounds are undone last to first: a node that was
    compressed has its child's total and what it held.

    Joins are by node, where each id occurs once on both sides; children of one parent are added up before they are shuffled.
    """
    zero = F.lit(0).cast("long")
    live = tree.select(F.col(id_col).alias("id"), F.col(parent_col).alias("up"), F.col("depth").cast("long").alias("place"),
                       *[F.col(v).cast("long").alias(f"a_{v}") for v in values], *[zero.alias(f"e_{v}") for v in values])
    undo: list[tuple[DataFrame, DataFrame]] = []
    turn = 0
    while True:
        # Rake: leaves go, parents take what they and their edges hold.
        inner = live.where("up IS NOT NULL").select(F.col("up").alias("id")).distinct().withColumn("inner", F.lit(True))
        flagged = written(live.join(inner, "id", "left"), "flagged")
        leaves = flagged.where("inner IS NULL").select("id", *[F.col(f"a_{v}").alias(v) for v in values])
        given = flagged.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(
            *[F.sum(F.when(F.col("inner").isNull(), F.col(f"a_{v}") + F.col(f"e_{v}")).otherwise(0)).alias(f"g_{v}") for v in values],
            F.count("inner").alias("n"), F.max(F.when(F.col("inner"), F.col("id"))).alias("child"))
        kept = flagged.where("inner").drop("inner").join(given, "id").select(
            "id", "up", "place", *[(F.col(f"a_{v}") + F.col(f"g_{v}")).alias(f"a_{v}") for v in values], *[f"e_{v}" for v in values], "child",
            ((F.col("n") == 1) & F.col("up").isNotNull() & (
                F.shiftright("place", turn // 2 % 62).bitwiseAND(F.lit(1)) == 1 if turn % 2 == 0
                else F.xxhash64(F.lit(turn), "id").bitwiseAND(F.lit(1)) == 1)).alias("falls"))
        kept = written(kept, "raked")
        # Compress: the only child of a falling node stays this time and learns where to hang on.
        told = kept.where("falls").select(
            F.col("child").alias("id"), F.col("id").alias("above"), F.col("up").alias("to"),
            *[(F.col(f"a_{v}") + F.col(f"e_{v}")).alias(f"t_{v}") for v in values], *[F.col(f"a_{v}").alias(f"own_{v}") for v in values],
            *[F.lit(None).cast("long").alias(f"x_{v}") for v in values])
        asked = written(kept.join(told.drop(*[f"x_{v}" for v in values]), "id", "left"), "asked")
        gone = asked.where("falls AND above IS NULL").select(F.col("id").alias("above"), F.lit(True).alias("goes"))
        stay = written(asked.where("NOT falls OR above IS NOT NULL").join(gone, "above", "left"), "compressed")
        spliced = stay.where("goes").select(
            F.col("above").alias("id"), F.col("id").alias("child"),
            *[(F.col(f"own_{v}") + F.col(f"e_{v}")).alias(v) for v in values])
        live = stay.select(
            "id", F.when(F.col("goes"), F.col("to")).otherwise(F.col("up")).alias("up"), "place", *[f"a_{v}" for v in values],
            *[(F.col(f"e_{v}") + F.when(F.col("goes"), F.col(f"t_{v}")).otherwise(0)).alias(f"e_{v}") for v in values])
        undo.append((leaves, spliced))
        turn += 1
        if live.isEmpty():
            break

    known = None
    for leaves, spliced in reversed(undo):
        if known is None:
            known = leaves
            continue
        back = spliced.join(known.select(F.col("id").alias("child"), *[F.col(v).alias(f"c_{v}") for v in values]), "child").select(
            "id", *[(F.col(v) + F.col(f"c_{v}")).alias(v) for v in values])
        known = written(known.unionByName(leaves).unionByName(back), "totals")
    return known.withColumnRenamed("id", id_col)


def end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) from rows (depth, k1, k2, conv): the SHA-256 of each key's sorted, comma-joined ids.

    Ids are range-partitioned by key and id, and runs of a key are joined to strings of thousands of ids; a key's strings are then
    hashed as a stream in their order, so memory is bounded by one string however many ids a key has.
    """
    n = shuffle_partitions(ends.sparkSession)
    key = ["depth", "k1", "k2"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, done = None, [], []

        def chunks(done):
            columns = list(zip(*done, strict=True)) or [[], [], [], [], []]
            return pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())], [*key, "first", "ids"])

        for batch in batches:
            for *k, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if ids and (k != now or len(ids) >= CHUNK_IDS):
                    done.append((*now, ids[0], ",".join(map(str, ids))))
                    ids = []
                now = k
                ids.append(conv)
            yield chunks(done)
            done = []
        if ids:
            yield chunks([(*now, ids[0], ",".join(map(str, ids)))])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            for *k, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield rows(done)
            done = []
        if now is not None:
            yield rows([(*now, state.hexdigest())])

    def rows(done):
        columns = list(zip(*done, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
                                          [*key, "ends_sha256"])

    chunks = ends.select(*key, "conv").repartitionByRange(n, *key, "conv").sortWithinPartitions(*key, "conv").mapInArrow(
        join, "depth long, k1 long, k2 long, first long, ids string")
    return chunks.repartition(n, *key).sortWithinPartitions(*key, "first").select(*key, "ids").mapInArrow(
        digest, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (see ``rebuilt``): conv_id (the smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves and saved_tokens of its subtree, ends_sha256 of the members that end there.

    Nodes are named by keys of their prefixes, which are running sums, so a long conversation is never in one
    task. Totals of subtrees come from ``subtree_totals``. saved_tokens adds up (n_convs - 1) times the UTF-8 bytes
    of each node's last text.

    Turns are ordered by number (null first), equal numbers by role and a hash of the text. Null roles and texts are empty; rows without a
    conversation are left out; repeated rows are turns of their own; other columns are ignored. Conversations without turns after
    rebuilding end at the root. An empty table gives no rows.
    """
    own = written(numbered(turns, conv_col, turn_col, role_col, text_col), "numbered")
    again, lengths = rebuilt(own)
    keyed, lengths = written(prefixes(again), "prefixes"), written(lengths, "lengths")
    tree = nodes(keyed, lengths).withColumns({
        "n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"),
        "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")})
    totals = subtree_totals(tree, ["n_leaves", "saved_tokens"])
    last = keyed.join(lengths.select("conv", F.col("length").alias("depth")), ["conv", "depth"]).select("depth", "k1", "k2", "conv")
    turnless = lengths.where("length = 0").select(*[F.lit(0).cast("long").alias(c) for c in ("depth", "k1", "k2")], "conv")
    hashes = end_hashes(last.unionByName(turnless))
    return tree.drop("n_leaves", "saved_tokens").join(totals, "node").join(hashes, ["depth", "k1", "k2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
