"""Mixing sources to target weights: budgets down a tree, then a token prefix of each leaf's epochs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.common import SPACE, checked_broadcast, written

#: Documents in one bucket of a leaf's order, about.
BUCKET_DOCS = 4096
#: A leaf is one combination of domain, language and source. Their totals are planned on the driver.
MOST_LEAVES = 1 << 20
LEVELS = ("_domain", "_lang", "_source")


def share_out(budget: float, children: Mapping[str, tuple[float, float]]) -> dict[str, float]:
    """Split a budget among siblings of (weight, capacity): by weight, and what a sibling cannot hold goes
    to the others by weight, until all fits or all are full. Without any weight, by capacity."""
    if not any(w > 0 for w, _ in children.values()):
        children = {k: (c, c) for k, (_, c) in children.items()}
    given, open_, rest = dict.fromkeys(children, 0.0), {k for k, (w, _) in children.items() if w > 0}, budget
    while open_ and rest > 1e-9:
        total = sum(children[k][0] for k in open_)
        full = {k for k in open_ if rest * children[k][0] / total >= children[k][1]}
        if not full:
            for k in open_:
                given[k] = rest * children[k][0] / total
            break
        for k in full:
            given[k] = children[k][1]
        rest -= sum(children[k][1] for k in full)
        open_ -= full
    return given


def budgets(supply: Mapping[tuple[str, ...], float], weights: Mapping[tuple[str, ...], float], total: float,
            epochs: float) -> dict[tuple[str, ...], int]:
    """Tokens each leaf gives. ``supply`` has the leaves' tokens; ``weights`` those of any node by its path
    (1 if absent). A node's budget is split among its children; each can hold ``epochs`` times its supply.
    So a shortage is first made up by siblings, and only if they are full by the ancestors' siblings."""
    capacity: dict[tuple[str, ...], float] = {}
    children: dict[tuple[str, ...], set[tuple[str, ...]]] = {}
    for leaf, tokens in supply.items():
        for depth in range(len(leaf) + 1):
            capacity[leaf[:depth]] = capacity.get(leaf[:depth], 0.0) + tokens * epochs
            if depth:
                children.setdefault(leaf[:depth - 1], set()).add(leaf[:depth])
    out: dict[tuple[str, ...], int] = {}

    def down(node: tuple[str, ...], budget: float) -> None:
        if node not in children:
            out[node] = int(budget + 1e-6)
            return
        split = share_out(budget, {n: (weights.get(n, 1.0), capacity[n]) for n in sorted(children[node])})
        for n, part in split.items():
            down(n, part)

    if supply:
        down((), min(total, capacity[()]))
    return out


def n_tokens(text):
    """Words of white-space separated text, the unit of the budgets."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")).cast("long")


def _leaf(docs: DataFrame, domain: Column, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """``docs`` with the columns of its leaf, its tokens and what orders it."""
    def node(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(""))

    return docs.withColumns({
        "_domain": node(domain), "_lang": node(F.col(lang_col)), "_source": node(F.col(source_col)),
        "_tokens": n_tokens(F.col(text_col)), "_id": node(F.col(id_col)),
    })


def _taken(
    docs: DataFrame, domain: Column, weights: Mapping[tuple[str, ...], float], share: float, epochs: int, seed: int,
    id_col: str, text_col: str, lang_col: str, source_col: str,
) -> DataFrame:
    """``docs`` with _epoch and _take, a row for each epoch that takes the document."""
    spark, leaf = docs.sparkSession, list(LEVELS)
    placed = _leaf(docs, domain, id_col, text_col, lang_col, source_col)
    rows = written(placed.where("_tokens > 0").select(*leaf, "_id", "_tokens"), "leaves")
    found = rows.groupBy(*leaf).agg(F.sum("_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).limit(
        MOST_LEAVES + 1).collect()
    if len(found) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves")
    supply = {tuple(r[c] for c in leaf): r["tokens"] for r in found}
    plan = budgets(supply, weights, share * sum(supply.values()), epochs)
    planned = []
    for r in found:
        full, rest = divmod(plan[tuple(r[c] for c in leaf)], r["tokens"])
        planned.append((*[r[c] for c in leaf], full, rest, 1 << (r["n"] // BUCKET_DOCS).bit_length()))
    leaves = spark.createDataFrame(planned, ", ".join(f"{c} string" for c in leaf)
                                   + ", _full long, _rest long, _buckets long")

    def ordered(df: DataFrame) -> DataFrame:
        """With the document's order in the epoch that takes only a prefix. One row per leaf is broadcast."""
        order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_full"), "_id"))
        known = df.join(F.broadcast(leaves), leaf).withColumn("_order", order)
        place = F.conv(F.substring("_order", 1, 8), 16, 10).cast("long")
        return known.withColumn("_bucket", F.shiftrightunsigned(place * F.col("_buckets"), 32))

    partial = ordered(rows).where("_rest > 0")
    held = partial.groupBy(*leaf, "_bucket", "_rest").agg(F.sum("_tokens").alias("_held"))
    up_to = Window.partitionBy(*leaf).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = held.withColumn("_before", F.coalesce(F.sum("_held").over(up_to), F.lit(0).cast("long")))
    # The bucket where a leaf's budget ends: one row per leaf.
    ends = written(ends.where("_before < _rest AND _before + _held >= _rest").select(
        *leaf, F.col("_bucket").alias("_last"), "_before"), "ends")
    within = Window.partitionBy(*leaf).orderBy("_order", "_tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = partial.join(F.broadcast(ends), leaf).where("_bucket = _last").withColumn(
        "_edge", F.least("_tokens", F.col("_rest") - F.col("_before") - F.coalesce(F.sum("_tokens").over(within), F.lit(0))))
    # About BUCKET_DOCS rows per leaf.
    edge = written(edge.where("_edge > 0").groupBy(*leaf, "_id", "_tokens").agg(F.max("_edge").alias("_edge")), "edges")
    take = F.struct(F.col("_full").alias("epoch"), F.col("_tokens").alias("take"))
    epochs_of = F.expr("CASE WHEN _full > 0 THEN sequence(0L, _full - 1) ELSE array() END")
    tail = F.when(F.col("_bucket") < F.col("_last"), F.array(take)).when(
        F.col("_edge").isNotNull(), F.array(F.struct(F.col("_full").alias("epoch"), F.col("_edge").alias("take"))))
    whole = F.transform(epochs_of, lambda e: F.struct(e.alias("epoch"), F.col("_tokens").alias("take")))
    return (
        ordered(placed.where("_tokens > 0")).join(F.broadcast(ends), leaf, "left")
        .join(checked_broadcast(edge, edge.count(), 128), [*leaf, "_id", "_tokens"], "left")
        .withColumn("_at", F.explode(F.concat(whole, F.coalesce(tail, F.slice(F.array(take), 1, 0)))))
        .withColumns({"_epoch": F.col("_at.epoch").cast("int"), "_take": F.col("_at.take")})
    )


def mixture(
    docs: DataFrame, domain: Column, weights: Mapping[tuple[str, ...], float], share: float = 1.0, epochs: int = 4,
    seed: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """Which documents a mixture takes: doc_id, domain, lang, source, epoch, n_tokens and n_taken.

    The total is ``share`` of all tokens. Budgets go down the tree domain - language - source by weight;
    what a leaf cannot give in ``epochs`` passes over its documents goes to its siblings, then to those of
    its ancestors. Each epoch of a leaf has an order of its own, by a seeded hash of the id; the leaf gives
    the prefix of its epochs that fills its budget. The last document's ``n_taken`` may be less than its
    tokens. A document taken in several epochs has a row for each.

    Only leaf totals, one row per leaf, reach the driver. The prefix is found by the totals of hash buckets;
    only the bucket where a leaf's budget ends is put in order, whatever the size of the leaf, and no text
    is shuffled.

    Documents without tokens are never taken. Null language, source or domain are nodes named ''. Rows
    repeating an id, or without one, share a place in the order, and those of one length are taken
    together. Other columns are ignored. An empty table gives no rows.
    """
    taken = _taken(docs.select(id_col, text_col, lang_col, source_col), domain, weights, share, epochs, seed, id_col,
                   text_col, lang_col, source_col)
    return taken.select(
        F.col(id_col).alias("doc_id"), F.col("_domain").alias("domain"), F.col("_lang").alias("lang"),
        F.col("_source").alias("source"), F.col("_epoch").alias("epoch"), F.col("_tokens").alias("n_tokens"),
        F.col("_take").alias("n_taken"))


def mixed(
    docs: DataFrame, domain: Column, weights: Mapping[tuple[str, ...], float], share: float = 1.0, epochs: int = 4,
    seed: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """The mixture's rows of ``docs``, columns unchanged: a document taken in several epochs is repeated, and
    the last one of a leaf stays whole."""
    return _taken(docs, domain, weights, share, epochs, seed, id_col, text_col, lang_col, source_col).select(*docs.columns)
