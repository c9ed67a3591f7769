"""Near duplicates: ProbMinHash of weighted word shingles, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm import exchange, golomb
from flowspark.llm.common import checked_broadcast, join_hot, map_rows, text_of, written
from flowspark.llm.components import components

WORDS, SIMILARITY = 5, 0.8
#: A pair at the limit of 0.8 shares one of 32 bands of 4 registers but for one in twenty million.
BANDS, ROWS = 32, 4
#: Rounds of leaving out texts with too few common shingles.
PRUNES = 2
#: A block of the exchange closes at so many keys: some 32 bytes each while it is sorted.
BLOCK_KEYS = 1 << 18
#: Texts that are sketched together have so many characters, or are one text.
SKETCHED_CHARS = 1 << 20
_MIX = tuple(np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that scatters (the finaliser of splitmix)."""
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 1 << 18):
        from xxhash import xxh3_64_intdigest

        self._known, self._most, self._hash = {}, most, xxh3_64_intdigest

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self._known) > self._most:
            self._known.clear()
        known, digest = self._known, self._hash
        out = [known.get(w) for w in words]
        for i, value in enumerate(out):
            if value is None:
                out[i] = known[words[i]] = digest(words[i])
        return np.array(out, np.uint64)


def shingles(hashes: np.ndarray, width: int = WORDS) -> np.ndarray:
    """A 64-bit hash for each run of ``width`` words; fewer words are one shingle, none have none."""
    width = min(width, len(hashes)) or 1
    n = len(hashes) - width + 1
    out = np.full(max(n, 0), width, np.uint64)
    for i in range(width):
        out = mixed(out ^ hashes[i:i + n]) if n > 0 else out
    return out


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, registers: int) -> np.ndarray:
    """ProbMinHash of ``n`` weighted sets, given as (element, weight, owner) rows: registers x n.

    Each element of a set is a Poisson process with its weight as rate; each arrival goes to a random
    register, which keeps the element that arrives first. Registers of two sets agree with chance
    equal to their probability Jaccard similarity. An element stops as soon as its next arrival is
    later than everything its set's registers hold. All sets advance together, arrival by arrival.
    """
    first = np.full(n * registers, np.inf)
    held = np.zeros(n * registers, np.uint64)
    at, state, clock = np.arange(len(elements)), elements, np.zeros(len(elements))
    while len(at):
        state = mixed(state)
        uniform = ((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53
        clock = clock - np.log(uniform) / weights[at]
        register = (mixed(state ^ _MIX[1]) % np.uint64(registers)).astype(np.int64)
        slot = owner[at] * registers + register
        better = np.flatnonzero(clock < first[slot])
        np.minimum.at(first, slot[better], clock[better])
        won = better[clock[better] == first[slot[better]]]
        held[slot[won]] = elements[at[won]]
        live = np.unique(owner[at])
        latest = np.zeros(n)
        latest[live] = first.reshape(n, registers)[live].max(axis=1)
        on = clock < latest[owner[at]]
        at, state, clock = at[on], state[on], clock[on]
    return held.reshape(n, registers)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """bands keys for each row of registers."""
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(signature), bands)).copy()
    for r in range(rows):
        out = mixed(out ^ signature[:, r::rows][:, :bands])
    return out


def sketches(docs: DataFrame, width: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(id, tag, key, bands): a hash of the text, a key of the words in order, and the keys of the bands (none without words), of
    the shingles weighted by how often they occur, and of their plain set."""

    def start():
        hashes = WordHashes()

        def step(ids, tags, texts):
            keys, parts, counts = [], [], []
            for text in texts:
                words = text.encode().split()
                keys.append(blake2b(b" ".join(words), digest_size=16).digest())
                distinct, weight = np.unique(shingles(hashes(words), width), return_counts=True)
                parts.append(distinct)
                counts.append(weight)
            found = banded(parts, counts)
            # Sets are banded by the same keys: where nothing repeats, they are those of the weighted set.
            again = [i for i, c in enumerate(counts) if c.max(initial=1) > 1]
            for i, plain in zip(again, banded([parts[i] for i in again], [np.ones_like(counts[i]) for i in again]), strict=True):
                found[i] = list(dict.fromkeys([*found[i], *plain]))
            return ids, tags, keys, found

        def banded(parts, counts):
            sizes = [len(p) for p in parts]
            signature = signatures(
                np.concatenate([*parts, np.zeros(0, np.uint64)]), np.concatenate([*counts, np.zeros(0)]).astype(float),
                np.repeat(np.arange(len(parts)), sizes), len(parts), bands * rows)
            found = band_keys(signature, bands, rows).view(np.int64)
            return [list(f) if s else [] for f, s in zip(found, sizes, strict=True)]

        def small(ids, tags, texts):
            out, first, held = ([], [], [], []), 0, 0
            for i, text in enumerate(texts):
                held += len(text)
                if held >= SKETCHED_CHARS or i + 1 == len(texts):
                    for column, more in zip(out, step(*(x[first:i + 1] for x in (ids, tags, texts))), strict=True):
                        column.extend(more)
                    first, held = i + 1, 0
            return out

        return small

    rows_in = text_of(docs, id_col, text_col).where(F.col("id").isNotNull()).select("id", F.xxhash64("text").alias("tag"), "text")
    return map_rows(rows_in, start, "id long, tag long, key binary, bands array<long>",
                    {"id": pa.int64(), "tag": pa.int64(), "key": pa.binary(), "bands": pa.list_(pa.int64())})


def compared(texts: DataFrame, pairs: DataFrame, width: int, least: float, with_bits: bool = False) -> DataFrame:
    """(a, b, similarity) of the pairs with a Jaccard similarity of ``least`` or more, by their whole texts.
    ``with_bits`` adds ``shared``, a bitmap of the shingles of a, in order, that b has, and their number."""
    rows = (
        pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )
    kind = "a long, b long, similarity double" + ", shared array<long>, n_shared long" * with_bits
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())] + [
        ("shared", pa.list_(pa.int64())), ("n_shared", pa.int64())] * with_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, mine = WordHashes(), None, None
        for batch in batches:
            out = []
            for a, b, text_a, text_b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if last != (a, text_a):  # rows of one a mostly follow each other
                    last, mine = (a, text_a), np.unique(shingles(hashes(text_a.encode().split()), width))
                other = np.unique(shingles(hashes(text_b.encode().split()), width))
                has = np.isin(mine, other, assume_unique=True)
                common = int(has.sum())
                value = common / max(1, len(mine) + len(other) - common)
                if value >= least:
                    row = {"a": a, "b": b, "similarity": value}
                    if with_bits:
                        packed = np.packbits(np.append(has, np.zeros(-len(has) % 64, bool)))
                        row |= {"shared": packed.view(np.int64).tolist(), "n_shared": common}
                    out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema)

    return written(rows.mapInArrow(run, kind), "compared")


def common_shingles(texts: DataFrame, width: int) -> DataFrame:
    """(id, size, common): how many shingles a text has, and how many of them, at least about and at most
    by collisions too many, another of the texts has, too. By an exchange of coded keys."""
    owners = exchange.owners_for(texts.sparkSession, 500 * texts.count())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, block = WordHashes(), exchange.Block(owners, exchange.KEY_BITS, places=False)
        for batch in batches:
            for i, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                keys = shingles(hashes(text.encode().split()), width)
                keys = np.unique(keys) >> np.uint64(64 - exchange.KEY_BITS)
                block.add(keys, i, 0, np.zeros(len(keys), np.int64))
                if block.size >= BLOCK_KEYS:
                    yield block.flush()
        if block.size:
            yield block.flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, shared = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            for r in batch.to_pylist():
                runs = np.frombuffer(r["runs"], np.uint32)
                ids.append(np.frombuffer(r["rows"], np.int64))
                shared.append(np.repeat(golomb.unpack(r["bits"], r["n"]) | (runs > 1), runs))
            distinct, at, sizes = np.unique(np.concatenate(ids), return_inverse=True, return_counts=True)
            counts = np.bincount(at, np.concatenate(shared), len(distinct)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(distinct, pa.int64()), pa.array(sizes, pa.int64()),
                                              pa.array(counts)], ["id", "size", "common"])

    cells = written(texts.select("id", "text").mapInArrow(send, exchange.CELL), "shingles")
    # Python gets what it reads, no more.
    counted = exchange.with_bits(cells, owners, exchange.KEY_BITS, False).select("n", "runs", "rows", "bits").mapInArrow(
        count, "id long, size long, common long")
    return counted.groupBy("id").agg(F.sum("size").alias("size"), F.sum("common").alias("common"))


def _possible(similarity: float, common: str) -> str:
    """Whether sets of n and m elements with at most ``common`` common ones can be similar enough."""
    return f"{common} >= {similarity} * (n + m - {common}) - 1e-6"


def near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, class_id and kept of every row; a class is named by its least id, the document that stays.

    Texts of equal words are one class from the start. Of each such group one text is sketched: its
    shingles of ``width`` words by ProbMinHash, weighted by how often they occur, and once more with equal
    weights, where registers agree with chance equal to the Jaccard similarity of the sets. Documents
    sharing a band are candidates; links are those with a Jaccard similarity of the sets of shingles of
    ``similarity`` or more, computed from the whole texts; classes are the components of the links.

    A bucket is not expanded into pairs. Shingles that no other candidate has cannot be shared, so texts
    with too many of them leave at once, and pairs are compared only if what is left of both allows the
    similarity. All members of a bucket are compared with its most central one; what is then in one
    component needs no comparison. Members in different components are compared pair by pair, if the
    bitmaps of what each shares with the central one, and what else they can have in common, allow the
    similarity: no candidate pair that can be a link is left out.

    Texts of fewer words than ``width`` are one shingle; texts without words (null, empty, blank) are
    copies of each other. Rows without an id are left out. Rows that share an id are judged by their own texts; of
    those with the id that stays, equal texts all stay. Other columns are ignored. ``settings`` as of ``classes``.
    """
    return classes(docs, **settings).select(F.col("id").alias("doc_id"), "class_id", "kept")


def classes(
    docs: DataFrame, similarity: float = SIMILARITY, width: int = WORDS, bands: int = BANDS, rows: int = ROWS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, tag, class_id, kept) as ``near_duplicates`` says, with a hash of the text, which tells rows of one id apart."""
    sketch = written(sketches(docs, width, bands, rows, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "sketches")
    # A group of equal words is named by a stored row of its least id.
    groups = written(sketch.groupBy("key").agg(F.min(F.struct("id", "row")).alias("first"), F.count(F.lit(1)).alias("n")).select(
        "key", F.col("first.row").alias("node"), F.col("first.id").alias("rep"), "n"), "groups")
    heads = written(sketch.join(groups.select(F.col("node").alias("row"), "rep"), "row").select(
        F.col("row").alias("id"), "rep", "tag", "bands"), "heads")
    placed = heads.select("id", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = written(placed.join(shared, "bucket"), "buckets")
    named = written(heads.select("id", "rep", "tag").join(buckets.select("id").distinct(), "id"), "candidates")
    n_named = named.count()
    side = checked_broadcast(named.withColumnRenamed("id", "node"), n_named, 32)
    texts = text_of(docs, id_col, text_col).select(F.col("id").alias("rep"), F.xxhash64("text").alias("tag"), "text")
    candidates = written(texts.join(side, ["rep", "tag"]).select(F.col("node").alias("id"), "text"), "texts")
    if candidates.count() > n_named:  # rows that are repeated
        candidates = written(candidates.dropDuplicates(["id"]), "texts")
    for _ in range(PRUNES):
        sizes = written(common_shingles(candidates, width).where(F.col("common") >= similarity * F.col("size") - 1e-6)
                        .select("id", F.col("size").alias("n"), F.col("common").alias("s")), "sizes")
        # What only leavers had in common with a text is not common any more.
        candidates = candidates.join(checked_broadcast(sizes.select("id"), sizes.count(), 16), "id", "left_semi")
    # What lies in the middle of a group shares more bands with the others than they share among themselves.
    weights = buckets.groupBy("id").agg(F.sum("size").alias("weight"))
    known = written(sizes.join(weights, "id"), "weights")
    buckets = written(buckets.select("bucket", "id").join(known, "id"), "buckets")

    central = F.struct("weight", (-F.col("id")).alias("minus"), "n", "s")
    hubs = written(buckets.groupBy("bucket").agg(F.max(central).alias("h")).select(
        "bucket", (-F.col("h.minus")).alias("hub"), F.col("h.n").alias("m"), F.col("h.s").alias("t")), "hubs")
    stars = buckets.join(hubs, "bucket").where(f"id != hub AND {_possible(similarity, 'least(s, t)')}")
    stars = written(stars.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    near = compared(candidates, stars, width, 0.0, with_bits=True)
    links = near.where(F.col("similarity") >= similarity).select("a", "b")
    found = components(links)

    placed = buckets.join(found.withColumnRenamed("component", "c"), "id", "left").withColumn("c", F.coalesce("c", "id"))
    several = placed.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
    bits = near.select(F.col("a").alias("hub"), F.col("b").alias("id"), "shared", "n_shared")
    apart = written(
        placed.join(several.select("bucket"), "bucket").join(hubs.select("bucket", "hub"), "bucket")
        .where("id != hub").join(bits, ["hub", "id"], "left").select("bucket", "id", "n", "s", "c", "shared", "n_shared"),
        "apart")
    other = apart.select("bucket", *[F.col(x).alias(y) for x, y in (
        ("id", "b"), ("n", "m"), ("s", "t"), ("c", "d"), ("shared", "shared_b"), ("n_shared", "n_shared_b"))])
    # At most: what both share with the central member, and what they share with any other text besides.
    inside = "aggregate(zip_with(shared, shared_b, (x, y) -> bit_count(x & y)), 0, (x, y) -> x + y)"
    most = f"least(s, t, coalesce({inside} + least(s - n_shared, t - n_shared_b), s))"
    pairs = apart.withColumnRenamed("id", "a").join(other, "bucket").where(f"c < d AND {_possible(similarity, most)}")
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    more = compared(candidates, pairs, width, similarity).select("a", "b")
    if not more.isEmpty():
        found = components(links.unionByName(more))
    # A class is named, and its document chosen, by the least id of its groups.
    joined = groups.join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = joined.groupBy("component").agg(F.min(F.struct("rep", "node")).alias("least"))
    named = written(joined.join(least, "component").select(
        "key", "n", F.col("least.rep").alias("class_id"), (F.col("least.node") == F.col("node")).alias("leads")), "classes")
    return join_hot(sketch.select("id", "tag", "key"), named, ["key"], "n", sketch.count()).select(
        "id", "tag", "class_id", (F.col("leads") & (F.col("id") == F.col("class_id"))).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` without the near duplicates that go; rows without an id stay. A row goes by its id and text, so
    another text under the same id is judged on its own."""
    gone = written(classes(docs, id_col=id_col, text_col=text_col, **settings).where("not kept")
                   .select(F.col("id").alias("_gone"), F.col("tag").alias("_tag")).distinct(), "gone")
    same = (docs[id_col] == F.col("_gone")) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == F.col("_tag"))
    return docs.join(checked_broadcast(gone, gone.count(), 24), same, "left_anti")
