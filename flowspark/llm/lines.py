"""Line deduplication with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.common import checked_broadcast, shuffle_partitions, text_of, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"
#: Lines whose share of all lines may be found hot; any other line has less than about one in so many.
HOT_LINES = 1024
#: Bits in a word of the keep bitmaps.
WORD = 32


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keyed(texts: DataFrame, least_chars: int) -> DataFrame:
    """One row per line long enough: id, pos and a hash of 128 bits of its key."""
    key = F.translate(F.btrim("line", F.lit(SPACES)), UPPER, LOWER)
    return (
        texts.select("id", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
        .select("id", "pos", key.alias("key")).where(F.char_length("key") >= least_chars)
        .select("id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )


def line_bitmaps(
    docs: DataFrame, least_chars: int = 20, least_docs: int = 3, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Which lines repeat across documents: one row per document that loses lines, with ``id``,
    ``n_dropped`` and ``dropped``, a sparse bitmap (32-line word -> bits of the lines that go).

    A line's key is the line without outer white space, ASCII letters lower-cased. Keys of at least
    ``least_chars`` code points found in at least ``least_docs`` documents keep their lines in the
    largest id only. Hashes are dealt to even ranges and sorted by hash, document (largest first) and
    position; a pass along each range sees the document that keeps the line first and drops the rest.
    A pass with bounded sketches names the hashes that would fill a range; their ranges are split by
    document and their totals (a row per named hash) joined afterwards.

    Null texts are one empty line. Rows without an id never count and lose nothing. Rows repeating an
    id are one document. Other columns are ignored.
    """
    spark = docs.sparkSession
    lines = _keyed(text_of(docs, id_col, text_col).where(F.col("id").isNotNull()), least_chars)
    ranges = 16 * shuffle_partitions(spark)
    # A sketch per group of tasks; a line with a share of all has that share in some group.
    group = F.pmod(F.spark_partition_id(), F.lit(shuffle_partitions(spark)))
    sketches = written(lines.groupBy(group.alias("part")).agg(
        F.expr(f"approx_top_k(h1, {HOT_LINES}, {16 * HOT_LINES})").alias("top"), F.count(F.lit(1)).alias("n")), "sketches")
    total = sketches.agg(F.sum("n")).first()[0] or 0
    frequent = sketches.select(F.explode("top").alias("t")).groupBy("t.item").agg(F.sum("t.count").alias("n")).where(
        (F.col("n") * ranges > total) & (F.col("n") >= least_docs))
    hot = [r["item"] for r in frequent.orderBy(F.desc("n")).limit(HOT_LINES).collect()]
    salt = F.when(F.col("h1").isin(hot), F.pmod(F.xxhash64("id"), F.lit(ranges)) + 1).otherwise(0)
    # 31 leading bits of the hash, scaled to the number of ranges: even without a sample.
    at = F.shiftrightunsigned("h1", 33) * ranges
    at = F.pmod(F.shiftright(at, 31) + F.col("salt"), F.lit(ranges)).cast("int")
    piece = Window.partitionBy("range", "h1", "h2", "salt")
    along = piece.orderBy(F.desc("id"), "pos")
    placed = (
        lines.withColumn("salt", salt.cast("int")).withColumn("range", at).repartition("range")
        .withColumns({"last": F.first("id").over(along), "before": F.lag("id").over(along)})
        .withColumn("n_docs", F.sum(F.when(F.col("before") == F.col("id"), 0).otherwise(1)).over(piece))
        .where(f"salt > 0 OR (n_docs >= {least_docs} AND id < last)")
    )
    repeated = written(placed.select("id", "pos", "h1", "h2", "salt", "last", "n_docs"), "lines")
    totals = (
        repeated.where("salt > 0").groupBy("h1", "h2", "salt").agg(F.max("last").alias("last"), F.max("n_docs").alias("n"))
        .groupBy("h1", "h2").agg(F.max("last").alias("hot_last"), F.sum("n").alias("hot_docs"))
    )
    split = (
        # At most a row per named hash (two hashes may share their first half).
        repeated.where("salt > 0").join(F.broadcast(totals), ["h1", "h2"])
        .where((F.col("hot_docs") >= least_docs) & (F.col("id") < F.col("hot_last")))
    )
    drops = repeated.where("salt = 0").select("id", "pos").unionByName(split.select("id", "pos")).distinct()
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % WORD)
    return (
        drops.groupBy("id", F.expr(f"pos div {WORD}").cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
        .groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "bits")))).alias("dropped"),
                           F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"))
    )


def kept_text(text: Column, dropped: Column) -> Column:
    """The text without the lines of a bitmap, joined by line feeds; unchanged where it is null."""
    def stays(line: Column, i: Column) -> Column:
        bits = F.coalesce(dropped[F.shiftright(i, WORD.bit_length() - 1)], F.lit(0).cast("long"))
        return F.call_function("shiftright", bits, i % WORD).bitwiseAND(1) == 0

    kept = F.filter(_lines(text), stays)
    return F.when(dropped.isNull(), text).otherwise(F.array_join(kept, "\n"))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the columns _dropped and _n_dropped. The bitmaps are stored and measured: small
    ones are broadcast, others meet the documents in a shuffle."""
    bitmaps = written(bitmaps.select(F.col("id").alias("_id"), F.col("dropped").alias("_dropped"),
                                     F.col("n_dropped").alias("_n_dropped")), "bitmaps")
    measured = bitmaps.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("_dropped")).alias("words")).first()
    side = checked_broadcast(bitmaps, measured["rows"] * 5 + (measured["words"] or 0), 24)
    return docs.join(side, docs[id_col] == side["_id"], "left").drop("_id")


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document."""
    texts = text_of(docs, id_col, text_col)
    joined = with_bitmaps(texts, line_bitmaps(docs, id_col=id_col, text_col=text_col, **limits), "id")
    return joined.select(
        F.col("id").alias("doc_id"), F.size(_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce("_n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        F.sha2(kept_text(F.col("text"), F.col("_dropped")), 256).alias("kept_sha256"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``docs`` with the same columns and rows, their texts without the lines that go."""
    joined = with_bitmaps(docs, line_bitmaps(docs, id_col=id_col, text_col=text_col, **limits), id_col)
    return joined.withColumn(text_col, kept_text(F.col(text_col), F.col("_dropped"))).select(*docs.columns)
