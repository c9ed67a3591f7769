"""Personal data: base patterns, and terms whose co-occurrence with an entity gives it away."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import checked_broadcast, text_of, written

#: In the order in which spans of one start are listed. The last two are added by the method.
KINDS = ("email", "ip", "card", "phone", "term_removed", "term_generalised")
#: Written so that a scan takes time in proportion to the text: a run of digits is tried from its start only
#: and never given back, and an address is found from its @.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
_DIGIT = re.compile("[0-9]")

#: Words on either side of an entity that count as its context.
CONTEXT = 8
#: A term is generalised if its pointwise mutual information with an entity reaches this share of the
#: entity's information content, removed at ``REMOVE``; either needs ``SUPPORT`` documents together.
GENERALISE, REMOVE, SUPPORT = 0.8, 0.95, 2
#: Terms counted in a worker before they are handed on.
HELD_TERMS = 1 << 18


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        # What stands before a @ cannot be part of a later address's name.
        free = domain.end() if domain else at + 1
        if domain:
            out.append((start, free))
        at = text.find("@", free)
    return out


def _is_byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start, then kind; a match that fails is dropped."""
    spans = []
    if "@" in text:
        spans += [(start, end, "email") for start, end in emails(text)]
    if _DIGIT.search(text):
        spans += [(m.start(), m.end(), "ip") for m in IP.finditer(text)
                  if all(_is_byte(part) for part in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), m.end(), "card"))
        if "+" in text:
            spans += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text)
                      if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def span_list(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def entity_key(kind: str, value: str) -> int:
    """64 bits naming an entity: its kind and value, without case and, for numbers, separators."""
    value = value.lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", value)
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "big", signed=True)


def contexts(text: str, spans, terms, width: int = CONTEXT) -> set[tuple[int, str]]:
    """(entity, term) for the ``width`` terms on either side of each base span."""
    starts, out = [m.start() for m in terms], set()
    for start, end, kind in spans:
        at, entity = bisect_left(starts, start), entity_key(kind, text[start:end])
        out.update((entity, m[0].lower()) for m in terms[max(0, at - width):at + width])
    return out


def _outside(text: str, spans):
    """Terms that touch no span; the spans are sorted by start."""
    ends, far = [], 0
    for _, e, _ in spans:
        far = max(far, e)
        ends.append(far)
    starts = [s for s, _, _ in spans]
    terms = []
    for m in TERM.finditer(text):
        before = bisect_left(starts, m.end()) - 1
        if before < 0 or ends[before] <= m.start():
            terms.append(m)
    return terms


def found(docs: DataFrame, width: int = CONTEXT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans, a row per document, with a row number that is unique in the result. Where there are any,
    also their entities, contexts and all places of each term outside of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            out = []
            for i, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                spans = base_spans(text)
                terms = _outside(text, spans) if spans else []
                places: dict = {}
                for m in terms:
                    places.setdefault(m[0].lower(), []).append({"start": m.start(), "end": m.end()})
                out.append({
                    "row": row, "doc_id": i, "spans": [{"start": s, "end": e, "kind": k} for s, e, k in spans],
                    "entities": sorted({entity_key(k, text[s:e]) for s, e, k in spans}),
                    "contexts": [{"entity": e, "term": t} for e, t in sorted(contexts(text, spans, terms, width))],
                    "terms": [{"term": t, "at": at} for t, at in places.items()],
                })
                row += 1
            yield pa.RecordBatch.from_pylist(out, schema)

    place = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([
        ("row", pa.int64()), ("doc_id", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))),
        ("entities", pa.list_(pa.int64())),
        ("contexts", pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.string())]))),
        ("terms", pa.list_(pa.struct([("term", pa.string()), ("at", place)])))])
    return text_of(docs, id_col, text_col).mapInArrow(run, (
        "row long, doc_id long, spans array<struct<start: long, end: long, kind: string>>, entities array<long>, "
        "contexts array<struct<entity: long, term: string>>, "
        "terms array<struct<term: string, at: array<struct<start: long, end: long>>>>"))


def document_frequencies(docs: DataFrame, text_col: str = "text", held: int = HELD_TERMS) -> DataFrame:
    """(term, n): documents holding each term; counted in the workers before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()),
                                              pa.array(list(counts.values()), pa.int64())], ["term", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(set(TERM.findall(text.lower())))
                if len(counts) >= held:
                    yield flush()
        yield flush()

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def held_pairs(
    places: DataFrame, frequencies: DataFrame, n_docs: int, generalise: float = GENERALISE, support: int = SUPPORT,
) -> DataFrame:
    """(row, entity, term, at, n_term, n_entity): each document's pairs that may disclose, with all places of
    the term. Such a term stands in the context of the entity in ``support`` documents or more."""
    near = places.select(F.explode("contexts").alias("c")).groupBy("c.entity", "c.term").agg(F.count(F.lit(1)).alias("n"))
    entities = places.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    # n_both is at most n_entity, so that a term in more documents than this cannot reach the threshold.
    most = F.col("n_entity") * F.pow(float(n_docs) / F.col("n_entity"), F.lit(1 - generalise)) * (1 + 1e-9)
    pairs = written(
        near.where(F.col("n") >= support).drop("n").join(entities.where(F.col("n_entity") < n_docs), "entity")
        .join(frequencies.select("term", F.col("n").alias("n_term")), "term").where(F.col("n_term") <= most), "pairs")
    n = pairs.count()
    terms = places.where("size(spans) > 0").select("row", "entities", F.explode("terms").alias("t")).select("row", "entities", "t.*")
    terms = terms.join(checked_broadcast(pairs.select("term").distinct(), n, 32), "term", "left_semi")
    each = terms.select("row", F.explode("entities").alias("entity"), "term", "at")
    return written(each.join(checked_broadcast(pairs, n, 64), ["entity", "term"]), "held")


def disclosing_terms(held: DataFrame, n_docs: int, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(entity, term, disclosure, action) of the terms that tell too much.

    disclosure = PMI(term; entity) / IC(entity), where PMI = ln(n_both * N / (n_term * n_entity)) and
    IC = ln(N / n_entity), over whole documents; 1 means that the term occurs with the entity only.
    """
    content = F.log(F.lit(float(n_docs)) / F.col("n_entity"))
    pmi = F.log(F.col("n_both") * float(n_docs) / (F.col("n_term") * F.col("n_entity")))
    return (
        held.groupBy("entity", "term", "n_term", "n_entity").agg(F.count(F.lit(1)).alias("n_both"))
        .withColumn("disclosure", pmi / content).where(F.col("disclosure") >= generalise)
        .select("entity", "term", "disclosure",
                F.when(F.col("disclosure") >= remove, "term_removed").otherwise("term_generalised").alias("action"))
    )


def personal_data(
    docs: DataFrame, width: int = CONTEXT, generalise: float = GENERALISE, remove: float = REMOVE,
    support: int = SUPPORT, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Spans of personal data in every whole text: doc_id and ``spans``, an array of (start, end, kind)
    by start, then kind; code points, end exclusive.

    Base spans are those of the four patterns. Around each, up to ``width`` terms on either side are
    its context, and terms in the context of an entity in ``support`` documents or more are candidates.
    Counts of the documents with the term, the entity and both give how strongly a term reveals the entity;
    every place of a term beyond the thresholds, near or far, is a span in each document that holds the
    entity. A term that never stands near the entity is no candidate.

    Null texts are empty, empty texts have no spans; a null id stays null; repeated rows each count as
    a document; other columns are ignored. Only counts, keys and spans are shuffled, never texts.
    """
    places = written(found(docs, width, id_col, text_col), "places")
    n_docs = places.count()
    held = held_pairs(places, document_frequencies(docs, text_col), n_docs, generalise, support)
    risky = written(disclosing_terms(held, n_docs, generalise, remove), "disclosing")
    side = checked_broadcast(risky.select("entity", "term", "action"), risky.count(), 64)
    spots = held.join(side, ["entity", "term"]).select("row", "action", F.explode("at").alias("p"))
    added = spots.groupBy("row", F.col("p.start").alias("start"), F.col("p.end").alias("end")).agg(
        F.max("action").alias("kind")  # removal outweighs generalisation
    ).groupBy("row").agg(F.collect_list(F.struct("start", "end", "kind")).alias("more"))
    rank = F.array([F.lit(k) for k in KINDS])
    every = F.concat("spans", F.coalesce("more", F.array().cast("array<struct<start: long, end: long, kind: string>>")))
    keyed = F.transform(every, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    listed = F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return places.select("row", "doc_id", "spans").join(added, "row", "left").select("doc_id", listed.alias("spans"))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def span_report(docs: DataFrame, **settings) -> DataFrame:
    """Counts per kind, the digest of the base spans and all spans as text."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*KINDS[:4]))

    def text(of):
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return personal_data(docs, **settings).select(
        "doc_id", *[F.size(F.filter(spans, _is(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(text(base), 256).alias("base_sha256"), text(spans).alias("spans"))


def sanitised(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of ``personal_data`` replaced: entities by their kind, generalised terms by
    their shape, removed terms by nothing. Meets the spans by id in a shuffle; ids must be unique."""

    def start(columns):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = []
                for text, spans in zip(batch.column(columns.index(text_col)).to_pylist(),
                                       batch.column(len(columns)).to_pylist(), strict=True):
                    parts, at = [], 0
                    for s in spans or []:
                        if s["start"] >= at:
                            word = text[s["start"]:s["end"]]
                            shape = "<Name>" if word[0].isupper() else "<word>"
                            parts += [text[at:s["start"]], {"term_removed": "", "term_generalised": shape}.get(
                                s["kind"], f"<{s['kind']}>")]
                        at = max(at, s["end"])
                    texts.append(text if text is None else "".join(parts) + text[at:])
                arrays = [*batch.columns[:len(columns)]]
                arrays[columns.index(text_col)] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(arrays, columns)
        return run

    side = spans.select(F.col("doc_id").alias("_id"), F.col("spans").alias("_spans"))
    joined = docs.join(side, docs[id_col] == side["_id"], "left").select(*docs.columns, "_spans")
    return joined.mapInArrow(start(docs.columns), docs.schema)
