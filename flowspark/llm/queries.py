"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from flowspark.llm import (exact, lines, minhash, mixing, packing, patterns, pii, quality, repeats, tokens, toxicity, tries,
                           whitening)
from flowspark.llm.common import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query()
def op1_personal_data(spark, sf):
    return pii.span_report(table(spark, sf, "documents"))


#: The mixture of the registered query and of the pipeline: domains by source, and the weights of nodes;
#: others weigh 1.
CURATED = r"^src1[0-9]$"
MIX_WEIGHTS = {("curated",): 2.0, ("web",): 3.0, ("curated", "en"): 2.0, ("web", "en"): 2.0}


def domain_of_source():
    return F.when(F.col("source").rlike(CURATED), "curated").otherwise("web")


@query()
def op2_source_mixture(spark, sf):
    return mixing.mixture(table(spark, sf, "documents"), domain_of_source(), MIX_WEIGHTS)


@query(r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT doc_id, line, pos, r.key IS NOT NULL AND doc_id < last AS gone
    FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def op3_line_dedup(spark, sf):
    return lines.line_report(table(spark, sf, "documents"))


@query()
def op4_quality_rules(spark, sf):
    return quality.quality_report(table(spark, sf, "documents"))


@query()
def op5_toxicity(spark, sf):
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query()
def op6_retrieval_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op7_substring_dedup(spark, sf):
    return repeats.repeats(table(spark, sf, "documents"))


@query()
def op8_near_dedup(spark, sf):
    return minhash.near_duplicates(table(spark, sf, "documents"))


@query(r"""
WITH normal AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM normal WINDOW same AS (PARTITION BY norm)
""")
def op9_exact_dedup(spark, sf):
    return exact.exact_duplicates(table(spark, sf, "documents"))


@query()
def op10_token_counts(spark, sf):
    return tokens.count_tokens(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op11_pattern_packing(spark, sf):
    return patterns.pattern_pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query()
def op12_whitening(spark, sf):
    return whitening.whitening(table(spark, sf, "embeddings"))


#: CRC-32 of a decimal number: per digit an exclusive or, then eight shifts with the usual polynomial.
_CRC32 = """xor(list_reduce(flatten(list_transform(string_split({n}, ''), lambda c: [ascii(c) + 1, 0, 0, 0, 0, 0, 0, 0, 0])),
    lambda a, x: CASE WHEN x > 0 THEN xor(a, (x - 1)::BIGINT) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, 4294967295), 4294967295)"""


# Totals in another way than by contraction: each node counts along the path of its smallest member.
@query(rf"""
WITH turns AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 5 AS base, {_CRC32.format(n="c::VARCHAR")} % 9 AS h, count(*) AS size FROM turns GROUP BY c),
sizes AS (SELECT v.*, least(v.h, coalesce(b.size, 0)) AS taken FROM convs v LEFT JOIN convs b ON b.c = v.base),
rebuilt AS (
    SELECT v.c, t.pos + 1 AS depth, t.role, t.text FROM sizes v JOIN turns t ON t.c = v.base AND t.pos < v.h
    UNION ALL SELECT v.c, t.pos - v.h + v.taken + 1, t.role, t.text FROM sizes v JOIN turns t ON t.c = v.c AND t.pos >= v.h
    UNION ALL SELECT c, 0, '', '' FROM sizes),
keyed AS (SELECT c, depth, strlen(text) AS bytes, md5(string_agg(md5(length(role) || ':' || role || text), '')
        OVER (PARTITION BY c ORDER BY depth)) AS k, max(depth) OVER (PARTITION BY c) AS longest FROM rebuilt),
keys AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY depth) AS parent FROM keyed),
nodes AS (SELECT depth, k, min(c) AS conv_id, count(*) AS n_convs, min(parent) AS parent, min(bytes) AS bytes,
    string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (depth = longest) AS ends FROM keys GROUP BY depth, k),
kids AS (SELECT parent AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent),
full_nodes AS (SELECT n.*, coalesce(kids.n, 0) AS n_children FROM nodes n LEFT JOIN kids ON kids.k = n.k),
own AS (SELECT y.c, y.depth, y.k, coalesce((n.n_convs - 1) * n.bytes, 0) AS saved, coalesce((n.n_children = 0)::INT, 0) AS leaf
    FROM keys y LEFT JOIN full_nodes n ON n.conv_id = y.c AND n.depth = y.depth),
below AS (SELECT k, sum(saved) OVER down AS saved, sum(leaf) OVER down AS leaves FROM own
    WINDOW down AS (PARTITION BY c ORDER BY depth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
totals AS (SELECT k, sum(saved)::BIGINT AS saved_tokens, sum(leaves)::BIGINT AS n_leaves FROM below GROUP BY k)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, t.n_leaves, t.saved_tokens,
    sha256(coalesce(n.ends, '')) AS ends_sha256
FROM full_nodes n JOIN totals t ON t.k = n.k LEFT JOIN full_nodes p ON p.k = n.parent
""")
def op13_prefix_trie(spark, sf):
    return tries.prefix_trie(table(spark, sf, "conversations"))
