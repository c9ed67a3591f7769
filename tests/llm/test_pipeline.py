from collections import Counter

import cases
import corpus_pipeline
import pytest

from flowspark.llm import lines, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, sf, name):
    import check

    _, problems = check.differences(spark, check.database(sf), name, sf)
    assert not problems


def test_stages_keep_what_is_clean(spark, tmp_path):
    docs = cases.frame(spark).repartition(3)
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
        if name == "quality_rules":
            # Prose stays; short, blank and repetitive texts go.
            assert {r.doc_id for r in docs.collect()} >= {1, 2, 3, 4, 8, 9, 10, 11, 12, 15, 18, *range(20, 32)}
            assert not {5, 6, 7, 13, 14, 19} & {r.doc_id for r in docs.collect()}
            quality = docs.collect()
        if name == "line_dedup":
            brute = lines.line_report(cases.frame(spark, [(r.doc_id, r.text) for r in quality]))
            assert Counter(cases.sha(r.text) for r in docs.collect()) == Counter(r.kept_sha256 for r in brute.collect())
        if name == "near_dedup":
            ids = {r.doc_id for r in docs.collect()}
            assert 1 in ids and not {2, 3, 4} & ids
    assert counts[0] == counts[1] > counts[2] and all(counts)


def test_pipeline_runs_on_an_empty_table(spark):
    docs = cases.frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
