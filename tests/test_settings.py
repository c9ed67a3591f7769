"""Registered queries run the whole job."""

from flowspark.operators import models, tuning
from flowspark.plans import jobs, queries
from flowspark.streaming import progress


def test_the_sweep_has_full_settings_and_all_folds(monkeypatch):
    seen = []

    class Frame:
        def cache(self):
            return self

        def unpersist(self):
            pass

    monkeypatch.setattr(queries, "_flow_table", lambda spark, sf: Frame())
    monkeypatch.setattr(jobs, "_features", lambda flows: flows)
    monkeypatch.setattr(jobs, "train_and_evaluate", lambda *a, folds, split_key: seen.append((a[1], a[3], folds)) or {})
    try:
        queries.ml20_algorithm_sweep(None, "")
    except (AttributeError, KeyError):  # no metrics to report
        pass
    assert seen == [(a, models.ONLINE_SETTINGS.get(a), tuning.FOLDS) for a in models.SUPERVISED]


def test_progress_is_of_every_batch(spark, sf, monkeypatch):
    # A query itself keeps its last 100 batches only.
    monkeypatch.setattr(progress, "progress_metrics", lambda *a: None)
    assert queries.str10_progress_metrics(spark, sf).count() > 0
