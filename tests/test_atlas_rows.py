"""The atlas queries keep no more neighbours than their later steps read."""

import pytest

from exprlake.operators import vectors
from exprlake.plans import atlas, catalog_atlas


@pytest.mark.parametrize("query", ["win11", "win13", "win15"])
def test_quotas_read_the_best_of_each_class_only(spark, small_dir, monkeypatch, query):
    asked = []
    own = vectors.exact_knn
    monkeypatch.setattr(atlas, "exact_knn", lambda q, r, k, *more, **named: asked.append(k) or own(q, r, k, *more, **named))
    got = getattr(catalog_atlas, query)(spark, small_dir)
    assert asked == [catalog_atlas.SETTINGS.top_k]
    near = catalog_atlas.near
    monkeypatch.setattr(catalog_atlas, "near", lambda s, d, per_class=None: near(s, d))
    whole = getattr(catalog_atlas, query)(spark, small_dir)
    assert asked[1:] == [catalog_atlas.SETTINGS.candidates]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
