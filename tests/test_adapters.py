import pytest

from exprlake.functions import adapters as ad


def test_fallback_is_refused(spark):
    good = spark.createDataFrame([("a", [1.0], False)], "key string, vec array<double>, is_fallback boolean")
    assert ad.refuse_fallback(good).columns == ["key", "vec"]
    bad = spark.createDataFrame([("a", [1.0], True)], "key string, vec array<double>, is_fallback boolean")
    with pytest.raises(ad.FallbackError):
        ad.refuse_fallback(bad)


def test_capabilities_split_work(spark):
    req = spark.createDataFrame([("m", "impute"), ("e", "impute"), ("x", "impute")], "method string, operation string")
    cap = spark.createDataFrame([("m", "impute", True, None), ("e", "impute", False, "embeddings only")], "method string, operation string, supported boolean, reason string")
    ok, refused = ad.supported_work(req, cap)
    assert [r["method"] for r in ok.collect()] == ["m"]
    assert {r["method"]: r["reason"] for r in refused.collect()} == {"e": "embeddings only", "x": "not listed"}


def test_protocol_is_checkable(spark):
    class Model:
        def feature_vectors(self, features): ...
        def sample_vectors(self, profiles): ...
        def covered_features(self): ...
        def provenance(self): ...

    assert isinstance(Model(), ad.ModelAdapter)
