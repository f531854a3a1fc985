"""Model plug-ins: the protocol a user's model fulfils, and what each method supports."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@runtime_checkable
class ModelAdapter(Protocol):
    """Everything the library asks of a model; all results are DataFrames."""

    def feature_vectors(self, features: DataFrame) -> DataFrame:
        """(key, vec, is_fallback) for the given features."""

    def sample_vectors(self, profiles: DataFrame) -> DataFrame:
        """(sample_id, vec) for packed profiles."""

    def covered_features(self) -> DataFrame:
        """(feature) the model knows."""

    def provenance(self) -> dict[str, str]:
        """Where the model comes from."""


class FallbackError(ValueError):
    """Vectors made up by a fallback must not reach an evaluation."""


def refuse_fallback(vectors: DataFrame, flag: str = "is_fallback") -> DataFrame:
    """The vectors without their flag, or an error when any of them is a fallback."""
    if flag not in vectors.columns:
        return vectors
    if vectors.filter(F.coalesce(F.col(flag), F.lit(False))).first() is not None:
        raise FallbackError("embedding contains fallback vectors")
    return vectors.drop(flag)


def supported_work(requests: DataFrame, capability: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split requests by a (method, operation, supported, reason) table: what can run, and what cannot and why.

    A pair the table does not list is not supported.
    """
    j = requests.join(capability, ["method", "operation"], "left")
    ok = F.coalesce("supported", F.lit(False))
    refused = j.filter(~ok).withColumn("reason", F.coalesce("reason", F.lit("not listed")))
    return j.filter(ok).drop("supported", "reason"), refused.drop("supported")
