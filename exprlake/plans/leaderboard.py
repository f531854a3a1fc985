"""Leaderboards from long score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprlake.operators.aggregate import scope_expansion
from exprlake.operators.ranking import model_standing, rank_by, winner_counts


def leaderboard(scores: DataFrame, scope: str = "scope", term: str = "term", model: str = "model", metric: str = "auroc") -> DataFrame:
    """Per scope (and over all scopes): mean metric, terms, rank, and the number of terms won."""
    mean = scope_expansion(scores, [model], scope, {"mean_metric": F.avg(metric), "terms": F.count_distinct(term)})
    ranked = rank_by(mean, [scope], [F.col("mean_metric").desc()])
    standing = model_standing(scores, [scope, term], model, metric).select(model, "wins", "mean_rank")
    return ranked.join(standing, model)


def wide_board(scores: DataFrame, scopes: Sequence, scope: str = "scope", model: str = "model", metric: str = "auroc") -> DataFrame:
    return scores.groupBy(model).pivot(scope, list(scopes)).agg(F.avg(metric))


__all__ = ["leaderboard", "wide_board", "winner_counts"]
