"""Corpus preparation: map features, collapse, check quality, keep common features, write shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprlake.operators.align import collapse_features
from exprlake.operators.clean import nonzero_in_every_group, sample_qc
from exprlake.operators.joins import one_to_one_orthologs
from exprlake.sources.sinks import write_shards


def prepare_corpus(raw: DataFrame, samples: DataFrame, idmap: DataFrame, min_detected: int, max_probability: float = 0.5) -> DataFrame:
    """Long counts ready to store: (sample_id, species, feature, value).

    ``raw`` holds (sample_id, feature, value); ``samples`` (sample_id, species,
    probability); ``idmap`` (src, dst). The filter on common features is a semi
    join in front of the only write, so no shard is written twice.
    """
    collapsed = collapse_features(raw, idmap)
    good = sample_qc(collapsed, samples.select("sample_id", "probability"), min_detected, max_probability)
    kept = collapsed.join(good.select("sample_id"), "sample_id", "left_semi").join(samples.select("sample_id", "species"), "sample_id")
    common = nonzero_in_every_group(kept, "species").select("feature")
    return kept.join(common, "feature", "left_semi")


def store_corpus(corpus: DataFrame, path: str, files_per_species: int = 8) -> None:
    write_shards(corpus, path, ["species"], files_per_species, ["sample_id"])


def ortholog_map(homology: DataFrame, source: str, target: str) -> DataFrame:
    """(src, dst) of one-to-one orthologs from (class, species, symbol)."""
    return one_to_one_orthologs(homology, source, target).select(F.upper("src").alias("src"), F.upper("dst").alias("dst"))
