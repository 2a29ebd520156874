"""Versions of an embedding and cluster model on disk, so that a refresh can start from them alone."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml.feature import IDFModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators.embedding import HashedVectoriser

_VERSIONS = "version int, dimensions int, stop_words array<string>, label int, centre array<double>"


@dataclass(frozen=True)
class SavedModel:
    """A vectoriser, the centres its vectors belong to, and their version in the store."""

    vectoriser: HashedVectoriser
    centres: list[tuple[int, list[float]]]
    version: int

    def embed(self, df: DataFrame, text: str = "review") -> DataFrame:
        return self.vectoriser.transform(df, text)


def save_model(
    spark: SparkSession, path: str, vectoriser: HashedVectoriser, centres: Sequence[tuple[int, Sequence[float]]]
) -> int:
    """Adds a version and returns its number, from 1 up.

    Centres of another length than the vectors are refused. The term rarities are written first; the rows
    that name the version come last, so a version is there as a whole or not at all.
    """
    wrong = [label for label, centre in centres if len(centre) != vectoriser.dimensions]
    if wrong or not centres:
        raise ValueError(f"centres {wrong} do not have the {vectoriser.dimensions} dimensions of the vectors")
    version = max(versions(spark, path), default=0) + 1
    vectoriser.idf.write().overwrite().save(f"{path}/rarities-{version}")
    rows = [
        (version, vectoriser.dimensions, list(vectoriser.stop_words), int(label), [float(x) for x in centre])
        for label, centre in centres
    ]
    spark.createDataFrame(rows, _VERSIONS).coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return version


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_VERSIONS).parquet(f"{path}/versions")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def versions(spark: SparkSession, path: str) -> list[int]:
    table = _table(spark, path)
    return [] if table is None else sorted(r.version for r in table.select("version").distinct().collect())


def load_model(spark: SparkSession, path: str, version: int | None = None) -> SavedModel:
    """The given version, or the latest. A version that is not there is an error."""
    there = versions(spark, path)
    version = version or max(there, default=0)
    if version not in there:
        raise ValueError(f"no model version {version} below {path}")
    rows = _table(spark, path).filter(F.col("version") == version).collect()
    idf = IDFModel.load(f"{path}/rarities-{version}")
    vectoriser = HashedVectoriser(rows[0].dimensions, idf, tuple(rows[0].stop_words))
    return SavedModel(vectoriser, sorted((r.label, list(r.centre)) for r in rows), version)


def check_settings(model: SavedModel, vectoriser: HashedVectoriser) -> None:
    """Refuses a vectoriser whose vectors cannot be compared with the saved model's centres."""
    if model.vectoriser.settings != vectoriser.settings or list(model.vectoriser.idf.idf) != list(vectoriser.idf.idf):
        raise ValueError("the vectors have other settings than the model that this refresh was started with")
