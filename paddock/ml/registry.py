"""Model store: saved models, their metrics and the promotion rule."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.operators.reshape import top_k
from paddock.schemas import TABLES


def promote(registry: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates with promotion_basis and promoted.

    A candidate replaces production when there is none or its error is strictly lower.
    Without holdout rows its cross-validated error stands in (basis ``cv_only``).
    """
    production = top_k(registry.filter("promoted"), ["model_name"], [F.desc("version")], 1).select(
        "model_name",
        F.coalesce("holdout_mae", "cv_mae").alias("_current"),
    )
    mae = F.coalesce("holdout_mae", "cv_mae")
    return candidates.join(production, "model_name", "left").select(
        *candidates.columns,
        F.when(F.col("holdout_mae").isNull(), "cv_only").otherwise("holdout").alias("promotion_basis"),
        F.coalesce(F.col("_current").isNull() | (mae < F.col("_current")), F.lit(False)).alias("promoted"),
    )


class ModelStore:
    """Models under ``root``/models, metrics appended to ``root``/registry."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def registry(self) -> DataFrame:
        empty = self.spark.createDataFrame([], TABLES["model_registry"])
        empty.write.mode("append").parquet(f"{self.root}/registry")
        return self.spark.read.schema(TABLES["model_registry"]).parquet(f"{self.root}/registry")

    def save(self, name: str, version: str, model: PipelineModel | DataFrame) -> str:
        """Save a fitted pipeline, or a table that serves as a model."""
        path = f"{self.root}/models/{name}/{version}"
        if isinstance(model, DataFrame):
            model.write.mode("overwrite").parquet(path)
        else:
            model.write().overwrite().save(path)
        return path

    def publish(
        self, version: str, models: dict[str, tuple[PipelineModel | DataFrame, float | None, float | None]]
    ) -> DataFrame:
        """Save {name: (model, holdout_mae, cv_mae)}, decide promotion, append to the registry."""
        rows = [
            (name, version, holdout, cv, self.save(name, version, model))
            for name, (model, holdout, cv) in models.items()
        ]
        candidates = self.spark.createDataFrame(
            rows, "model_name string, version string, holdout_mae double, cv_mae double, path string"
        )
        decided = promote(self.registry(), candidates).select(
            "model_name", "version", "holdout_mae", "cv_mae", "promotion_basis", "path", "promoted"
        )
        decided.write.mode("append").parquet(f"{self.root}/registry")
        return self.registry().filter(F.col("version") == version)

    def _production_path(self, name: str) -> str | None:
        row = (
            self.registry().filter((F.col("model_name") == name) & F.col("promoted"))
            .orderBy(F.desc("version")).select("path").first()
        )
        return None if row is None else row["path"]

    def production(self, name: str) -> PipelineModel | None:
        """Newest promoted model of a name."""
        path = self._production_path(name)
        return None if path is None else PipelineModel.load(path)

    def production_table(self, name: str) -> DataFrame | None:
        """Newest promoted table of a name."""
        path = self._production_path(name)
        return None if path is None else self.spark.read.parquet(path)
