"""A clustering that is fitted once, stored, and applied to later years (SNK-07 + ML-03 + ML-05).

An MLlib ``Pipeline``: mode imputation -> population scaling -> PCA -> k-means. The first two are
stages of this library (MLlib's scaler divides by the sample deviation); each keeps a few numbers
per column. All stages are saved by ``PipelineModel.save`` and read by ``PipelineModel.load``, so a
new year is classed without a new fit and without the rows of the earlier ones.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.operators import clean, cluster


class _Columns(HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Columns that a stage reads and replaces."""

    def __init__(self, cols: list[str] | None = None):
        super().__init__()
        if cols is not None:
            self._set(inputCols=cols)


class ModeImputer(_Columns, Estimator):
    """IMP-02: NULL -> the column's mode over the fitted rows (no value at all: 0)."""

    def _fit(self, dataset: DataFrame) -> "FillNulls":
        cols = self.getInputCols()
        modes = clean.fit_modes(dataset, cols)
        return FillNulls(cols, [float(modes[c] if modes[c] is not None else 0) for c in cols])


class FillNulls(_Columns, Model):
    fills = Param(Params._dummy(), "fills", "value for NULL, per column", TypeConverters.toListFloat)

    def __init__(self, cols: list[str] | None = None, fills: list[float] | None = None):
        super().__init__(cols)
        if fills is not None:
            self._set(fills=fills)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        pairs = zip(self.getInputCols(), self.getOrDefault(self.fills))
        return dataset.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in pairs})


class PopulationScaler(_Columns, Estimator):
    """ML-01: mean 0 and population deviation 1 over the fitted rows (constant columns: deviation 1)."""

    def _fit(self, dataset: DataFrame) -> "Scale":
        cols = self.getInputCols()
        fitted = cluster.fit_standard(dataset, cols)
        return Scale(cols, [float(fitted[c][0]) for c in cols], [float(fitted[c][1]) for c in cols])


class Scale(_Columns, Model):
    means = Param(Params._dummy(), "means", "mean per column", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "deviation per column", TypeConverters.toListFloat)

    def __init__(self, cols: list[str] | None = None, means: list[float] | None = None,
                 deviations: list[float] | None = None):
        super().__init__(cols)
        if means is not None and deviations is not None:
            self._set(means=means, deviations=deviations)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        fitted = zip(self.getOrDefault(self.means), self.getOrDefault(self.deviations))
        return cluster.standard_scale(dataset, self.getInputCols(), dict(zip(self.getInputCols(), fitted)))


def cluster_pipeline(cols: list[str], n: int, k: int, seed: int, name: str = "CLASS") -> Pipeline:
    """The unfitted stages: ``cols`` imputed and scaled, ``n`` components (column ``pc``), ``k`` classes."""
    return Pipeline(stages=[
        ModeImputer(cols), PopulationScaler(cols),
        VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="error"),
        PCA(k=n, inputCol="features", outputCol="pc"),
        KMeans(k=k, seed=seed, featuresCol="pc", predictionCol=name)])


def holds_nearest(classed: DataFrame, centres: list[list[float]], name: str = "CLASS") -> Column:
    """Whether the class of each row is that of its nearest centre (``classed`` has the column ``pc``)."""
    xs = vector_to_array(F.col("pc"))
    cents = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres])
    d2 = lambda m: F.aggregate(F.zip_with(xs, m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return d2(F.element_at(cents, F.col(name) + 1)) <= F.array_min(F.transform(cents, d2)) + 1e-9
