"""Fitted value maps as `pyspark.ml` stages: they stand in a Pipeline, are saved with it, and keep their map as Parquet.

A map gives a number for each value of a column; missing and unseen values have
numbers of their own. Maps of any number of levels are applied by a join, which
is broadcast while a column's levels are few and short.
"""

from __future__ import annotations

from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, functions as F

from causalrisk.operators.encode import BROADCAST_BYTES, BROADCAST_LEVELS, fit_frequencies
from causalrisk.operators.unpivot import as_text, long_form
from causalrisk.session import materialise

#: Rows of prior knowledge that a level's statistic starts from, and parts of the training rows.
SMOOTHING, FOLDS = 20.0, 5


def look_up(df: DataFrame, key: Column, table: DataFrame, output: str, otherwise: Column) -> DataFrame:
    """`df` with the number that `table` (key, number) has for `key` (text); `otherwise` where it has none.

    NULL keys get random stand-ins where the join shuffles, so they meet in many tasks.
    """
    size = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("key") + 16), F.lit(0)).alias("bytes")).first()
    found = table.select(F.concat(F.lit("v"), F.col("key")).alias("_key"), F.col("number").alias("_number"))
    on = F.concat(F.lit("v"), key)
    if size.n <= BROADCAST_LEVELS and size.bytes <= BROADCAST_BYTES:
        found = F.broadcast(found)
    else:
        on = F.coalesce(on, F.concat(F.lit("n"), F.pmod(F.xxhash64(*df.columns), F.lit(1 << 20)).cast("string")))
    joined = df.withColumn("_on", on).join(found, F.col("_on") == F.col("_key"), "left")
    return joined.withColumn(output, F.coalesce("_number", otherwise)).drop("_on", "_key", "_number")


class _MapWriter(MLWriter):
    def __init__(self, instance: ValueMapModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.table.write.mode("overwrite").parquet(f"{path}/table")


class _MapReader(MLReader):
    def __init__(self, cls: type) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> ValueMapModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        made = self.cls()
        made._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(made, metadata)
        made.table = self.sparkSession.read.parquet(f"{path}/table")
        return made


class ValueMapModel(Model, HasInputCols, HasOutputCols, MLReadable, MLWritable):
    """`table`: (column, kind, key, number) with kind `value`, or `missing` and `unseen` with a NULL key."""

    def __init__(self, table: DataFrame | None = None) -> None:
        super().__init__()
        self.table = table

    def write(self) -> MLWriter:
        return _MapWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _MapReader(cls)

    def _transform(self, df: DataFrame) -> DataFrame:
        # Two rows per column.
        other = {(r["column"], r.kind): r.number for r in self.table.where("kind != 'value'").collect()}
        out = df
        for c, name in zip(self.getInputCols(), self.getOutputCols(), strict=True):
            unseen = F.lit(other.get((c, "unseen"), 0.0))
            if c not in df.columns:
                out = out.withColumn(name, unseen)
                continue
            value = as_text(df, c)
            table = self.table.where((F.col("kind") == "value") & (F.col("column") == c)).select("key", "number")
            otherwise = F.when(F.col(c).isNull(), F.lit(other.get((c, "missing"), 0.0))).otherwise(unseen)
            out = look_up(out, value, table, name, otherwise)
        return out


class FrequencyMap(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """How common a value is among the non-null training rows; missing and unseen ones have 0."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCols: list[str] | None = None) -> None:
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> ValueMapModel:
        table = fit_frequencies(df, self.getInputCols()).select("column", F.lit("value").alias("kind"), F.col("value").alias("key"), F.col("freq").alias("number"))
        return self._copyValues(ValueMapModel(materialise(table, "frequency-map")))


class TargetStatistics(Estimator, HasInputCols, HasOutputCols, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Positive rate of each level, drawn towards the overall rate by `smoothing` rows; a missing value is a level, an unseen one has the overall rate.

    Levels of any number keep their order for trees. Training rows must not see
    their own label: `fit_out_of_fold` gives each row the rates of the other
    folds, where a row's fold is a hash of the row, so that equal rows share one.
    """

    smoothing = Param(Params._dummy(), "smoothing", "rows of prior knowledge", TypeConverters.toFloat)
    folds = Param(Params._dummy(), "folds", "parts of the training rows", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCols: list[str] | None = None, labelCol: str = "label",
                 smoothing: float = SMOOTHING, folds: int = FOLDS) -> None:
        super().__init__()
        self._setDefault(smoothing=SMOOTHING, folds=FOLDS)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _in_folds(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_fold", F.pmod(F.xxhash64(*[c for c in df.columns if c != self.getLabelCol()]), F.lit(self.getOrDefault(self.folds))).cast("int"))

    def _counts(self, rows: DataFrame) -> DataFrame:
        """(column, key, _fold, n, k) of all levels, a NULL key for missing."""
        long = long_form(rows, self.getInputCols(), "string", keep=("_fold", self.getLabelCol()))
        sums = [F.count(F.lit(1)).alias("n"), F.sum(F.col(self.getLabelCol()).cast("double")).alias("k")]
        return materialise(long.groupBy("column", F.col("value").alias("key"), "_fold").agg(*sums), "target-counts")

    def _rate(self, n: Column, k: Column, prior: Column) -> Column:
        m = F.lit(self.getOrDefault(self.smoothing))
        return (k + m * prior) / (n + m)

    def _model(self, counts: DataFrame) -> ValueMapModel:
        levels = counts.groupBy("column", "key").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        # One row per column.
        total = levels.groupBy("column").agg((F.sum("k") / F.sum("n")).alias("prior"))
        rated = levels.join(F.broadcast(total), "column").select(
            "column", F.when(F.col("key").isNull(), "missing").otherwise("value").alias("kind"), "key", self._rate(F.col("n"), F.col("k"), F.col("prior")).alias("number")
        )
        none = F.lit(None).cast("string")
        unseen = total.select("column", F.lit("unseen").alias("kind"), none.alias("key"), F.col("prior").alias("number"))
        without = total.join(levels.where("key is null").select("column"), "column", "left_anti")
        missing = without.select("column", F.lit("missing").alias("kind"), none.alias("key"), F.col("prior").alias("number"))
        return self._copyValues(ValueMapModel(materialise(rated.unionByName(unseen).unionByName(missing), "target-map")))

    def _fit(self, df: DataFrame) -> ValueMapModel:
        return self._model(self._counts(self._in_folds(df)))

    def fit_out_of_fold(self, df: DataFrame) -> tuple[ValueMapModel, DataFrame]:
        """The model for other rows, and the training rows with the statistics of the folds they are not in."""
        rows = self._in_folds(df)
        counts = self._counts(rows)
        per_fold = counts.groupBy("column", "_fold").agg(F.sum("n").alias("fn"), F.sum("k").alias("fk"))
        whole = per_fold.groupBy("column").agg(F.sum("fn").alias("an"), F.sum("fk").alias("ak"))
        # One row per column and fold.
        prior = per_fold.join(F.broadcast(whole), "column").select("column", "_fold", F.coalesce(F.try_divide(F.col("ak") - F.col("fk"), F.col("an") - F.col("fn")), F.lit(0.0)).alias("prior"))
        levels = counts.groupBy("column", "key").agg(F.sum("n").alias("an"), F.sum("k").alias("ak"))
        level = F.col("c.key").eqNullSafe(F.col("l.key")) & (F.col("c.column") == F.col("l.column"))
        others = counts.alias("c").join(levels.alias("l"), level).select(
            "c.column", "c.key", "c._fold", (F.col("an") - F.col("n")).alias("n"), (F.col("ak") - F.col("k")).alias("k")
        ).join(F.broadcast(prior), ["column", "_fold"])
        rated = materialise(others.select("column", "key", "_fold", self._rate(F.col("n"), F.col("k"), F.col("prior")).alias("number")), "out-of-fold")
        # As many numbers as columns times folds.
        missing = {(r["column"], r["_fold"]): r.number for r in rated.where("key is null").collect()}
        out = rows
        for c, name in zip(self.getInputCols(), self.getOutputCols(), strict=True):
            table = rated.where((F.col("column") == c) & F.col("key").isNotNull()).select(F.concat_ws("|", F.col("_fold").cast("string"), "key").alias("key"), "number")
            nulls = reduce(lambda w, i: w.when(F.col("_fold") == i, missing.get((c, i), 0.0)), range(1, self.getOrDefault(self.folds)),
                           F.when(F.col("_fold") == 0, missing.get((c, 0), 0.0)))
            value = as_text(df, c)
            key = F.when(value.isNotNull(), F.concat_ws("|", F.col("_fold").cast("string"), value))
            out = look_up(out, key, table, name, nulls)
        return self._model(counts), out.drop("_fold")
