"""Why a row got its score: additive contributions, strongest reasons, overall importance."""

from __future__ import annotations

from collections.abc import Collection

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from causalrisk.functions.fixed_values import LEAKAGE_HEALTHY, LEAKAGE_LIMIT, LEAKAGE_NOTHING, LEAKAGE_SUSPECT
from causalrisk.functions.text import shown_value
from causalrisk.operators.trees import compact_trees, tree_nodes, with_contributions

REASON = "array<struct<feature:string,value:double,shown:string,contribution:double>>"


def _own_value(df: DataFrame, feature: str, show: Collection[str] | None = None) -> tuple[Column, Column]:
    """The row's own value behind a model input, as a number (else NULL) and for a reader.

    The input of a level, `column=level`, stands for the column. Putting numbers into
    words costs most of a reason; with `show` only these columns are, others have NULL.
    """
    column = feature if feature in df.columns else feature.partition("=")[0]
    if column not in df.columns:
        raise ValueError(f"the rows don't carry `{column}`, which the reasons have to show")
    kind = dict(df.dtypes)[column]
    number = F.col(column).cast("double") if kind not in ("string", "date", "timestamp") else F.lit(None).cast("double")
    if show is not None and column not in show:
        return number, F.lit(None).cast("string")
    return number, shown_value(F.col(column), kind)


def own_values(df: DataFrame, names: list[str], show: Collection[str] | None = None) -> Column:
    """(n, v, t) of every model input: its name and the row's own value, as a number and for a reader."""
    return F.array(*[
        F.struct(F.lit(n).alias("n"), v.alias("v"), t.alias("t")) for n, (v, t) in zip(names, [_own_value(df, n, show) for n in names], strict=True)
    ])


def scorecard_reasons(weights: dict[str, tuple[float, float]], kinds: dict[str, str] | None = None) -> Column:
    """Reasons of a linear score: weight times distance from the reference value.

    `weights` maps a feature to (weight, reference), `kinds` to its type where it
    is not a double. A missing value counts as the reference and contributes
    nothing.
    """
    kinds = kinds or {}
    parts = [
        F.struct(
            F.lit(f).alias("feature"),
            F.col(f).cast("double").alias("value"),
            shown_value(F.col(f), kinds.get(f, "double")).alias("shown"),
            F.coalesce((F.col(f) - ref) * w, F.lit(0.0)).alias("contribution"),
        )
        for f, (w, ref) in weights.items()
    ]
    return F.array(*parts)


def linear_reasons(
    df: DataFrame, vector: str, names: list[str], weights: list[float], means: list[float], show: Collection[str] | None = None
) -> Column:
    """Reasons from an assembled vector; they and the base value add up to the margin.

    Contributions come from the vector's slots, shown values from the row's own
    columns, of those in `show` if given.
    """
    own = [_own_value(df, n, show) for n in names]
    slots = F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("w"), F.lit(float(m)).alias("m"), v.alias("value"), t.alias("shown"))
        for n, w, m, (v, t) in zip(names, weights, means, own)
    ])
    return F.zip_with(
        slots, vector_to_array(vector),
        lambda s, x: F.struct(
            s["name"].alias("feature"), s["value"].alias("value"), s["shown"].alias("shown"), (s["w"] * (x - s["m"])).alias("contribution")
        ),
    )


def training_means(model: PipelineModel, train: DataFrame) -> list[float]:
    """Means of the model's inputs on the rows it was fitted on; keep them with the model."""
    from pyspark.ml.stat import Summarizer

    return list(model.transform(train).agg(Summarizer.mean(F.col("features")).alias("m")).first().m.toArray())


def explain_baseline(
    model: PipelineModel, scored: DataFrame, names: list[str], means: list[float], show: Collection[str] | None = None
) -> tuple[DataFrame, float]:
    """`scored` with all reasons of the logistic model, and the base value of the margin.

    `means` are the `training_means`, so a row's reasons don't depend on the rows
    it is explained with. `scored` carries the raw columns behind `names`; with
    `show` only the values of these columns are put into words.
    """
    regression = model.stages[-1]
    weights = regression.coefficients.toArray()
    base = float(regression.intercept + weights @ np.asarray(means))
    return scored.withColumn("reasons", linear_reasons(scored, "features", names, list(weights), means, show)), base


def path_contributions(trees: list[dict[str, np.ndarray]], x: np.ndarray) -> tuple[np.ndarray, float]:
    """Per row and feature the change of the node value along each tree's path, and the base."""
    out = np.zeros(x.shape)
    base = 0.0
    rows = np.arange(len(x))
    for t in trees:
        base += float(t["value"][0])
        node = np.zeros(len(x), dtype=int)
        active = t["left"][node] >= 0
        while active.any():
            r, at = rows[active], node[active]
            feature = t["feature"][at]
            seen = x[r, feature]
            goes_left = seen <= t["number"][at]
            for i, members in t["sets"].items():
                here = at == i
                goes_left[here] = np.isin(seen[here], members)
            child = np.where(goes_left, t["left"][at], t["right"][at])
            out[r, feature] += t["value"][child] - t["value"][at]  # a row is at one node
            node[active] = child
            active = t["left"][node] >= 0
    return out, base


def explain_trees(model: PipelineModel, scored: DataFrame, names: list[str], show: Collection[str] | None = None) -> tuple[DataFrame, float]:
    """`scored` with the path reasons of the boosted trees; base + reasons = log-odds.

    `scored` carries the raw columns behind `names`; with `show` only the values
    of these columns are put into words.
    """
    spark = scored.sparkSession
    trees = compact_trees(tree_nodes(model, spark), list(model.stages[-1].treeWeights))
    shared = spark.sparkContext.broadcast(trees)
    rows = with_contributions(scored, lambda x: path_contributions(shared.value, x)[0])
    base = float(sum(t["value"][0] for t in trees))
    return rows.withColumn("reasons", tree_reasons(rows, names, show)).drop("_c"), base


def tree_reasons(rows: DataFrame, names: list[str], show: Collection[str] | None = None) -> Column:
    """Reasons from the contributions `_c` and the row's own values."""
    return F.zip_with(own_values(rows, names, show), F.col("_c"), lambda s, c: F.struct(
        s["n"].alias("feature"), s["v"].alias("value"), s["t"].alias("shown"), c.alias("contribution")))


def top_reasons(reasons: Column, k: int = 6) -> Column:
    """The `k` reasons of largest size; equal sizes by feature name."""
    keyed = F.transform(reasons, lambda r: F.struct(
        (-F.abs(r["contribution"])).alias("size"), r["feature"].alias("feature"),
        r["value"].alias("value"), r["shown"].alias("shown"), r["contribution"].alias("contribution"),
    ))
    return F.transform(F.slice(F.sort_array(keyed), 1, k), lambda r: F.struct(
        r["feature"].alias("feature"), r["value"].alias("value"), r["shown"].alias("shown"), r["contribution"].alias("contribution")
    ))


def direction(contribution: Column) -> Column:
    return F.when(contribution > 0, "increases risk").otherwise("decreases risk")


def reason_rows(df: DataFrame, id: str, reasons: str = "reasons") -> DataFrame:
    """(id, position, feature, value, contribution, direction), strongest first."""
    numbered = F.transform(reasons, lambda r, i: F.struct(
        (i + 1).alias("position"), r["feature"].alias("feature"), r["value"].alias("value"),
        r["contribution"].alias("contribution"), direction(r["contribution"]).alias("direction"),
    ))
    return df.select(id, F.inline(numbered))


def shown_reasons(df: DataFrame, id: str, reasons: str = "reasons", columns: Collection[str] | None = None) -> DataFrame:
    """(id, feature, shown): what a reader is told of each reason's value.

    With `columns` it is told once per row and column (levels of a column share
    its value), of these columns alone.
    """
    told = lambda r, f: F.struct(f.alias("feature"), r["shown"].alias("shown"))
    if columns is None:
        return df.select(id, F.inline(F.transform(reasons, lambda r: told(r, r["feature"]))))
    column = lambda r: F.substring_index(r["feature"], "=", 1)
    kept = F.filter(reasons, lambda r: column(r).isin(*columns))
    return df.select(id, F.inline(F.array_distinct(F.transform(kept, lambda r: told(r, column(r))))))


def global_importance(df: DataFrame, reasons: str = "reasons", top: int | None = None) -> DataFrame:
    """Mean absolute contribution per feature over all rows; only the `top` ones if given, for display."""
    ranked = (
        df.select(F.explode(reasons).alias("r"))
        .groupBy(F.col("r.feature").alias("feature"))
        .agg(F.avg(F.abs(F.col("r.contribution"))).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )
    return ranked.limit(top) if top else ranked


def leakage_audit(importance: DataFrame, limit: float = LEAKAGE_LIMIT) -> DataFrame:
    """Share of the strongest feature, the features above `limit`, and a verdict."""
    rows = importance.agg(
        F.sum("importance").alias("total"),
        F.sort_array(F.collect_list(F.struct((-F.col("importance")).alias("s"), "feature", "importance"))).alias("f"),
    )
    share = F.try_divide(F.col("f")[0]["importance"], F.col("total"))
    suspects = F.transform(
        F.filter("f", lambda r: F.try_divide(r["importance"], F.col("total")) > limit), lambda r: r["feature"]
    )
    return rows.select(
        F.when(F.col("total") > 0, F.col("f")[0]["feature"]).alias("top_feature"),
        F.when(F.col("total") > 0, share).alias("top_feature_share"),
        F.when(F.col("total") > 0, F.array_join(suspects, ", ")).otherwise("").alias("suspects"),
        F.when(F.coalesce(F.col("total"), F.lit(0.0)) <= 0, LEAKAGE_NOTHING)
        .when(F.size(suspects) > 0, LEAKAGE_SUSPECT).otherwise(LEAKAGE_HEALTHY).alias("verdict"),
    )
