"""Running totals, ranks and exact quantiles over a global order.

A window without a partition key pulls a whole table into one task, and a
window over a key pulls that key. Both are avoided in the same way: sort the
rows by range into segments of about equal size, run the window inside each
segment, and add what the earlier segments hold. Segment boundaries may fall
inside a group, so a group of any size is spread over many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from causalrisk.session import materialise

SEGMENT = "_segment"
ALL = "_all"


def in_segments(df: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """`df` with a segment number that increases along `order`.

    The result is written before use: range boundaries come from a sample, so
    the number is only the same for every reader once it is stored.
    """
    spread = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    return materialise(spread.withColumn(SEGMENT, F.spark_partition_id()), "segments")


def running_totals(
    df: DataFrame,
    order: str,
    measures: dict[str, Column],
    by: tuple[str, ...] = (),
    descending: bool = False,
) -> DataFrame:
    """One row per distinct `order` value with each measure's group, running and total sum.

    `measures` maps a name to a per-row number. The result has `name`,
    `cum_name` (this value and those before it) and `tot_name` (whole `by`
    group). Rows with a NULL order value are left out. Equal values are summed
    before the sort, so ties never cost more than one row.
    """
    keys = [*by] or [ALL]
    rows = df if by else df.withColumn(ALL, F.lit(0))
    collapsed = (
        rows.filter(F.col(order).isNotNull())
        .groupBy(*keys, order)
        .agg(*[F.sum(m).alias(name) for name, m in measures.items()])
    )
    ordering = F.col(order).desc() if descending else F.col(order).asc()
    segments = in_segments(collapsed, [*map(F.col, keys), ordering])

    inside = Window.partitionBy(*keys, SEGMENT).orderBy(ordering).rowsBetween(Window.unboundedPreceding, 0)
    local = segments.withColumns({f"cum_{m}": F.sum(m).over(inside) for m in measures})
    offsets = segment_offsets(segments, keys, list(measures))
    joined = local.join(F.broadcast(offsets), [*keys, SEGMENT])
    return joined.select(
        *by,
        order,
        *measures,
        *[(F.col(f"cum_{m}") + F.col(f"before_{m}")).alias(f"cum_{m}") for m in measures],
        *[f"tot_{m}" for m in measures],
    )


def segment_offsets(segments: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Per (keys, segment): sums of the earlier segments and of the whole group.

    Segments are contiguous in (keys, order), so there are at most as many rows
    as segments plus groups, which is what makes the broadcast safe.
    """
    earlier = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    sums = segments.groupBy(*keys, SEGMENT).agg(*[F.sum(m).alias(m) for m in measures])
    return sums.select(
        *keys,
        SEGMENT,
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"before_{m}") for m in measures],
        *[F.sum(m).over(whole).alias(f"tot_{m}") for m in measures],
    )


def with_row_index(df: DataFrame, order: list[Column], index: str = "row_index") -> DataFrame:
    """`df` with a zero-based position in the global `order` and the row count in `rows`."""
    segments = in_segments(df.withColumn(ALL, F.lit(0)), order)
    one = segments.withColumn("_n", F.lit(1).cast("long"))
    offsets = segment_offsets(one, [ALL], ["_n"]).drop(ALL)
    inside = Window.partitionBy(SEGMENT).orderBy(*order)
    return (
        segments.withColumn(index, F.row_number().over(inside).cast("long") - 1)
        .join(F.broadcast(offsets), SEGMENT)
        .withColumn(index, F.col(index) + F.col("before__n"))
        .withColumn("rows", F.col("tot__n"))
        .drop(SEGMENT, ALL, "before__n", "tot__n")
    )


def exact_quantiles(
    df: DataFrame, column: str, probs: list[float], by: tuple[str, ...] = ()
) -> DataFrame:
    """(by..., prob, value): linearly interpolated quantiles, exact at any size.

    The wanted ranks are first located in a segment by the segment counts, then
    only the rows at those ranks are read out.
    """
    keys = [*by] or [ALL]
    rows = df if by else df.withColumn(ALL, F.lit(0))
    counts = (
        rows.filter(F.col(column).isNotNull())
        .groupBy(*keys, column)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    segments = in_segments(counts, [*map(F.col, keys), F.col(column).asc()])
    offsets = segment_offsets(segments, keys, ["n"]).join(
        segments.groupBy(*keys, SEGMENT).agg(F.sum("n").alias("here")), [*keys, SEGMENT]
    )
    position = F.col("prob") * (F.col("tot_n") - 1)
    wanted = (
        offsets.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("low", F.floor(position))
        .withColumn("part", position - F.floor(position))
        .withColumn("high", F.least(F.col("low") + 1, F.col("tot_n") - 1))
        .select(*keys, SEGMENT, "before_n", "here", "prob", "part", F.inline(F.array(
            F.struct(F.lit(0).alias("side"), F.col("low").alias("rank")),
            F.struct(F.lit(1).alias("side"), F.col("high").alias("rank")),
        )))
        .filter((F.col("rank") >= F.col("before_n")) & (F.col("rank") < F.col("before_n") + F.col("here")))
        .drop("here")
    )
    inside = Window.partitionBy(*keys, SEGMENT).orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("before_n") + F.col("cum")
    return (
        segments.withColumn("cum", F.sum("n").over(inside))
        .join(F.broadcast(wanted), [*keys, SEGMENT])
        .filter((F.col("rank") < end) & (F.col("rank") >= end - F.col("n")))
        .groupBy(*by, "prob")
        .agg(
            F.max(F.when(F.col("side") == 0, F.col(column))).alias("_low"),
            F.max(F.when(F.col("side") == 1, F.col(column))).alias("_high"),
            F.max("part").alias("_part"),
        )
        .select(*by, "prob", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias("value"))
    )


def quantile_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    """Distinct edges of `bins` equal-count bins, as numbers on the driver."""
    probs = [i / bins for i in range(bins + 1)]
    return sorted({r.value for r in exact_quantiles(df, column, probs).collect()})


def count_above(column: Column, edges: list[float], inclusive: bool) -> Column:
    """How many of the (few, sorted) `edges` the value exceeds, or reaches if `inclusive`."""
    passed = [(column >= e) if inclusive else (column > e) for e in map(F.lit, edges)]
    return reduce(lambda total, p: total + p.cast("int"), passed, F.lit(0))
