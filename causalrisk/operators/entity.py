"""What an entity did before each of its rows, never looking at the row itself or later.

Per key six columns are added: rows before, mean and spread of their amounts,
this amount against that mean, seconds since the previous row, and rows in the
trailing day. Ties in time are ordered by the tie-break columns for all but the
trailing-day count, which leaves out rows of the same second.

The trailing-day count is a running total: every row is counted from its own
second on, and a stand-in that carries only its keys takes it off again when
the horizon has passed. So no window slides, and the cost is linear however many
rows an entity has in a day.

The ratio follows IEEE 754: against a mean of 0 it is infinite, or NaN for an
amount of 0. `plans.train` takes such a ratio as missing.

Keys nest: all windows of the ordinary rows share one exchange on the coarse
key. Keys with more rows than a task should hold are cut into time segments and
put together again from per-segment totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from causalrisk.operators.ordered import SEGMENT, in_segments, running_totals
from causalrisk.session import materialise
from causalrisk.spec import EntityKey

DAY = 86400
ROWS_PER_TASK = 20_000_000


def history_names(key: EntityKey) -> list[str]:
    return [f"{key.name}_{f}" for f in (
        "count_prior", "amt_mean_prior", "amt_std_prior", "amt_ratio", "secs_since_last", "txns_last_day",
    )]


def entity_history(
    df: DataFrame,
    keys: tuple[EntityKey, ...],
    time: str,
    amount: str,
    tie_break: tuple[str, ...],
    horizon: int = DAY,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add the six history columns of every key.

    `tie_break` must make the row order within a key unique.
    """
    parts = {c: f"_key_{c}" for k in keys for c in k.columns}
    stand_in = {c: k.missing for k in reversed(keys) for c in k.columns if k.missing is not None}
    work = df.withColumns({
        p: F.coalesce(F.col(c).cast("string"), F.lit(stand_in[c])) if c in stand_in else F.col(c)
        for c, p in parts.items()
    })
    order = [F.col(time), *map(F.col, tie_break)]
    coarse = [parts[c] for c in keys[0].columns]
    absent = _absent(keys[0])

    large = _large_keys(work, coarse, rows_per_task, absent)
    if large is None:
        out = _share_one_exchange(work, keys, parts, order, time, amount, horizon)
    else:
        match = [F.col(f"f.{c}").eqNullSafe(F.col(f"l.{c}")) for c in coarse]
        facts, listed = work.alias("f"), F.broadcast(large.alias("l"))
        ordinary = facts.join(listed, match, "left_anti")
        rest = facts.join(listed, match, "left_semi")
        for key in keys:
            # Each key reads its rows several times.
            rest = materialise(rest, "history")
            rest = _history_of_one_key(rest, key, parts, order, time, amount, horizon, rows_per_task)
        ordinary = _share_one_exchange(ordinary, keys, parts, order, time, amount, horizon)
        out = ordinary.unionByName(rest)
    return out.drop(*parts.values())


def _large_keys(rows: DataFrame, by: list[str], limit: int, absent: Column | None = None) -> DataFrame | None:
    """Key values with more than `limit` rows, and those without an entity; None if there are none.

    There are at most rows / limit of the first kind. The coarse key should be
    one column, so that a missing value is one row of the second kind.
    """
    missing = F.max(absent) if absent is not None else F.lit(0)
    found = (
        rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), missing.alias("_absent"))
        .filter((F.col("_n") > limit) | (F.col("_absent") == 1)).select(*by)
    )
    listed = found.collect()
    return rows.sparkSession.createDataFrame(listed, found.schema) if listed else None


def _absent(key: EntityKey) -> Column:
    """1 where the row has no entity under this key."""
    if key.missing is not None:
        return F.lit(0)
    return F.greatest(*[F.col(c).isNull().cast("int") for c in (*key.columns, key.columns[0])])


def amount_ratio(amount: Column, mean: Column) -> Column:
    """The amount against the mean, NULL where one is missing; by 0 as IEEE 754 divides."""
    return F.when(mean == 0, amount * F.lit(float("inf"))).otherwise(F.try_divide(amount, mean))


def _named(key: EntityKey, count: Column, mean: Column, std: Column, amount: Column, gap: Column,
           recent: Column) -> dict[str, Column]:
    made = [count, mean, std, amount_ratio(amount, mean), gap, recent]
    present = _absent(key) == 0
    return {name: F.when(present, c) for name, c in zip(history_names(key), made)}


def _share_one_exchange(df, keys, parts, order, time, amount, horizon) -> DataFrame:
    used = {*parts.values(), *[c for k in keys for c in k.columns]}
    real = F.col("_real")
    # Both kinds of rows come from one read, so a layout by key is kept.
    both = df.withColumn("_real", F.explode(F.array(F.lit(True), F.lit(False)))).select(
        *[F.col(c) if c in used else (F.col(time) + F.when(real, 0).otherwise(horizon)).cast(df.schema[c].dataType).alias(c) if c == time
          else F.when(real, F.col(c)).alias(c) for c in df.columns],
        "_real",
    )
    columns: dict[str, Column] = {}
    for key in keys:
        by = [parts[c] for c in key.columns]
        rows = Window.partitionBy(*by).orderBy(*order, real)
        before = rows.rowsBetween(Window.unboundedPreceding, -1)
        seconds_before = Window.partitionBy(*by).orderBy(time).rangeBetween(Window.unboundedPreceding, -1)
        columns |= _named(
            key,
            count=F.coalesce(F.sum(real.cast("int")).over(before), F.lit(0)).cast("int"),
            mean=F.avg(amount).over(before),
            std=F.stddev_pop(amount).over(before),
            amount=F.col(amount),
            gap=F.col(time) - F.last(F.when(real, F.col(time)), ignorenulls=True).over(before),
            recent=F.coalesce(F.sum(F.when(real, 1).otherwise(-1)).over(seconds_before), F.lit(0)),
        )
    return both.withColumns(columns).where(real).drop("_real")


def _history_of_one_key(df, key, parts, order, time, amount, horizon, rows_per_task) -> DataFrame:
    """History of one key where some of its values may be too large for one task."""
    by = [parts[c] for c in key.columns]
    nothing = F.lit(None)
    without = df.filter(_absent(key) == 1).withColumns({
        n: nothing.cast("int" if n.endswith("count_prior") else
                        "long" if n.endswith(("last", "last_day")) else "double")
        for n in history_names(key)
    })
    rows = df.filter(_absent(key) == 0)
    large = _large_keys(rows, by, rows_per_task)
    if large is None:
        return _share_one_exchange(rows, (key,), parts, order, time, amount, horizon).unionByName(without)
    small = _share_one_exchange(rows.join(F.broadcast(large), by, "left_anti").select(*rows.columns),
                                (key,), parts, order, time, amount, horizon)
    cut = in_segments(rows.join(F.broadcast(large), by, "left_semi").select(*rows.columns),
                      [*map(F.col, by), *order])
    return (
        small.unionByName(_segmented_history(cut, key, by, order, time, amount, horizon))
        .unionByName(without)
    )


def _segmented_history(cut: DataFrame, key, by, order, time, amount, horizon) -> DataFrame:
    """Windows inside (key, segment), completed with what earlier segments hold."""
    a = F.col(amount)
    totals = cut.groupBy(*by, SEGMENT).agg(
        F.count(F.lit(1)).alias("_rows"), F.count(a).alias("_n"), F.avg(a).alias("_mean"), F.sum(a).alias("_sum"),
        (F.var_pop(a) * F.count(a)).alias("_dev"), F.max(time).alias("_last"),
    )
    whole = Window.partitionBy(*by)
    earlier = whole.orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    # Deviations are taken around the key's overall mean to keep the sums small.
    centre = F.sum(F.col("_n") * F.col("_mean")).over(whole) / F.sum("_n").over(whole)
    shift = F.col("_mean") - F.col("_centre")
    carried = (
        totals.withColumn("_centre", centre)
        .withColumn("c_rows", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .withColumn("c_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumn("c_plain", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)))
        .withColumn("c_sum", F.coalesce(F.sum(F.col("_n") * shift).over(earlier), F.lit(0.0)))
        .withColumn("c_sq", F.coalesce(F.sum(F.col("_dev") + F.col("_n") * shift * shift).over(earlier), F.lit(0.0)))
        .withColumn("c_last", F.max("_last").over(earlier))
        .select(*by, SEGMENT, "_centre", "c_rows", "c_n", "c_plain", "c_sum", "c_sq", "c_last")
    )
    rows = Window.partitionBy(*by, SEGMENT).orderBy(*order)
    before = rows.rowsBetween(Window.unboundedPreceding, -1)
    # One row per key and second, and one more where it leaves the horizon.
    seconds = cut.groupBy(*by, time).agg(F.count(F.lit(1)).alias("_here"))
    left = seconds.select(*by, (F.col(time) + horizon).cast(cut.schema[time].dataType).alias(time), (-F.col("_here")).alias("_here"))
    running = running_totals(seconds.unionByName(left), time, {"_here": F.col("_here")}, tuple(by))
    recent = running.select(*by, time, (F.col("cum__here") - F.col("_here")).alias("_recent"))

    full = (
        cut.withColumn("l_rows", F.row_number().over(rows) - 1)
        .withColumn("l_n", F.count(a).over(before))
        .withColumn("l_plain", F.coalesce(F.sum(a).over(before), F.lit(0.0)))
        .withColumn("l_mean", F.avg(a).over(before))
        .withColumn("l_var", F.var_pop(a).over(before))
        .withColumn("l_prev", F.lag(time).over(rows))
        .join(F.broadcast(carried), [*by, SEGMENT])
        .join(recent, [*by, time])
    )
    l_shift = F.coalesce(F.col("l_mean") - F.col("_centre"), F.lit(0.0))
    n = F.col("c_n") + F.col("l_n")
    total = F.col("c_sum") + F.col("l_n") * l_shift
    squares = F.col("c_sq") + F.col("l_n") * (F.coalesce("l_var", F.lit(0.0)) + l_shift * l_shift)
    mean = F.try_divide(total, n)
    variance = F.greatest(F.try_divide(squares, n) - mean * mean, F.lit(0.0))
    named = _named(
        key,
        count=(F.col("c_rows") + F.col("l_rows")).cast("int"),
        # Not around the centre, so that a mean of 0 is exactly 0.
        mean=F.try_divide(F.col("c_plain") + F.col("l_plain"), n),
        std=F.when(n > 0, F.sqrt(variance)),
        amount=a,
        gap=F.col(time) - F.coalesce("l_prev", "c_last"),
        recent=F.col("_recent"),
    )
    keep = [c for c in cut.columns if c != SEGMENT]
    return full.select(*keep, *[c.alias(name) for name, c in named.items()])
