"""Ordered operators that never put a whole group into one task.

A plain ``Window.partitionBy(model).orderBy(x)`` sorts all rows of a model in one task.
With three models that is a third of the data.  Here rows are range-partitioned on
(group, order), numbered once, and every later ordered operation works on blocks of
consecutive numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cpgloom.operators.sizing import sized
from cpgloom.session import materialize

BLOCK = 100_000


def numbered(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    rank: str = "rn",
    size: str | None = None,
) -> DataFrame:
    """Add the 1-based row number of each row in its group (and the group size).

    ``order`` should end in a unique key: it makes the numbering repeatable and lets the
    range partitioner cut through long runs of equal values.
    """
    group = list(group)
    keys = [F.col(g) for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    laid = materialize(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_slot", F.monotonically_increasing_id()),
        "numbered",
    ).withColumn("_part", F.shiftright("_slot", 33))
    # One row per (range, group): at most ranges + groups rows.
    runs = laid.groupBy("_part", *group).agg(F.min("_slot").alias("_first"), F.count("*").alias("_rows"))
    over_group = Window.partitionBy(*(group or [F.lit(0)]))
    runs = runs.select(
        "_part",
        *group,
        (F.sum("_rows").over(over_group.orderBy("_part")) - F.col("_rows") - F.col("_first") + 1).alias("_shift"),
        F.sum("_rows").over(over_group).alias("_size"),
    )
    out = _null_safe_join(laid, sized(runs), ["_part", *group])
    extra = [F.col("_size").alias(size)] if size else []
    return out.select(*df.columns, (F.col("_slot") + F.col("_shift")).alias(rank), *extra)


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = [left[k].eqNullSafe(right[f"_r_{k}"]) for k in keys]
    return left.join(right, cond, how).drop(*[f"_r_{k}" for k in keys])


# Rank error of the first estimate is 1 / SKETCH of a group; smaller groups are resolved fully.
SKETCH = 1000


def exact_quantiles(
    df: DataFrame, group: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str], count: str | None = None
) -> DataFrame:
    """Linear-interpolated quantiles per group without sorting the data.

    A mergeable sketch brackets every wanted position.  One aggregation then keeps the values
    inside the brackets with their counts and folds each stretch between brackets into a single
    counted row, so hot values and the bulk of the rows collapse map-side.  Positions are read off
    the running count of what remains.  Should a position fall outside its bracket, the same steps
    run again with brackets over the whole range.

    Nulls are ignored.  Groups without values are absent from the result.
    """
    keys = list(group) or ["_all"]
    rows = df.where(F.col(value).isNotNull())
    rows = rows.select(*[F.col(g) for g in group], *([] if group else [F.lit(0).alias("_all")]), F.col(value).cast("double").alias("_v"))
    for narrow in (True, False):
        found = materialize(_positions(rows, keys, [float(p) for p in probs], narrow), "quantiles")
        if not narrow or found.where("_missed").isEmpty():
            break
    cols = [F.col(f"_q{i}").alias(name) for i, name in enumerate(names)]
    return found.select(*group, *cols, *([F.col("_n").alias(count)] if count else []))


def _brackets(rows: DataFrame, keys: list[str], probs: list[float], narrow: bool) -> DataFrame:
    """Per group: size and, for each probability, a range of values that holds its position."""
    ends = [min(1.0, max(0.0, p + side * 2.0 / SKETCH)) for side in (-1, 1) for p in probs]
    aggs = [F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max")]
    if narrow:
        aggs.append(F.percentile_approx("_v", F.array(*[F.lit(e) for e in ends]), SKETCH).alias("_e"))
    out = rows.groupBy(*keys).agg(*aggs)
    small = F.col("_n") < 10 * SKETCH

    def edge(name: str, first: int):
        full = F.array_repeat(F.col(name), len(probs))
        return F.when(small, full).otherwise(F.slice("_e", first, len(probs))) if narrow else full

    return out.select(*keys, "_n", edge("_min", 1).alias("_lo"), edge("_max", len(probs) + 1).alias("_hi"))


def _positions(rows: DataFrame, keys: list[str], probs: list[float], narrow: bool) -> DataFrame:
    v = F.col("_v")
    ranged = _null_safe_join(rows, sized(_brackets(rows, keys, probs, narrow)), keys)
    inside = F.exists(F.arrays_zip("_lo", "_hi"), lambda b: (v >= b["_lo"]) & (v <= b["_hi"]))
    marked = ranged.select(*keys, "_n", "_v", inside.alias("_in"), F.size(F.filter("_lo", lambda x: x <= v)).alias("_zone"))
    # Values inside brackets keep themselves as key, the others only the gap they lie in.
    counted = (
        marked.groupBy(*keys, "_n", "_in", F.when(F.col("_in"), v).alias("_key"), F.when(~F.col("_in"), F.col("_zone")).alias("_gap"))
        .agg(F.count("*").alias("_c"), F.min("_v").alias("_v"))
        .drop("_key", "_gap")
    )
    order = [*keys, "_v"]
    laid = materialize(
        counted.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_slot", F.monotonically_increasing_id()), "squeezed"
    ).withColumn("_part", F.shiftright("_slot", 33))
    over_group = Window.partitionBy(*keys).orderBy("_part")
    runs = laid.groupBy("_part", *keys).agg(F.sum("_c").alias("_rows"))
    runs = runs.select("_part", *keys, (F.sum("_rows").over(over_group) - F.col("_rows")).alias("_before"))
    local = F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy("_slot"))
    placed = _null_safe_join(laid.withColumn("_local", local), sized(runs), ["_part", *keys])
    end = F.col("_before") + F.col("_local")
    start = end - F.col("_c")
    aggs = [F.max("_n").alias("_n")]
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(p)
        for tag, at in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            hit = F.col("_in") & (start <= at) & (at < end)
            aggs.append(F.max(F.when(hit, v)).alias(f"_{tag}{i}"))
    out = placed.groupBy(*keys).agg(*aggs)
    cols, missed = [], F.lit(False)
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(p)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        cols.append((lo + (hi - lo) * (h - F.floor(h))).alias(f"_q{i}"))
        missed = missed | lo.isNull() | hi.isNull()
    return out.select(*keys, "_n", *cols, missed.alias("_missed"))


def framed(
    rows: DataFrame,
    group: Sequence[str],
    rank: str,
    before: int,
    after: int,
    exprs: dict,
    block: int = BLOCK,
) -> DataFrame:
    """Evaluate fixed-width ``ROWS BETWEEN before AND after`` frames block by block.

    Rows within reach of a block edge are copied to the neighbouring block, so each window
    task sees at most ``block + before + after`` rows.  ``exprs`` maps an output name to a
    function of the window specification.
    """
    group = list(group)
    at = F.col(rank) - 1
    first = F.greatest(F.lit(0), F.expr(f"(`{rank}` - 1 - {after}) div {block}"))
    last = F.expr(f"(`{rank}` - 1 + {before}) div {block}")
    spread = rows.withColumn("_block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    win = Window.partitionBy(*group, "_block").orderBy(rank)
    out = spread.select("*", *[fn(win).alias(name) for name, fn in exprs.items()])
    return out.where(F.col("_block") == F.expr(f"(`{rank}` - 1) div {block}")).drop("_block").where(at >= 0)


def running(
    rows: DataFrame,
    group: Sequence[str],
    rank: str,
    value: str,
    out: str,
    how: str = "sum",
    block: int = BLOCK,
) -> DataFrame:
    """Running sum or minimum along ``rank``: totals per block first, then inside each block."""
    group = list(group)
    fold = {"sum": F.sum, "min": F.min}[how]
    rows = rows.withColumn("_block", F.expr(f"(`{rank}` - 1) div {block}"))
    per_block = rows.groupBy(*group, "_block").agg(fold(value).alias("_total"))
    prev = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    per_block = per_block.select(*group, "_block", fold("_total").over(prev).alias("_carry"))
    inner = Window.partitionBy(*group, "_block").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_local", fold(value).over(inner))
    joined = _null_safe_join(local, sized(per_block), [*group, "_block"], "left")
    if how == "sum":
        total = F.col("_local") + F.coalesce(F.col("_carry"), F.lit(0.0))
    else:
        total = F.least("_local", "_carry")
    return joined.withColumn(out, total).drop("_block", "_local", "_carry")


def average_ranks(df: DataFrame, group: Sequence[str], value: str, tie: Sequence[str], out: str) -> DataFrame:
    """Ranks where equal values share the mean of their positions.

    Positions of equal values are averaged by aggregation, so a value held by a third of the
    rows is combined before the shuffle; only values that really repeat are joined back.
    """
    group = list(group)
    rows = numbered(df, group, [value, *tie], "_rn")
    shared = (
        rows.groupBy(*group, value)
        .agg(F.avg("_rn").alias("_mean_rank"), F.count("*").alias("_c"))
        .where("_c > 1")
        .drop("_c")
    )
    return (
        rows.join(sized(shared), [*group, value], "left")
        .withColumn(out, F.coalesce("_mean_rank", F.col("_rn").cast("double")))
        .select(*df.columns, out)
    )
