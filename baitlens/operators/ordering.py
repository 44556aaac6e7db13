"""Global order without a one-task window: range partitions, pinned, then offsets from a small table.

``group_by`` is meant for bounded sets (models, folds, labels, columns); the offsets table holds one row per
group and partition and is broadcast only after its size was counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, discard, materialise, reliable_checkpoint

SKETCH_ACCURACY = 10_000


def _as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pin_order(df: DataFrame, order_by: Sequence[str | Column], group_by: Sequence[str] = ()) -> DataFrame:
    """Rows range-partitioned and sorted, with ``_part`` and ``_seq`` fixed by a reliable checkpoint."""
    keys = [F.col(g) for g in group_by] + [_as_column(c) for c in order_by]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return reliable_checkpoint(
        ranged.withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()})
    )


def _null_safe(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    condition = F.lit(True)
    for n in names:
        condition = condition & left[n].eqNullSafe(right[f"_o_{n}"])
    return condition


def _with_offsets(pinned: DataFrame, offsets: DataFrame, group_by: Sequence[str]) -> DataFrame:
    names = [*group_by, "_part"]
    small = broadcast_if_small(offsets.withColumnsRenamed({n: f"_o_{n}" for n in names}))
    return pinned.join(small, _null_safe(pinned, small, names)).drop(*[f"_o_{n}" for n in names])


def with_rank(df: DataFrame, order_by: Sequence[str | Column], name: str = "rank", group_by: Sequence[str] = (),
              total: str | None = None) -> DataFrame:
    """1-based position in the order (inside each group); make the last order column unique."""
    pinned = pin_order(df, order_by, group_by)
    before = Window.partitionBy(*group_by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*group_by)
    counts = (
        pinned.groupBy(*group_by, "_part").agg(F.min("_seq").alias("_rank_first"), F.count("*").alias("_rank_n"))
        .withColumn("_rank_before", F.coalesce(F.sum("_rank_n").over(before), F.lit(0)))
    )
    extra = []
    if total:
        counts = counts.withColumn(total, F.sum("_rank_n").over(everything))
        extra = [total]
    ranked = _with_offsets(pinned, counts, group_by)
    position = F.col("_seq") - F.col("_rank_first") + F.col("_rank_before") + 1
    return ranked.select(*df.columns, position.alias(name), *extra)


def numbered(df: DataFrame, order_by: Sequence[str | Column], name: str, keep: Sequence[str] | None = None) -> DataFrame:
    """1-based position in the order, for whole tables: the ordered rows (columns ``keep``) are stored once as packed columns.

    What the sort shuffled is released before the rows are read.
    """
    keys = [_as_column(c) for c in order_by]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    kept = list(df.columns if keep is None else keep)
    stored = materialise(ranged.select(*kept, F.monotonically_increasing_id().alias("_seq")), "numbered", "zstd")
    del ranged
    discard(df.sparkSession)
    # the number of the partition stands above the lower 33 bits
    stored = stored.withColumn("_part", F.shiftright("_seq", 33).cast("int"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    counts = stored.groupBy("_part").agg(F.min("_seq").alias("_rank_first"), F.count("*").alias("_rank_n")).withColumn(
        "_rank_before", F.coalesce(F.sum("_rank_n").over(before), F.lit(0)))
    ranked = _with_offsets(stored, materialise(counts, "numbered-parts"), ())
    return ranked.select(*kept, (F.col("_seq") - F.col("_rank_first") + F.col("_rank_before") + 1).alias(name))


def with_running_sums(df: DataFrame, order_by: Sequence[str | Column], sums: dict[str, str],
                      group_by: Sequence[str] = (), next_of: Sequence[str] = (),
                      totals: dict[str, str] | None = None) -> DataFrame:
    """Running totals (current row included) and the next row's value of some columns.

    ``sums`` maps output to input; ``next_of`` adds ``next_<c>``; ``totals`` maps output to input group totals.
    The frame inside one range partition is bounded; the offsets come from one row per partition.
    """
    totals = totals or {}
    pinned = pin_order(df, order_by, group_by)
    inputs = sorted(set(sums.values()) | set(totals.values()))
    before = Window.partitionBy(*group_by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = Window.partitionBy(*group_by).orderBy("_part")
    everything = Window.partitionBy(*group_by)
    aggregates = [F.sum(c).alias(f"_t_{c}") for c in inputs]
    aggregates += [F.min_by(c, "_seq").alias(f"_f_{c}") for c in next_of]
    offsets = pinned.groupBy(*group_by, "_part").agg(*aggregates)
    offsets = offsets.select(
        *group_by, "_part",
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sorted(set(sums.values()))],
        *[F.sum(f"_t_{c}").over(everything).alias(out) for out, c in totals.items()],
        *[F.lead(f"_f_{c}").over(parts).alias(f"_x_{c}") for c in next_of],
    )
    inside = Window.partitionBy(*group_by, "_part").orderBy("_seq")
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = pinned.withColumns(
        {f"_s_{out}": F.sum(c).over(running) for out, c in sums.items()}
        | {f"_n_{c}": F.lead(c).over(inside) for c in next_of}
    )
    joined = _with_offsets(local, offsets, group_by)
    return joined.select(
        *df.columns,
        *[(F.col(f"_s_{out}") + F.col(f"_b_{c}")).alias(out) for out, c in sums.items()],
        *[F.coalesce(f"_n_{c}", f"_x_{c}").alias(f"next_{c}") for c in next_of],
        *totals.keys(),
    )


def exact_quantiles(values: DataFrame, column: str, quantiles: Sequence[float],
                    group_by: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles ``q0 q1 ...`` per group; nulls and NaN are left out.

    A sketch brackets each order statistic; a second scan counts what lies below the bracket and keeps only the
    values inside it, equal ones merged. Nothing is sorted but those. Should a bracket miss its statistic, all
    distinct values are ordered instead.
    """
    clean = values.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    clean = clean.select(*group_by, F.col(column).cast("double").alias("_v"))
    names = list(group_by) or ["_all"]
    if not group_by:
        clean = clean.withColumn("_all", F.lit(1))
    picked = materialise(_bracketed(clean, quantiles, names), "quantiles")
    outputs = [f"q{i}" for i in range(len(quantiles))]
    missed = F.lit(False)
    for q in outputs:
        missed = missed | F.col(q).isNull()
    if picked.where(missed).limit(1).count():
        picked = _ordered(clean, quantiles, names)
    return picked.select(*group_by, *outputs)


def _interpolated(counted: DataFrame, quantiles: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Pick from rows ``_v _c _upto _n`` (values, their counts, ranks reached, group size) with ``_i`` the quantile."""
    aggregates = []
    for i, q in enumerate(quantiles):
        position = (F.col("_n") - 1) * F.lit(float(q))
        low, high = F.floor(position), F.ceil(position)

        def value_at(index: Column) -> Column:
            holds = (F.col("_upto") - F.col("_c") <= index) & (index < F.col("_upto"))
            return F.max(F.when(holds & F.coalesce(F.col("_i") == i, F.lit(True)), F.col("_v")))

        aggregates += [value_at(low).alias(f"_lo{i}"), value_at(high).alias(f"_hi{i}"),
                       F.max(position - low).alias(f"_w{i}")]
    chosen = counted.groupBy(*names).agg(*aggregates)
    return chosen.select(
        *names,
        *[(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")).alias(f"q{i}")
          for i in range(len(quantiles))],
    )


def _bracketed(clean: DataFrame, quantiles: Sequence[float], names: Sequence[str]) -> DataFrame:
    slack = 2.0 / SKETCH_ACCURACY
    shares = [max(0.0, q - slack) for q in quantiles] + [min(1.0, q + slack) for q in quantiles]
    sketch = F.percentile_approx("_v", F.array(*[F.lit(s) for s in shares]), SKETCH_ACCURACY)
    bounds = materialise(clean.groupBy(*names).agg(
        F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), sketch.alias("_s")
    ), "quantile-brackets")
    small = broadcast_if_small(bounds.withColumnsRenamed({n: f"_o_{n}" for n in names}))
    joined = clean.join(small, _null_safe(clean, small, names)).drop(*[f"_o_{n}" for n in names])
    tiny = F.col("_n") <= SKETCH_ACCURACY
    low = [F.when(tiny, F.col("_min")).otherwise(F.col("_s")[i]) for i in range(len(quantiles))]
    high = [F.when(tiny, F.col("_max")).otherwise(F.col("_s")[i + len(quantiles)]) for i in range(len(quantiles))]
    below = joined.groupBy(*names).agg(
        F.max("_n").alias("_n"),
        F.array(*[F.count_if(F.col("_v") < low[i]) for i in range(len(quantiles))]).alias("_below"),
    )
    hits = F.array(*[F.when((F.col("_v") >= low[i]) & (F.col("_v") <= high[i]), F.lit(i)) for i in range(len(quantiles))])
    inside = joined.select(*names, "_v", F.explode(F.array_compact(hits)).alias("_i"))
    counted = inside.groupBy(*names, "_i", "_v").agg(F.count("*").alias("_c"))
    ranked = with_running_sums(counted, ["_v"], {"_reached": "_c"}, [*names, "_i"])
    offsets = broadcast_if_small(below.withColumnsRenamed({n: f"_o_{n}" for n in names}))
    placed = ranked.join(offsets, _null_safe(ranked, offsets, names)).drop(*[f"_o_{n}" for n in names])
    return _interpolated(placed.withColumn("_upto", F.col("_reached") + F.col("_below")[F.col("_i")]), quantiles, names)


def _ordered(clean: DataFrame, quantiles: Sequence[float], names: Sequence[str]) -> DataFrame:
    counted = clean.groupBy(*names, "_v").agg(F.count("*").alias("_c"))
    ranked = with_running_sums(counted, ["_v"], {"_upto": "_c"}, names, totals={"_n": "_c"})
    return _interpolated(ranked.withColumn("_i", F.lit(None).cast("int")), quantiles, names)
