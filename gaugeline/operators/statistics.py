"""Dataset profile, preconditions and descriptive statistics per context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeline.functions.time import seconds_between
from gaugeline.operators.layout import Layout, materialize, small
from gaugeline.schema import ENGINE_CONTEXT

CANDIDATE_SIZES = (2, 3, 4, 5, 6, 8, 10)
# Quantile grid of one bracket round and its rank accuracy; see _narrowed_median.
GRID = 200
GRID_ACCURACY = 10 * GRID


class MissingColumns(ValueError):
    """A dataset lacks columns the analysis cannot do without."""


def require_columns(df: DataFrame, required=("value",)) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumns(f"Measurement dataset is missing required column(s): {', '.join(missing)}.")
    return df


def valid_value() -> Column:
    return F.col("value").isNotNull() & ~F.isnan("value")


def candidate_sizes(valid: Column) -> Column:
    """Subgroup sizes that leave at least two whole subgroups."""
    sizes = F.array(*[F.lit(n) for n in CANDIDATE_SIZES])
    return F.filter(sizes, lambda n: F.floor(valid / n) >= 2)


def sampling_interval(start: Column, end: Column, timed: Column) -> Column:
    """Mean gap of sorted times: the gaps add up to the whole span."""
    return F.when(timed > 1, seconds_between(start, end) / (timed - 1))


def profile_dataset(df: DataFrame) -> DataFrame:
    """Observation counts, distinct context values, time range, size candidates."""
    named = [c for c in ENGINE_CONTEXT if c in df.columns]
    out = df.groupBy("ctx").agg(
        F.count("*").alias("total_observations"),
        F.count_if(valid_value()).alias("valid_observations"),
        *[F.count_distinct(c).alias(f"unique_{c.removesuffix('_id')}s") for c in named],
        F.sort_array(F.collect_set("parameter_id")).alias("parameters"),
        F.min("event_timestamp").alias("time_start"),
        F.max("event_timestamp").alias("time_end"),
        F.count("event_timestamp").alias("_timed"),
        (F.count("subgroup_id") > 0).alias("existing_subgroup_ids_detected"),
    )
    return out.withColumns(
        {
            "invalid_observations": F.col("total_observations") - F.col("valid_observations"),
            "missing_values": F.col("total_observations") - F.col("valid_observations"),
            "potential_subgroup_sizes": candidate_sizes(F.col("valid_observations")),
            "average_sampling_interval_seconds": sampling_interval(
                F.col("time_start"), F.col("time_end"), F.col("_timed")
            ),
        }
    ).drop("_timed")


def precondition_profile(df: DataFrame, checked=ENGINE_CONTEXT) -> DataFrame:
    """What the analysis needs to know per context, in one mergeable aggregate.

    ``checked`` are the columns that may hold several values. Columns that ``ctx``
    fixes need no check; smallest and largest value tell more than one without expanding rows.
    """
    named = [c for c in checked if c in df.columns]
    ok = valid_value()
    mixed = [F.when(F.min(c) != F.max(c), F.lit(c)) for c in named]
    value = F.when(ok, F.col("value"))
    return df.groupBy("ctx").agg(
        F.count("*").alias("total_observations"),
        F.count_if(ok).alias("valid_observations"),
        F.avg(value).alias("mean"),
        F.min(value).alias("minimum"),
        F.max(value).alias("maximum"),
        F.stddev_samp(value).alias("overall_sigma"),
        F.min("event_timestamp").alias("time_start"),
        F.max("event_timestamp").alias("time_end"),
        F.count_if(ok & F.col("event_timestamp").isNotNull()).alias("timed_observations"),
        F.count_if(ok & F.col("subgroup_id").isNull()).alias("unnamed_observations"),
        F.array_compact(F.array(F.lit(None).cast("string"), *mixed)).alias("mixed_columns"),
    )


def exact_median(values: DataFrame, layout: Layout) -> DataFrame:
    """Exact median per context, the mean of the two middle values for even counts.

    Spark's own exact aggregate keeps every distinct value of a group in memory, so
    it serves contexts up to ``chunk_rows`` rows. Larger ones are narrowed in rounds.
    """
    if not layout.chunked:
        return values.groupBy("ctx").agg(F.median("value").alias("median"))
    large = materialize(
        values.groupBy("ctx")
        .agg(F.min("value").alias("_low"), F.max("value").alias("_high"), F.count("*").alias("_n"))
        .filter(F.col("_n") > layout.chunk_rows),
        "large",
    )
    large = small(large)
    rest = values.join(large, "ctx", "left_anti")
    return rest.groupBy("ctx").agg(F.median("value").alias("median")).unionByName(_narrowed_median(values, large, layout))


def _narrowed_median(values: DataFrame, bracket: DataFrame, layout: Layout) -> DataFrame:
    """Median by a shrinking value bracket per context.

    An approximate percentile has a bounded rank error, so two points of a quantile
    grid bracket the median. Only the distinct values left inside the last bracket
    are ranked.
    """
    lower, upper = F.expr("(_n + 1) div 2"), F.expr("(_n + 2) div 2")
    left = float(layout.total_rows)
    while left > layout.chunk_rows:
        inside = F.col("value").between(F.col("_low"), F.col("_high"))
        counted = values.join(bracket, "ctx").groupBy("ctx", "_low", "_high", "_n").agg(
            F.count_if(F.col("value") < F.col("_low")).alias("_below"),
            F.count_if(inside).alias("_in"),
            F.percentile_approx(F.when(inside, F.col("value")), [i / GRID for i in range(GRID + 1)], GRID_ACCURACY)
            .alias("_q"),
        )
        # One grid step of margin on both sides exceeds the rank error of the sketch.
        first = F.floor((lower - F.col("_below")) / F.col("_in") * GRID).cast("int") - 1
        last = F.ceil((upper - F.col("_below")) / F.col("_in") * GRID).cast("int") + 1
        bracket = small(
            materialize(
                counted.select(
                    "ctx",
                    F.when(first <= 0, F.col("_low")).otherwise(F.get("_q", first)).alias("_low"),
                    F.when(last >= GRID, F.col("_high")).otherwise(F.get("_q", last)).alias("_high"),
                    "_n",
                ),
                "bracket",
            )
        )
        left *= 4 / GRID
    # Equal values collapse to one row, everything below the bracket to another.
    ranked = (
        values.join(bracket, "ctx")
        .filter(F.col("value") <= F.col("_high"))
        .withColumn("_v", F.when(F.col("value") >= F.col("_low"), F.col("value")))
        .groupBy("ctx", "_v")
        .agg(F.count("*").alias("_c"), F.max("_n").alias("_n"))
    )
    upto = Window.partitionBy("ctx").orderBy(F.col("_v").asc_nulls_first())
    ranked = ranked.withColumn("_rank", F.sum("_c").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    reached = [F.min(F.when(F.col("_rank") >= k, F.col("_v"))) for k in (lower, upper)]
    return ranked.groupBy("ctx").agg(((reached[0] + reached[1]) / 2).alias("median"))


def descriptive_statistics(df: DataFrame, layout: Layout) -> DataFrame:
    """Mean, extremes, count, median and range of the valid values of each context."""
    values = df.filter(valid_value()).select("ctx", "value")
    base = values.groupBy("ctx").agg(
        F.avg("value").alias("mean"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
        F.count("*").alias("count"),
        (F.max("value") - F.min("value")).alias("range"),
    )
    return base.join(exact_median(values, layout), "ctx")


def overall_sigma(df: DataFrame) -> DataFrame:
    """Sample standard deviation of all valid values; NULL below two."""
    return (
        df.filter(valid_value())
        .groupBy("ctx")
        .agg(F.count("*").alias("count"), F.stddev_samp("value").alias("overall_sigma"))
    )


def upload_counts(df: DataFrame) -> DataFrame:
    """Total, valid and invalid rows per upload."""
    valid = F.count_if(F.col("quality_status") == "VALID")
    return df.groupBy("upload_id").agg(
        F.count("*").alias("total_rows"), valid.alias("valid_rows"), (F.count("*") - valid).alias("invalid_rows")
    )
