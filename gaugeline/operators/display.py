"""What a report shows: point status, thinning, histogram, zones, axis range."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.text import significant
from gaugeline.operators.layout import Layout, attach, materialize
from gaugeline.schema import POINT_OUTSIDE

DISPLAY_POINTS = 500
BINS = 16
CURVE_SIGMAS = 4
MAX_PADDING_BINS = 40


def point_status(points: DataFrame, found: DataFrame, message: str | None = None) -> DataFrame:
    """Worst status of each point and, if asked, the messages that led to it.

    Violations apply in start order. A worse one starts the message list anew, so
    the list begins at the first violation of the worst rank. A point lies in few
    violations, so the arrays stay short whatever the length of the chart.
    """
    rank = F.when(F.col("rule_name") == POINT_OUTSIDE, 2).otherwise(1)
    entry = F.struct(
        "start_index", "rule_position", rank.alias("rank"),
        (F.col(message) if message else F.lit(None).cast("string")).alias("message"),
    )
    touched = (
        found.withColumn("_entry", entry)
        .select("ctx", "_entry", F.explode("affected_points").alias("index"))
        .groupBy("ctx", "index")
        .agg(F.sort_array(F.collect_list("_entry")).alias("_all"))
        .withColumn("_worst", F.array_max(F.transform("_all", lambda e: e["rank"])))
        .withColumn("_from", F.array_position(F.transform("_all", lambda e: e["rank"]), F.col("_worst")))
    )
    touched = touched.select(
        "ctx",
        F.col("index").cast("long").alias("index"),
        "_worst",
        F.transform(
            F.slice("_all", F.col("_from").cast("int"), F.size("_all")), lambda e: e["message"]
        ).alias("messages"),
    )
    joined = points.join(touched, ["ctx", "index"], "left")
    return joined.withColumns(
        {
            "status": F.when(F.col("_worst") == 2, "OUT_OF_CONTROL").when(F.col("_worst") == 1, "WARNING")
            .otherwise("NORMAL"),
            "messages": F.coalesce("messages", F.array().cast("array<string>")),
        }
    ).drop("_worst")


def downsample(points: DataFrame, layout: Layout, max_points: int = DISPLAY_POINTS) -> DataFrame:
    """Thin a series for display, keeping every point that is not NORMAL and both ends.

    ``index`` runs from 0 without gaps within a context.
    """
    points = materialize(points, "statuses")
    counts = points.groupBy("ctx").agg(
        F.count("*").alias("_n"), F.count_if(F.col("status") != "NORMAL").alias("_kept")
    )
    budget = F.greatest(F.lit(max_points) - F.col("_kept"), F.lit(0))
    stride = F.when(budget > 0, F.ceil(F.col("_n") / F.greatest(budget, F.lit(1)))).otherwise(F.col("_n") + 1)
    counts = counts.withColumn("_stride", stride).drop("_kept")
    placed = attach(points.withColumn("_pos", F.col("index") + 1), counts, layout, "_pos", "_n")
    shown = (
        (F.col("_n") <= max_points)
        | (F.col("status") != "NORMAL")
        | (F.col("index") % F.col("_stride") == 0)
        | (F.col("index") == F.col("_n") - 1)
    )
    return placed.filter(shown).withColumn("was_downsampled", F.col("_n") > max_points).drop("_n", "_stride", "_pos", "_chunk__pos")


def normal_density(x: Column, mean: Column, sigma: Column, n: Column, width: Column) -> Column:
    """Normal curve scaled to the area of a histogram."""
    z = (x - mean) / sigma
    return F.exp(-(z * z) / 2) / (sigma * math.sqrt(2 * math.pi)) * n * width


def histogram_bounds(points: DataFrame, context_values: DataFrame, bins: int = BINS) -> DataFrame:
    """Bin width, start and number of bins per context.

    ``context_values`` holds ``mean``, ``overall_sigma``, ``lsl``, ``usl``, ``target``.
    The range grows to the normal curve and the specification, at most
    ``MAX_PADDING_BINS`` bins on each side.
    """
    data = points.groupBy("ctx").agg(
        F.min("value").alias("_min"), F.max("value").alias("_max"), F.count("*").alias("_n")
    )
    df = data.join(context_values.select("ctx", "mean", "overall_sigma", "lsl", "usl", "target"), "ctx", "left")
    span = F.col("_max") - F.col("_min")
    width = F.when(span == 0, 1.0).otherwise(span) / bins
    curve = F.col("mean").isNotNull() & (F.col("overall_sigma") > 0)
    reach = CURVE_SIGMAS * F.col("overall_sigma")
    low = F.least("_min", F.when(curve, F.col("mean") - reach), "lsl", "target")
    high = F.greatest("_max", F.when(curve, F.col("mean") + reach), "usl", "target")
    df = df.withColumns({"bin_width": width, "_low": low, "_high": high, "has_curve": F.coalesce(curve, F.lit(False))})

    def padding(distance):
        return F.least(F.lit(MAX_PADDING_BINS), F.greatest(F.lit(0), F.ceil(distance / F.col("bin_width")))).cast("long")

    df = df.withColumns(
        {"_left": padding(F.col("_min") - F.col("_low")), "_right": padding(F.col("_high") - F.col("_max"))}
    )
    return df.withColumns(
        {
            "histogram_start": F.col("_min") - F.col("_left") * F.col("bin_width"),
            "total_bins": F.col("_left") + F.col("_right") + bins,
            "value_count": F.col("_n"),
        }
    ).drop("_min", "_max", "_low", "_high", "_left", "_right", "_n")


def histogram(points: DataFrame, context_values: DataFrame, layout: Layout, bins: int = BINS) -> DataFrame:
    """All bins of every context with counts and the scaled normal curve.

    ``points`` are the primary chart points with ``ctx``, ``index`` and ``value``.
    """
    points = materialize(points.select("ctx", "index", "value"), "primary")
    bounds = materialize(histogram_bounds(points, context_values, bins), "bounds")
    placed = attach(
        points.select("ctx", "value", (F.col("index") + 1).alias("_pos")),
        bounds.select("ctx", "bin_width", "histogram_start", "total_bins", "value_count"), layout, "_pos", "value_count",
    )
    at = F.floor((F.col("value") - F.col("histogram_start")) / F.col("bin_width"))
    counts = (
        placed.withColumn("bin", F.least(F.greatest(at, F.lit(0)), F.col("total_bins") - 1))
        .groupBy("ctx", "bin")
        .agg(F.count("*").alias("count"))
    )
    start = F.col("histogram_start") + F.col("bin") * F.col("bin_width")
    slots = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total_bins") - 1)))
    slots = slots.withColumns({"range_start": start, "range_end": start + F.col("bin_width"),
                               "center": start + F.col("bin_width") / 2})
    curve = normal_density(F.col("center"), F.col("mean"), F.col("overall_sigma"), F.col("value_count"), F.col("bin_width"))
    return (
        slots.withColumn("normal_curve", F.when(F.col("has_curve"), curve))
        .join(counts, ["ctx", "bin"], "left")
        .select("ctx", "bin", "range_start", "range_end", "center", "normal_curve",
                F.coalesce("count", F.lit(0).cast("long")).alias("count"))
    )


def bin_of(bins: DataFrame, marks: DataFrame) -> DataFrame:
    """First bin that holds each marked value, the nearest edge bin when none does.

    ``marks`` has ``ctx``, ``mark`` and ``mark_value``; a context has under a hundred bins.
    """
    value = F.col("mark_value")
    inside = (value >= F.col("range_start")) & (value <= F.col("range_end"))
    found = bins.join(marks, "ctx").groupBy("ctx", "mark", "mark_value").agg(
        F.min(F.when(inside, F.col("bin"))).alias("_bin"),
        F.min("range_start").alias("_start"),
        F.max("bin").alias("_last"),
    )
    edge = F.when(value < F.col("_start"), F.lit(0).cast("long")).otherwise(F.col("_last"))
    return found.select("ctx", "mark", "mark_value", F.coalesce("_bin", edge).alias("bin"))


def sigma_zones(df: DataFrame) -> DataFrame:
    """Thirds between the centre line and each limit."""
    up, down = (F.col("ucl") - F.col("center_line")) / 3, (F.col("center_line") - F.col("lcl")) / 3
    centre = F.col("center_line")
    return df.withColumns(
        {
            "one_sigma_upper": centre + up,
            "two_sigma_upper": centre + up * 2,
            "one_sigma_lower": centre - down,
            "two_sigma_lower": centre - down * 2,
        }
    )


def axis_range(points: DataFrame, lines: DataFrame, padding: float = 0.08, digits: int = 8) -> DataFrame:
    """Value axis of each context from its points and reference lines.

    ``lines`` has ``ctx`` and any number of value columns; NULL and non-finite
    numbers do not count. A context without numbers gets 0 to 1.
    """

    def finite(c):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)

    data = points.groupBy("ctx").agg(F.min(finite(F.col("value"))).alias("_a"), F.max(finite(F.col("value"))).alias("_b"))
    others = [finite(F.col(c)) for c in lines.columns if c != "ctx"]
    df = lines.join(data, "ctx", "left")
    low, high = F.least(F.col("_a"), *others), F.greatest(F.col("_b"), *others)
    span = F.coalesce(F.nullif(high - low, F.lit(0.0)), F.nullif(F.abs(high), F.lit(0.0)), F.lit(1.0))

    def rounded(c):
        return significant(c, digits).cast("double")

    df = df.withColumns({"_low": low - span * padding, "_high": high + span * padding})
    return df.select(
        "ctx",
        F.when(F.col("_low").isNull(), 0.0).otherwise(rounded(F.col("_low"))).alias("axis_low"),
        F.when(F.col("_high").isNull(), 1.0).otherwise(rounded(F.col("_high"))).alias("axis_high"),
    )
