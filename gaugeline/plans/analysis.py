"""Full analysis of every context: profile, subgroups, chart, sigma, capability, rules."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.capability import with_capability
from gaugeline.functions.constants import D3_SPAN_2
from gaugeline.operators.charts import (
    chart_points,
    exclusion_warning,
    series,
    with_limits,
    with_sizes,
)
from gaugeline.operators.effective import effective_configurations, effective_specifications
from gaugeline.operators.layout import (
    Layout,
    attach,
    context,
    materialize,
    measure,
    small,
    unpack,
)
from gaugeline.operators.rules import decode_ruleset, hit_totals, judge, ruleset_problem, stability, violations
from gaugeline.operators.statistics import (
    candidate_sizes,
    precondition_profile,
    require_columns,
    sampling_interval,
    valid_value,
)
from gaugeline.operators.subgroups import form_subgroups, sequence_rows
from gaugeline.schema import AUTO, CONTEXT, ENGINE_CONTEXT, IMR, RULESET, SCOPE, SUBGROUP_METHODS

ZERO_SIGMA = "Within-sigma is zero: control limits collapse to the center line."

LIMITS = ("center_line", "ucl", "lcl", "secondary_center_line", "secondary_ucl", "secondary_lcl")
INDICES = ("cp", "cpk", "cpu", "cpl", "pp", "ppk", "ppu", "ppl")
HITS = ("point_violations", "trend_violations", "shift_violations", "violation_count")

SETTINGS = {
    "configured_chart": "string",
    "subgroup_size": "int",
    "subgroup_method": "string",
    "maximum_time_gap_seconds": "int",
    "minimum_sample_size": "int",
    "ruleset": RULESET.simpleString(),
    "spc_configuration_id": "string",
    "specification_id": "string",
    "lsl": "double",
    "usl": "double",
    "target": "double",
}


@dataclass(frozen=True)
class SpcConfig:
    """Settings that hold for every context of a job."""

    chart_type: str = AUTO
    subgroup_size: int = 1
    subgroup_method: str = "CONSECUTIVE"
    maximum_time_gap_seconds: int = 3600
    minimum_sample_size: int = 20
    ruleset: list = field(default_factory=list)
    lsl: float | None = None
    usl: float | None = None
    target: float | None = None

    def columns(self) -> dict:
        rules = [
            F.struct(
                F.lit(r["rule_name"]).alias("rule_name"),
                F.lit(r.get("enabled", True)).alias("enabled"),
                F.lit(r.get("severity", "WARNING")).alias("severity"),
                F.create_map(
                    *[F.lit(str(x)) for kv in (r.get("parameters") or {}).items() for x in kv]
                ).cast("map<string,string>").alias("parameters"),
            )
            for r in self.ruleset
        ]
        given = {
            "configured_chart": F.lit(self.chart_type),
            "subgroup_size": F.lit(self.subgroup_size),
            "subgroup_method": F.lit(self.subgroup_method),
            "maximum_time_gap_seconds": F.lit(self.maximum_time_gap_seconds),
            "minimum_sample_size": F.lit(self.minimum_sample_size),
            "ruleset": F.array(*rules),
            "lsl": F.lit(self.lsl),
            "usl": F.lit(self.usl),
            "target": F.lit(self.target),
        }
        return {name: given.get(name, F.lit(None)).cast(kind) for name, kind in SETTINGS.items()}


@dataclass(frozen=True)
class Analysis:
    """Lazy result tables; ``ctx`` holds the context fields of every row."""

    layout: Layout
    profile: DataFrame
    subgroups: DataFrame
    judged: DataFrame

    @property
    def summary(self) -> DataFrame:
        """One row per context: statistics, limits, sigma, capability, stability or an error."""
        constant = [
            "chart_type", "recommended_chart", "selection_reason", "selection_error", "size_used", "modal_size",
            "detected_size", "subgroups_formed", "subgroups_excluded", "excluded_sizes", "point_count",
            "grand_mean", *LIMITS, "within_sigma",
        ]
        charted = self.judged.groupBy("ctx").agg(
            *[F.first(c).alias(c) for c in constant], *[total.alias(n) for n, total in hit_totals().items()]
        )
        return _summary(self.profile.join(charted, "ctx", "left"))

    @property
    def completed(self) -> DataFrame:
        return self.summary.filter(F.col("error_code").isNull())

    @property
    def errors(self) -> DataFrame:
        return unpack(
            self.summary.filter(F.col("error_code").isNotNull()).select("ctx", "error_code", "error_message")
        )

    @property
    def points(self) -> DataFrame:
        """Points of charts that have limits."""
        return self.judged.filter(F.col("center_line").isNotNull())

    @property
    def violations(self) -> DataFrame:
        return violations(self.points)

    @property
    def chart_points(self) -> DataFrame:
        return series(self.points)

    def saved(self) -> Analysis:
        """Write the judged points once, for callers that need several of the tables."""
        return replace(self, judged=materialize(self.judged, "judged"))


def _precondition_error(profile: DataFrame) -> DataFrame:
    """First precondition a context fails, in the order the engine checks them."""
    size, method = F.col("subgroup_size"), F.col("subgroup_method")
    valid = F.col("valid_observations")
    shown = F.array_join("mixed_columns", ", ")
    problem = ruleset_problem(F.col("ruleset"))
    checks = [
        (F.col("total_observations") == 0, "NO_MEASUREMENTS", F.lit("Nothing was measured for this request.")),
        (
            F.col("configured_chart").isNull(),
            "MISSING_CONFIGURATION",
            F.lit("No active SPC configuration found for this context."),
        ),
        (problem.isNotNull(), "INVALID_RULESET", F.concat(F.lit("The ruleset cannot be used: "), problem)),
        (
            F.size("mixed_columns") > 0,
            "INCOMPATIBLE_CONTEXT",
            F.concat(F.lit("Several distinct values for: "), shown),
        ),
        (
            valid < F.col("minimum_sample_size"),
            "INSUFFICIENT_DATA",
            F.concat(
                F.lit("Only "), valid.cast("string"),
                F.lit(" valid observation(s) available; minimum required for SPC analysis is "),
                F.col("minimum_sample_size").cast("string"), F.lit("."),
            ),
        ),
        (
            size < 1,
            "INVALID_SUBGROUP_SIZE",
            F.concat(F.lit("subgroup_size must be >= 1, got "), size.cast("string"), F.lit(".")),
        ),
        (
            (size > 1) & ~method.isin(*SUBGROUP_METHODS),
            "INVALID_SUBGROUP_SIZE",
            F.concat(F.lit("Unsupported subgroup method: "), method),
        ),
        (
            (size > 1) & (method == "EXISTING_ID") & (F.col("unnamed_observations") > 0),
            "INVALID_SUBGROUP_SIZE",
            F.lit("EXISTING_ID requires a subgroup identifier on every measurement."),
        ),
        (
            (size > 1) & (method == "TIME_WINDOW") & (F.col("timed_observations") == 0),
            "INVALID_SUBGROUP_SIZE",
            F.lit("TIME_WINDOW requires event timestamps, but no measurement has one."),
        ),
    ]
    code, message = F.lit(None).cast("string"), F.lit(None).cast("string")
    for condition, name, text in reversed(checks):
        code = F.when(condition, name).otherwise(code)
        message = F.when(condition, text).otherwise(message)
    return profile.withColumns({"error_code": code, "error_message": message})


def _chart_error(df: DataFrame) -> DataFrame:
    """Errors only known after subgrouping, for contexts that passed the preconditions."""
    formed = F.coalesce("subgroups_formed", F.lit(0))
    kind, used = F.col("chart_type"), F.col("size_used")
    checks = [
        (formed == 0, "INVALID_SUBGROUP_SIZE", F.lit("Subgrouping produced zero subgroups from the supplied data.")),
        (
            formed < 2,
            "INVALID_SUBGROUP_SIZE",
            F.concat(
                F.lit("At least 2 subgroups are required to estimate control limits; only "),
                formed.cast("string"), F.lit(" were formed."),
            ),
        ),
        (F.col("selection_error").isNotNull(), "CHART_SELECTION", F.col("selection_error")),
        (
            (kind == IMR) & (F.coalesce("point_count", F.lit(0)) < 2),
            "INSUFFICIENT_DATA",
            F.lit("I-MR chart requires at least 2 individual observations to compute a moving range."),
        ),
        (
            (kind != IMR) & ~used.between(2, 25),
            "UNSUPPORTED_SIZE",
            F.concat(F.lit("No standard control chart constants available for subgroup size n="), used.cast("string")),
        ),
        (
            F.col("overall_sigma").isNull(),
            "INSUFFICIENT_DATA",
            F.lit("At least 2 valid individual observations are required to estimate overall sigma."),
        ),
    ]
    code, message = F.col("error_code"), F.col("error_message")
    late_code, late_message = F.lit(None).cast("string"), F.lit(None).cast("string")
    for condition, name, text in reversed(checks):
        late_code = F.when(condition, name).otherwise(late_code)
        late_message = F.when(condition, text).otherwise(late_message)
    return df.withColumns(
        {"error_code": F.coalesce(code, late_code), "error_message": F.when(code.isNotNull(), message).otherwise(late_message)}
    )


def analyze(
    measurements: DataFrame,
    settings: SpcConfig | DataFrame,
    *,
    context_columns=CONTEXT,
    row_columns=("upload_id", "source_row_number", "measurement_id"),
    stored_order: bool = True,
    mr_lcl_factor: float = D3_SPAN_2,
    chunk_rows: int | None = None,
    with_members: bool = False,
    asked: DataFrame | None = None,
) -> Analysis:
    """Analyse all contexts of ``measurements`` in one grouped job.

    ``asked`` lists contexts (``ctx``) that get a row even when nothing was measured.

    ``settings`` is one ``SpcConfig`` for all, or a table keyed by ``ctx`` with the
    columns of ``SETTINGS``. A context that cannot be analysed gets an error row in
    ``summary`` instead of stopping the job.
    """
    require_columns(measurements)
    # Columns of a context built here are fixed; a given one may leave any of them open.
    fixed = () if "ctx" in measurements.columns else tuple(context_columns)
    rows = context(measurements, context_columns) if fixed else measurements
    named = [c for c in ENGINE_CONTEXT if c in rows.columns and c not in fixed]
    for optional in ("event_timestamp", "subgroup_id"):
        if optional not in rows.columns:
            rows = rows.withColumn(optional, F.lit(None).cast("timestamp_ntz" if optional == "event_timestamp" else "string"))
    row_columns = [c for c in row_columns if c in rows.columns]
    rows = rows.select("ctx", "value", "event_timestamp", "subgroup_id", *row_columns,
                       *[c for c in named if c not in row_columns])

    profile = precondition_profile(rows, named)
    if asked is not None:
        counts = [c for c, kind in profile.dtypes if kind == "bigint"]
        profile = asked.select("ctx").distinct().join(profile, "ctx", "left").withColumns({
            **{c: F.coalesce(c, F.lit(0)) for c in counts},
            "mixed_columns": F.coalesce("mixed_columns", F.array().cast("array<string>")),
        })
    if isinstance(settings, SpcConfig):
        profile = profile.withColumns(settings.columns())
    else:
        present = set(settings.columns)
        full = settings.select(
            "ctx", *[(F.col(c) if c in present else F.lit(None)).cast(k).alias(c) for c, k in SETTINGS.items()]
        )
        profile = profile.join(small(full), "ctx", "left")
    # One row per context, used several times below and to size the job.
    profile = materialize(_precondition_error(profile), "profile")
    # A subgroup may reach into the next chunk, but not beyond it.
    widest = settings.subgroup_size if isinstance(settings, SpcConfig) else profile.agg(F.max("subgroup_size")).first()[0]
    layout = measure(profile, chunk_rows, "total_observations", widest or 1)
    methods = [settings.subgroup_method] if isinstance(settings, SpcConfig) else [
        # At most the four methods there are; a context of single values may carry any text.
        r[0] for r in profile.filter(
            F.col("error_code").isNull() & (F.col("subgroup_size") > 1) & F.col("subgroup_method").isin(*SUBGROUP_METHODS)
        ).select("subgroup_method").distinct().collect()
    ]
    eligible = profile.filter(F.col("error_code").isNull()).select(
        "ctx", "subgroup_size", "subgroup_method", "maximum_time_gap_seconds", "configured_chart", "ruleset",
        F.col("valid_observations").alias("n_rows"),
    )

    sequenced = sequence_rows(
        rows.filter(valid_value()).select("ctx", "value", "event_timestamp", "subgroup_id", *row_columns),
        layout, row_columns, stored_order,
    ).drop(*row_columns)
    forming = eligible.drop("configured_chart", "ruleset")
    sequenced = attach(sequenced, forming, layout, "seq", "n_rows", keep_length=False)
    subgroups = form_subgroups(sequenced, layout, methods, with_members)
    charting = attach(
        with_sizes(subgroups, layout), eligible.select("ctx", "configured_chart", "ruleset", "n_rows"), layout,
        "first_seq", "n_rows", keep_length=False,
    )
    points = chart_points(charting, layout)
    if layout.chunked:
        points = materialize(points, "points")
    judged = judge(with_limits(points, layout, mr_lcl_factor), layout)
    return Analysis(layout, profile, subgroups, judged)


def _summary(found: DataFrame) -> DataFrame:
    found = _chart_error(found)
    ok = F.col("error_code").isNull()
    summary = stability(with_capability(found))
    blank_if_failed = [
        *LIMITS, "within_sigma", *INDICES, "sigma_level_short_term", "sigma_level_long_term",
        "stability_status", "chart_type", "grand_mean", "point_count", "size_used",
    ]
    return summary.withColumns(
        {
            "warnings": F.when(
                ok,
                F.array_compact(
                    F.concat(
                        F.array(exclusion_warning()),
                        F.col("capability_warnings"),
                        F.array(F.when(F.col("within_sigma") == 0, F.lit(ZERO_SIGMA))),
                    )
                ),
            ),
            "invalid_observations": F.col("total_observations") - F.col("valid_observations"),
            "potential_subgroup_sizes": candidate_sizes(F.col("valid_observations")),
            "average_sampling_interval_seconds": sampling_interval(
                F.col("time_start"), F.col("time_end"), F.col("timed_observations")
            ),
            **{c: F.when(ok, F.col(c)) for c in blank_if_failed},
            **{c: F.when(ok, F.coalesce(c, F.lit(0))) for c in HITS},
        }
    ).drop("capability_warnings", "mixed_columns", "unnamed_observations", "timed_observations", "selection_error")


def resolved_settings(contexts: DataFrame, configurations: DataFrame, specifications: DataFrame, as_of) -> DataFrame:
    """Settings table for ``analyze``: effective configuration and specification per context.

    ``configurations`` holds the ruleset as JSON text or as an array.
    """
    keys = ["parameter_id", *SCOPE]
    plain = contexts.select(*keys).distinct()
    config = effective_configurations(plain, configurations)
    if dict(config.dtypes)["ruleset"] == "string":
        config = config.withColumn("ruleset", decode_ruleset(F.col("ruleset")))
    spec = effective_specifications(plain, specifications, as_of)
    wanted = ["subgroup_size", "subgroup_method", "maximum_time_gap_seconds", "minimum_sample_size", "ruleset",
              "spc_configuration_id"]
    packed = F.struct(*keys).alias("ctx")
    config = config.select(packed, F.col("chart_type").alias("configured_chart"), *wanted)
    spec = spec.select(packed, "specification_id", "lsl", "usl", "target")
    return config.join(small(spec), "ctx", "left")


def stored_results(analysis: Analysis, ids: DataFrame) -> DataFrame:
    """Rows for the analysis result table; ``ids`` maps ``ctx`` to ``analysis_id``."""
    done = analysis.completed.join(small(ids, analysis.layout.contexts), "ctx")
    return done.select(
        "analysis_id", "total_observations", "valid_observations", "invalid_observations",
        F.col("point_count").alias("subgroup_count"), F.col("size_used").alias("subgroup_size_used"),
        "mean", "minimum", "maximum", "within_sigma", "overall_sigma", "center_line", "ucl", "lcl",
        "secondary_center_line", "secondary_ucl", "secondary_lcl", "specification_id", "lsl", "usl", "target",
        "cp", "cpk", "cpu", "cpl", "pp", "ppk", "ppu", "ppl", "stability_status", "warnings",
    )


def requested_rows(measurements: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows of each requested context; a field the request leaves out does not filter.

    ``requests`` holds the four context columns. The same row may serve several
    requests, and a request may turn out to mix contexts.
    """
    asked = requests.select(F.struct(*CONTEXT).alias("ctx")).distinct()
    # At most eight ways to leave fields out; a row offers one key for each way in use.
    ways = asked.select(*[F.col(f"ctx.{c}").isNotNull().alias(c) for c in SCOPE]).distinct().collect()
    types = dict(measurements.dtypes)
    keys = []
    for way in ways:
        given = [c for c in SCOPE if way[c]]
        key = F.struct(
            F.col("parameter_id"),
            *[(F.col(c) if way[c] else F.lit(None).cast(types[c])).alias(c) for c in SCOPE],
        )
        present = F.lit(True)
        for c in given:
            present = present & F.col(c).isNotNull()
        keys.append(F.when(present, key))
    return measurements.withColumn("ctx", F.explode(F.array_compact(F.array(*keys)))).join(small(asked), "ctx", "left_semi")


def analysis_runs(analysis: Analysis, analysis_type: str = "HISTORICAL") -> DataFrame:
    """Run rows: COMPLETED with the chart that ran, or FAILED with the reason."""
    failed = F.col("error_code").isNotNull()
    planned = F.when(F.col("configured_chart") == AUTO, IMR).otherwise(F.col("configured_chart"))
    return analysis.summary.select(
        "ctx",
        F.lit(analysis_type).alias("analysis_type"),
        "spc_configuration_id",
        F.coalesce("chart_type", planned).alias("chart_type"),
        F.when(failed, "FAILED").otherwise("COMPLETED").alias("status"),
        "error_code",
        "error_message",
    )


def historical_analysis(
    measurements: DataFrame,
    requests: DataFrame,
    configurations: DataFrame,
    specifications: DataFrame,
    as_of,
    **options,
) -> Analysis:
    """Analyse every request with the configuration and specification in force for it."""
    settings = resolved_settings(requests, configurations, specifications, as_of)
    asked = requests.select(F.struct(*CONTEXT).alias("ctx"))
    return analyze(requested_rows(measurements, requests), settings, asked=asked, **options)
