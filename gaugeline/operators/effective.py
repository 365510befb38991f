"""Which specification, configuration and baseline apply to a context.

Three NULL rules differ: an absent context field lets only unscoped
specifications and configurations match, a baseline must be absent in the same
fields, and a stored-measurement request without a field does not filter on it.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeline.operators.layout import small
from gaugeline.schema import SCOPE


def _most_specific(contexts: DataFrame, candidates: DataFrame, newest: str, key: str) -> DataFrame:
    """Best candidate per context row, or no row when none applies.

    A candidate applies when each scope column is NULL or equal. So a context asks
    for its own values with every subset of them blanked out, at most eight keys,
    and an equality join finds the one best candidate kept per scope.
    """
    scope_key = ["parameter_id", *SCOPE]
    within_scope = Window.partitionBy(*scope_key).orderBy(F.desc(newest), F.asc(key))
    kept = candidates.withColumn("_rank", F.row_number().over(within_scope)).filter("_rank = 1")
    payload = [c for c in candidates.columns if c not in scope_key]
    kept = kept.select(
        F.struct(*scope_key).alias("_scope"),
        *payload,
        sum(F.col(c).isNotNull().cast("int") for c in SCOPE).alias("_specificity"),
    )
    types = dict(contexts.dtypes)
    asked = [
        F.struct(
            F.col("parameter_id"),
            *[(F.col(c) if keep else F.lit(None).cast(types[c])).alias(c) for c, keep in zip(SCOPE, choice)],
        )
        for choice in product((True, False), repeat=len(SCOPE))
    ]
    matched = contexts.withColumn("_scope", F.explode(F.array_distinct(F.array(*asked)))).join(small(kept), "_scope")
    best = Window.partitionBy(*contexts.columns).orderBy(F.desc("_specificity"), F.desc(newest), F.asc(key))
    return (
        matched.withColumn("_rank", F.row_number().over(best))
        .filter("_rank = 1")
        .drop("_rank", "_specificity", "_scope")
    )


def effective_specifications(contexts: DataFrame, specifications: DataFrame, as_of) -> DataFrame:
    """Most specific active specification in force at ``as_of``, then the latest."""
    at = F.lit(as_of) if not hasattr(as_of, "alias") else as_of
    in_force = specifications.filter(
        (F.col("status") == "ACTIVE")
        & (F.col("effective_from") <= at)
        & (F.col("effective_to").isNull() | (F.col("effective_to") > at))
    )
    return _most_specific(contexts, in_force, "effective_from", "specification_id")


def effective_configurations(contexts: DataFrame, configurations: DataFrame) -> DataFrame:
    """Most specific active configuration, then the one created last."""
    return _most_specific(contexts, configurations.filter("is_active"), "created_at", "spc_configuration_id")


def active_baselines(contexts: DataFrame, baselines: DataFrame) -> DataFrame:
    """The active baseline whose context equals this one, absent fields included."""
    active = baselines.filter(F.col("status") == "ACTIVE")
    condition = F.col("b.parameter_id") == F.col("c.parameter_id")
    for c in SCOPE:
        condition = condition & F.col(f"b.{c}").eqNullSafe(F.col(f"c.{c}"))
    rest = [c for c in baselines.columns if c not in ("parameter_id", *SCOPE)]
    return (
        contexts.alias("c")
        .join(active.alias("b"), condition)
        .select("c.*", *[F.col(f"b.{c}").alias(c) for c in rest])
    )
