"""Number text with significant digits, as Python's ``g`` format writes it."""

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# The formatting function travels with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def significant(column: Column, digits: int) -> Column:
    # Java's %g keeps trailing zeros, so the text is made in Arrow batches.
    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else f"{v:.{digits}g}")

    return text(column)
