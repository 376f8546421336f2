"""Chart datasets that need more than one aggregate: the correlation matrix.

(Histogram, timeline and per-hour datasets live in ``profile``; the scatter
dataset in ``evaluate``.)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .gram import pair_moments


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns, booleans excluded (they are not numbers to pandas' select)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson r for every ordered pair (x, y) over rows where both are present.

    One pass for any number of columns (:func:`fraudframe.operators.gram.pair_moments`); what comes to the driver
    are the moments of the pairs, as many as the result has rows.  r is null for a constant side
    or fewer than one pair row.
    """
    cols = columns or numeric_columns(df)
    schema = "x string, y string, r double"
    if not cols:
        return df.sparkSession.createDataFrame([], schema)
    m = pair_moments(df, cols)
    cov, var = m.covariance()
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.clip(cov / np.sqrt(var * var.T), -1.0, 1.0)
    varies = m.low < m.high
    r[np.diag_indices(len(cols))] = 1.0
    r = np.where(varies[:, None] & varies[None, :] & np.isfinite(r), r, np.nan)
    k = len(cols)
    table = pa.table({"x": pa.array(cols).take(pa.array(np.repeat(np.arange(k), k))), "y": pa.array(cols * k),
                      "r": pa.array(r.ravel(), from_pandas=True)})
    return df.sparkSession.createDataFrame(table, schema)
