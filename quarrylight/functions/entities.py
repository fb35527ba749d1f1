"""Entity decoding, for which the JVM has no expression: Arrow batches through the standard library."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import functions as F


@F.pandas_udf("string")
def unescape(s: pd.Series) -> pd.Series:
    """HTML entities decoded; null stays null."""
    return s.map(lambda x: html.unescape(x) if isinstance(x, str) and "&" in x else x)
