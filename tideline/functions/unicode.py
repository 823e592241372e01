"""Unicode forms that SQL functions lack, as Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F


@F.pandas_udf("string")
def compatibility_form(s: pd.Series) -> pd.Series:
    """NFKC; null stays null."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf("string")
def ascii_form(s: pd.Series) -> pd.Series:
    """NFKD without what isn't ASCII; null stays null."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode("ascii"))
