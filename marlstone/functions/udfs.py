"""Functions that need Python: Unicode forms. Arrow batches, and only for text that is not ASCII."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import identity_key as ascii_key


def _fold(text: str | None) -> str | None:
    return None if text is None else "".join(c for c in unicodedata.normalize("NFKC", text).lower() if c.isalnum())


def with_identity_key(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the identity key: NFKC form, lower case, letters and digits. Only rows with other than ASCII text see Python."""

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(_fold, na_action="ignore")

    c: Column = F.col(column)
    plain = ~F.coalesce(c.rlike(r"[^\x00-\x7F]"), F.lit(False))
    return df.where(plain).withColumn(name, ascii_key(c)).unionByName(df.where(~plain).withColumn(name, fold(c)))
