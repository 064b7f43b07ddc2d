"""String normalizers that run before the cast."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import strip


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


NORMALIZERS = {
    "trim": strip,
    "remove_commas": lambda c: F.replace(c, F.lit(","), F.lit("")),
    "remove_currency_symbol": lambda c: F.translate(c, "¥￥$", ""),
    # No built-in function has compatibility composition; text of ASCII alone is its own and skips Python's work.
    "zenkaku_to_hankaku": lambda c: F.when(F.octet_length(c) == F.char_length(c), c).otherwise(_nfkc(c)),
}


def normalize(col: Column, names: list[str]) -> Column:
    for name in names:
        if name not in NORMALIZERS:
            raise ValueError(f"unsupported normalizer: {name}")
        col = NORMALIZERS[name](col)
    return col
