"""Text folding that needs Unicode tables, in Arrow batches."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def fold_one(text: str | None) -> str:
    """Compatibility forms taken apart, without combining marks, in small letters, with single spaces; null is empty."""
    if text is None:
        return ""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(text.lower().split())


#: Bytes of text, about, that a task's Python takes apart at once.
PIECE = 1_000_000


@F.arrow_udf(StringType())
def fold_text(text: pa.Array) -> pa.Array:
    """``fold_one`` of a column."""
    rows = max(1, PIECE * len(text) // max(1, text.nbytes))
    parts = [pa.array([fold_one(x) for x in text.slice(k, rows).to_pylist()], pa.string()) for k in range(0, len(text), rows)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def folded(text: Column) -> Column:
    """``fold_one`` of a column: in Spark where the text is of ASCII characters, so that only other texts go to Python."""
    plain = F.trim(F.regexp_replace(F.lower(text), "[\\x09-\\x0D\\x1C-\\x1F ]+", " "))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(text.isNull(), "").when(ascii_only, plain).otherwise(fold_text(F.when(~ascii_only, text)))


def sorted_json(text: str | None) -> str | None:
    """A JSON text with the keys of all objects in order and other characters as they are; null if it is none."""
    try:
        return None if text is None else json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True)
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """``sorted_json`` of a column."""
    return text.map(sorted_json)
