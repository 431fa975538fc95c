"""JSON in one form, whatever the order of keys."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def json_hash(value: object) -> str:
    return hashlib.sha256(canonical(value).encode("utf-8", "surrogatepass")).hexdigest()


@F.pandas_udf(T.StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """JSON text with keys in one order and no free white space; text that is not JSON stays as it is, null stays null."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else canonical(json.loads(x))
        except (ValueError, RecursionError):
            return x

    return s.map(one, na_action=None).astype(object)
