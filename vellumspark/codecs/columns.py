"""Codecs as Column functions: Arrow-batched, one value at a time, a whole chain per hop to Python."""

from __future__ import annotations

import json
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumspark.codecs import chain, fax
from vellumspark.crypto import ciphers
from vellumspark.operators.base import release

DECODED = T.StructType([T.StructField("data", T.BinaryType()), T.StructField("left", T.ArrayType(T.StringType())), T.StructField("reason", T.StringType())])


@lru_cache(64)
def _parsed(params: str) -> list:
    return json.loads(params)


@F.pandas_udf(DECODED)
def _decode(data: pd.Series, filters: pd.Series, params: pd.Series) -> pd.DataFrame:
    rows = []
    for d, f, p in zip(data, filters, params, strict=True):
        x = chain.Decoded(b"", [], "null") if d is None else chain.decode_chain(bytes(d), list(f) if f is not None else [], _parsed(p) if p else None)
        rows.append((None if d is None else x.data, x.left, x.reason))
    release()
    return pd.DataFrame(rows, columns=["data", "left", "reason"])


@F.pandas_udf(T.BinaryType())
def _encode(data: pd.Series, filters: pd.Series, params: pd.Series) -> pd.Series:
    out = pd.Series([None if d is None else chain.encode_chain(bytes(d), list(f) if f is not None else [], _parsed(p) if p else None) for d, f, p in zip(data, filters, params, strict=True)])
    release()
    return out


@F.pandas_udf(T.BinaryType())
def _fax_encode(data: pd.Series, width: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else chain.fax_encode(bytes(d), {"Columns": w, "K": n, "BlackIs1": True}) for d, w, n in zip(data, width, k, strict=True)])


@F.pandas_udf(T.BinaryType())
def _fax_decode(data: pd.Series, width: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else chain.fax_decode(bytes(d), {"Columns": w, "K": n, "BlackIs1": True}) for d, w, n in zip(data, width, k, strict=True)])


@F.pandas_udf(T.BinaryType())
def _rc4(data: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series([None if d is None or k is None else ciphers.rc4(bytes(k), bytes(d)) for d, k in zip(data, key, strict=True)])


def _args(filters, params) -> tuple[Column, Column]:
    f = filters if isinstance(filters, Column) else F.array(*[F.lit(x) for x in filters])
    p = params if isinstance(params, Column) else F.lit(json.dumps(params) if params else None).cast("string")
    return f, p


def decode_stream(data: Column, filters: Column | list[str], params: Column | list | None = None) -> Column:
    """struct(data, left, reason). params: a JSON list of objects, one per filter, as text."""
    return _decode(data, *_args(filters, params))


def encode_stream(data: Column, filters: Column | list[str], params: Column | list | None = None) -> Column:
    return _encode(data, *_args(filters, params))


def fax_encode(rows: Column, width: Column | int, k: int = -1) -> Column:
    """Packed rows, black is 1."""
    return _fax_encode(rows, F.lit(width) if isinstance(width, int) else width, F.lit(k))


def fax_decode(data: Column, width: Column | int = fax.WIDTH, k: int = -1) -> Column:
    return _fax_decode(data, F.lit(width) if isinstance(width, int) else width, F.lit(k))


def rc4(data: Column, key: Column) -> Column:
    """RC4 in either direction; null if either is."""
    return _rc4(data, key)


def register(spark: SparkSession) -> None:
    """SQL names: decode_stream(data, filters, params), encode_stream(...), fax_encode(rows, width, k), fax_decode(...)."""
    for name, f in (("decode_stream", _decode), ("encode_stream", _encode), ("fax_encode", _fax_encode), ("fax_decode", _fax_decode)):
        spark.udf.register(name, f)
