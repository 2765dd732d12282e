"""Codecs as SQL functions. They take and give whole columns of an Arrow batch; a value that can't be decoded gives null."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.functions import codecs
from tessera.session import ship
from tessera.sources.binary import DecodeError
from tessera.sources.registry import sniff


def _each(f: Callable, *columns: pd.Series) -> pd.Series:
    def one(*values: object) -> object:
        if any(v is None for v in values):
            return None
        try:
            return f(*values)
        except DecodeError:
            return None

    return pd.Series([one(*v) for v in zip(*columns, strict=True)], dtype=object)


def register_codecs(spark: SparkSession) -> list[str]:
    """lcw_compress, lcw_decompress, xor_delta, adpcm_encode, adpcm_decode, sniff_format, vlq."""
    ship(spark)

    @F.pandas_udf("binary")
    def lcw_compress(data: pd.Series) -> pd.Series:
        return _each(codecs.lcw_compress, data)

    @F.pandas_udf("binary")
    def lcw_decompress(data: pd.Series, most: pd.Series) -> pd.Series:
        return _each(codecs.lcw_decompress, data, most)

    @F.pandas_udf("binary")
    def xor_delta(canvas: pd.Series, delta: pd.Series) -> pd.Series:
        return _each(codecs.xor_delta, canvas, delta)

    @F.pandas_udf("binary")
    def adpcm_encode(samples: pd.Series, stereo: pd.Series) -> pd.Series:
        return _each(lambda s, t: codecs.adpcm_encode(s, bool(t)), samples, stereo)

    @F.pandas_udf("array<int>")
    def adpcm_decode(data: pd.Series, stereo: pd.Series) -> pd.Series:
        return _each(lambda d, t: codecs.adpcm_decode(d, bool(t)), data, stereo)

    @F.pandas_udf("string")
    def sniff_format(data: pd.Series) -> pd.Series:
        return _each(lambda d: sniff(bytes(d)), data)

    @F.pandas_udf("binary")
    def vlq(value: pd.Series) -> pd.Series:
        return _each(lambda v: codecs.vlq_write(int(v)), value)

    made = {f.__name__: f for f in (lcw_compress, lcw_decompress, xor_delta, adpcm_encode, adpcm_decode, sniff_format, vlq)}
    for name, f in made.items():
        spark.udf.register(name, f)
    return list(made)
