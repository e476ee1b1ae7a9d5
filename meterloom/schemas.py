"""Explicit schemas of every table that enters or leaves the library."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

READINGS = _struct(key=_S, ts=T.TimestampType(), value=_D)
PROFILE = _struct(key=_S, dow=_I, hour=_I, pi=_D)
PAIRS = _struct(key=_S, profile_key=_S)
COMBOS = _struct(f_key=_S, f_profile=_S, p_key=_S, p_profile=_S)
DAYSLOT_TEXT = _struct(meter=_S, code=_S, value=_S)
DAYSLOT_SPLIT_TEXT = _struct(meter=_S, day=_S, slot=_S, value=_S)
WEATHER = _struct(meter_id=_I, date=T.DateType(), hour=_I, reading=_D, temperature=_D)
WEATHER_TEXT = _struct(meter_id=_S, date=_S, hour=_S, reading=_S, temperature=_S)
ACTIVITY = _struct(meter_id=_I, mean=T.ArrayType(_D), std=T.ArrayType(_D))
MODELS = _struct(meter_id=_I, hour=_I, beta=T.ArrayType(_D), status=_S)
POINTS = _struct(measurement=_S, key=_S, ts_ms=_L, value=_D)
