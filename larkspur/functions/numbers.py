"""Number tokens and positions as Catalyst expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.policy import Policy

_NUMBER = r"\A-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z"
_WHOLE = {"double": 2.0**-52 * 128, "float": 2.0**-23 * 128}
_TEN = {"double": 308, "float": 38}


def json_number(token: Column | str, policy: Policy | None = None) -> Column:
    """Struct (kind, i, f, error) of a whole number token: an integer, a float, or the error's name. At most 64-bit integers."""
    token, policy = F.col(token) if isinstance(token, str) else token, policy or Policy()
    if policy.int_bits > 64:
        raise ValueError("json_number() gives integers of at most 64 bits")
    plain = ~token.rlike(r"[.eE]")
    whole = token.try_cast("decimal(38,0)")
    fits = whole.between(F.lit(str(policy.int_min)).cast("decimal(38,0)"), F.lit(str(policy.int_max)).cast("decimal(38,0)"))
    if policy.float is None:
        kind = F.when(plain & fits, "integer")
        value = F.lit(None).cast("double")
        collapsed = F.lit(False)
    else:
        exponent = F.coalesce(F.regexp_extract(token, r"[eE][+-]?0*([0-9]*)\z", 1), F.lit(""))
        far = (F.length(exponent) > 3) | (exponent.try_cast("int") > _TEN[policy.float])
        value = token.try_cast("double")
        value = value.cast("float").cast("double") if policy.float == "float" else value
        # a double at the upper bound of 64 bits is one more than the largest integer
        collapsed = (F.abs(value - F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))) < _WHOLE[policy.float]) & (value >= float(policy.int_min)) & (value < math.ldexp(1.0, policy.int_bits - 1))
        kind = F.when(plain, F.when(fits, "integer")).when(F.coalesce(far, F.lit(False)), None).when(collapsed, "integer").otherwise("float")
    good = token.rlike(_NUMBER)
    kind = F.when(good, kind)
    i = F.when(kind == "integer", F.when(plain, whole.try_cast("bigint")).otherwise(value.try_cast("bigint")))
    error = F.when(token.isNull(), None).when(~good, "unrecognized_token").when(kind.isNull(), "number_out_of_range")
    return F.struct(kind.alias("kind"), i.alias("i"), F.when(kind == "float", value).alias("f"), error.alias("error"))


def format_position(coord: Column | str) -> Column:
    """A position as (line:column)."""
    coord = F.col(coord) if isinstance(coord, str) else coord
    return F.format_string("(%d:%d)", coord["line"], coord["column"])
