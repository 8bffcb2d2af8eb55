"""Scalar functions as Column expressions with their IEEE values, and which of them keep zeros."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Fn = Callable[[Column], Column]
INF = float("inf")


def over(x: Column) -> Column:
    """1 / x with IEEE results, by the sign of a zero, too; a plain division by zero is an error."""
    at_zero = F.when(x.cast("string") == "-0.0", F.lit(-INF)).otherwise(F.lit(INF))
    return F.when(x == 0, at_zero).otherwise(F.lit(1.0) / F.when(x == 0, F.lit(1.0)).otherwise(x))


def logarithm(f: Fn, name: str) -> Fn:
    """-Inf at zero and an error below, where the plain function gives null."""
    return lambda v: F.when(v == 0, F.lit(-INF)).when(v < 0, F.raise_error(F.lit(f"{name} of a negative number")).cast("double")).otherwise(f(v))


def degrees_of(f: Fn) -> Fn:
    return lambda v: F.degrees(f(v))


def of_turns(f: Fn, half: float, exact: dict[float, float]) -> Fn:
    """f of an angle of which ``half`` is pi, with the given values at exact angles of 0 to 2 * half; others are reduced to one turn before."""

    def value(v: Column) -> Column:
        angle = F.pmod(v, F.lit(2 * half))
        out = f(angle * (math.pi / half))
        for at, is_ in exact.items():
            out = F.when(angle == at, F.lit(is_)).otherwise(out)
        return out

    return value


#: The exact sines, cosines and tangents of a turn.
SIN = {0: 0.0, 30: 0.5, 90: 1.0, 150: 0.5, 180: 0.0, 210: -0.5, 270: -1.0, 330: -0.5}
COS = {0: 1.0, 60: 0.5, 90: 0.0, 120: -0.5, 180: -1.0, 240: -0.5, 270: 0.0, 300: 0.5}
TAN = {0: 0.0, 45: 1.0, 90: INF, 135: -1.0, 180: 0.0, 225: 1.0, 270: -INF, 315: -1.0}

sind, cosd, tand = (of_turns(f, 180.0, {float(k): x for k, x in exact.items()}) for f, exact in ((F.sin, SIN), (F.cos, COS), (F.tan, TAN)))
sinpi, cospi = (of_turns(f, 1.0, {k / 180: x for k, x in exact.items() if k % 90 == 0}) for f, exact in ((F.sin, SIN), (F.cos, COS)))


#: Functions with f(0) = 0.
KEEPS_ZERO: dict[str, Fn] = {
    "abs": F.abs, "abs2": lambda v: v * v, "sqrt": F.sqrt, "cbrt": F.cbrt, "sign": F.signum,
    "floor": lambda v: F.floor(v).cast("double"), "ceil": lambda v: F.ceil(v).cast("double"),
    "trunc": lambda v: F.signum(v) * F.floor(F.abs(v)), "round": lambda v: F.bround(v, 0),
    "log1p": lambda v: F.when(v == -1, F.lit(-INF)).otherwise(F.log1p(v)), "expm1": F.expm1,
    "sin": F.sin, "tan": F.tan, "asin": F.asin, "atan": F.atan, "sinh": F.sinh, "tanh": F.tanh, "asinh": F.asinh, "atanh": F.atanh,
    "sinpi": sinpi, "sind": sind, "tand": tand, "asind": degrees_of(F.asin), "atand": degrees_of(F.atan),
}

#: Functions with another value at 0, so that results store every cell.
FILLS_ZERO: dict[str, Fn] = {
    "exp": F.exp, "exp2": lambda v: F.pow(F.lit(2.0), v), "exp10": lambda v: F.pow(F.lit(10.0), v),
    "log": logarithm(F.ln, "log"), "log2": logarithm(F.log2, "log2"), "log10": logarithm(F.log10, "log10"),
    "cos": F.cos, "acos": F.acos, "cosh": F.cosh, "cospi": cospi, "cosd": cosd, "acosd": degrees_of(F.acos),
    "csc": lambda v: over(F.sin(v)), "sec": lambda v: over(F.cos(v)), "cot": lambda v: over(F.tan(v)),
    "cscd": lambda v: over(sind(v)), "secd": lambda v: over(cosd(v)), "cotd": lambda v: over(tand(v)),
    "csch": lambda v: over(F.sinh(v)), "sech": lambda v: over(F.cosh(v)), "coth": lambda v: over(F.tanh(v)),
    "acot": lambda v: F.atan(over(v)), "acotd": lambda v: F.degrees(F.atan(over(v))), "acsch": lambda v: F.asinh(over(v)), "asech": lambda v: F.acosh(over(v)),
}
