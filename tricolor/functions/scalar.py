"""Scalar column functions: derived features, score post-processing, grid builders.

All are JVM expressions (whole-stage codegen), never Python row loops.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The derived-feature operations and the divide guard.
FEATURE_OPS = ["Add", "Subtract", "Multiply", "Divide", "Log", "Square"]
DIVIDE_EPS = 1e-9
# Traffic-light names and default thresholds (inclusive).
GREEN, YELLOW, RED = "Green", "Yellow", "Red"
DEFAULT_T0 = 0.85
DEFAULT_T1 = 0.85
THRESHOLD = 0.5


def _c(c) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def fn_add(a, b) -> Column:
    return _c(a).cast("double") + _c(b).cast("double")


def fn_subtract(a, b) -> Column:
    return _c(a).cast("double") - _c(b).cast("double")


def fn_multiply(a, b) -> Column:
    return _c(a).cast("double") * _c(b).cast("double")


def fn_divide(a, b) -> Column:
    """``a / (b + 1e-9)``; an exactly-zero divisor gives NULL (ANSI mode would raise)."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double") + F.lit(DIVIDE_EPS))


def fn_log(a) -> Column:
    """``ln(1 + x)``; NULL for x <= -1 (numpy gives -inf / NaN; both are dropped later)."""
    x = _c(a).cast("double")
    return F.when(x > -1.0, F.log1p(x))


def fn_square(a) -> Column:
    x = _c(a).cast("double")
    return x * x


# The operation names of derived features, with their builders.
TWO_COLUMN_FEATURES = {"Add": fn_add, "Subtract": fn_subtract, "Multiply": fn_multiply, "Divide": fn_divide}
ONE_COLUMN_FEATURES = {"Log": fn_log, "Square": fn_square}


def feature_expr(op: str, a: str, b: str | None = None) -> Column:
    """The expression of a derived feature by its operation's name."""
    if op in ONE_COLUMN_FEATURES:
        return ONE_COLUMN_FEATURES[op](a)
    if op not in TWO_COLUMN_FEATURES:
        raise ValueError(f"no feature operation is called {op!r}; there are {[*TWO_COLUMN_FEATURES, *ONE_COLUMN_FEATURES]}")
    if b is None:
        raise ValueError(f"operation {op} needs a second column")
    return TWO_COLUMN_FEATURES[op](a, b)


def default_feature_name(op: str, a: str, b: str | None = None) -> str:
    return f"{a}_{op.lower()}_{b}" if b is not None else f"{a}_{op.lower()}"


def fn_abs(a) -> Column:
    return F.abs(_c(a))


def fn_sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(z)))


def fn_threshold(score, threshold: float = THRESHOLD) -> Column:
    """``score >= 0.5`` -> 1 else 0 (NULL stays NULL)."""
    return (_c(score) >= F.lit(threshold)).cast("int")


def fn_flip_pred(pred) -> Column:
    return F.lit(1) - _c(pred)


def fn_flip_prob(prob) -> Column:
    return F.lit(1.0) - _c(prob)


def fn_flip_score(score) -> Column:
    """Continuous (PLS-DA) test scores are flipped by sign, not by 1 - p."""
    return -_c(score)


def fn_traffic(pred, prob, t0: float = DEFAULT_T0, t1: float = DEFAULT_T1) -> Column:
    """Green: pred 0 and 1-p >= t0. Red: pred 1 and p >= t1. Else Yellow."""
    if not (0.5 <= t0 <= 1.0 and 0.5 <= t1 <= 1.0):
        raise ValueError("traffic-light thresholds must lie in [0.5, 1]")
    p, y = _c(prob), _c(pred)
    return (F.when((y == 0) & ((F.lit(1.0) - p) >= F.lit(t0)), F.lit(GREEN))
            .when((y == 1) & (p >= F.lit(t1)), F.lit(RED))
            .otherwise(F.lit(YELLOW)))


def fn_round(a, digits: int = 4) -> Column:
    return F.round(_c(a), digits)


def logspace(start: float, stop: float, num: int) -> list[float]:
    """``num`` values from 10**start to 10**stop, evenly spaced in the exponent."""
    if num == 1:
        return [10.0 ** start]
    step = (stop - start) / (num - 1)
    return [10.0 ** (start + i * step) for i in range(num)]


def linspace(start: float, stop: float, num: int) -> list[float]:
    if num == 1:
        return [float(start)]
    step = (stop - start) / (num - 1)
    return [start + i * step for i in range(num)]


def int_range(start: int, stop: int, step: int = 1) -> list[int]:
    """Inclusive integer range (slider semantics)."""
    return list(range(int(start), int(stop) + 1, int(step)))
