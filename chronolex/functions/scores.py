"""Association scores as Columns of the counts N, f1, f2 and f12. A score that isn't finite is null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def log2(x: Column) -> Column:
    """Null where the logarithm isn't finite."""
    return F.when(x > 0, F.log2(x))


def ln0(x: Column) -> Column:
    """Natural logarithm, 0 where there is none."""
    return F.when(x > 0, F.ln(x)).otherwise(F.lit(0.0))


def finite(x: Column) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def _f(n: Column, f1: Column, f2: Column, f12: Column, eps: float) -> Column:
    return f12


def _fm(n, f1, f2, f12, eps):
    return _ratio(f12 * 1e6, n)


def _lf(n, f1, f2, f12, eps):
    return log2(f12 + eps)


def _lfm(n, f1, f2, f12, eps):
    return log2(f12 + eps) - (log2(n + eps) - log2(F.lit(1e6 + eps)))


def _mi(n, f1, f2, f12, eps, power: int = 1):
    return log2(_ratio(F.pow(f12 + eps, F.lit(float(power))) * (n + eps), (f1 + eps) * (f2 + eps)))


def _mi3(n, f1, f2, f12, eps):
    return _mi(n, f1, f2, f12, eps, 3)


def _milf(n, f1, f2, f12, eps):
    # The second factor smooths a count that is smoothed already; this is how the score is defined.
    x = f12 + eps
    return log2(x) * log2(_ratio((x + eps) * (n + eps), (f1 + eps) * (f2 + eps)))


def _ld(n, f1, f2, f12, eps):
    return 14 + log2(_ratio(2 * (f12 + eps), f1 + f2 + 2 * eps))


def _ll(n, f1, f2, f12, eps):
    """Signed ln(1 + likelihood ratio) of the two-by-two table; negative where the pair is rarer than by chance."""
    n, f1, f12 = n + 2 * eps, f1 + eps, f12 + eps
    ratio = F.lit(0.0)
    for seen, row, col in ((f12, f1, f2), (f1 - f12, f1, n - f2), (f2 - f12, n - f1, f2), (n - f1 - f2 + f12, n - f1, n - f2)):
        ratio = ratio + seen * ln0(F.coalesce(_ratio(seen * n, row * col), F.lit(0.0)))
    return F.when(f12 * n < f1 * f2, F.lit(-1.0)).otherwise(F.lit(1.0)) * ln0(1 + ratio)


SCORES: dict[str, Callable[..., Column]] = {"f": _f, "fm": _fm, "lf": _lf, "lfm": _lfm, "milf": _milf, "mi1": _mi, "mi3": _mi3, "ld": _ld, "ll": _ll}
#: Other names of the scores.
ALIASES = {"mi": "milf", "pmi": "mi1", "logdice": "ld", "log-dice": "ld", "loglik": "ll", "log-likelihood": "ll"}


def score(name: str, n: Column, f1: Column, f2: Column, f12: Column, eps: float = 0.0) -> Column:
    """The named score as a double."""
    key = name.lower()
    made = SCORES[ALIASES.get(key, key)]
    n, f1, f2, f12 = (c.cast("double") for c in (n, f1, f2, f12))
    return finite(made(n, f1, f2, f12, eps))
