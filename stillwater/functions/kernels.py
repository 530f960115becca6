"""Window expressions over a panel (id, t): the building blocks of every feature family.

All use one window specification, so a family needs one shuffle on id and one
sort; recursions are written in closed form (no Python in the hot path).
"""

from __future__ import annotations

import math

PART = "partition by id order by t"


def d(value: float) -> str:
    """A double literal in either dialect."""
    return f"{float(value)!r}" if "e" in repr(float(value)) else f"{float(value)!r}e0"


def cum(expr: str, f: str = "sum") -> str:
    return f"{f}({expr}) over ({PART} rows between unbounded preceding and current row)"


def roll(expr: str, w: int, f: str = "sum") -> str:
    return f"{f}({expr}) over ({PART} rows between {w - 1} preceding and current row)"


def lag(expr: str, k: int = 1) -> str:
    return f"lag({expr}, {k}) over ({PART})"


def seen(w: int) -> str:
    return f"least(t, {w})"


#: Online steps that a scaled running sum holds for the fastest rate used (0.3): 0.7^-1900 is below the largest double.  stored.py refuses longer series.
LONGEST = 1900


def ewma(expr: str, lam: float, start: float = 0.0) -> str:
    """y_t = (1-l) y_{t-1} + l x_t from y_0 = start, as a scaled running sum; (1-l)^-t must be a finite double, see LONGEST."""
    keep = d(1 - lam)
    return f"(power({keep}, t) * ({d(start)} + {cum(f'{d(lam)} * ({expr}) * power({keep}, -t)')}))"


def warm(expr: str, least: int = 5) -> str:
    return f"case when t >= {least} then {expr} end"


def r6(expr: str, name: str, digits: int = 6) -> str:
    """Rounded for comparison; adding zero makes a negative zero positive."""
    return f"round({expr}, {digits}) + 0e0 as {name}"


def clip(expr: str, low: float, high: float) -> str:
    return f"greatest({d(low)}, least({d(high)}, {expr}))"


def bernoulli_gain(p0: float, p1: float) -> tuple[str, str]:
    """Log-likelihood gains of a hit and of a miss."""
    return d(math.log(p1 / p0)), d(math.log((1 - p1) / (1 - p0)))
