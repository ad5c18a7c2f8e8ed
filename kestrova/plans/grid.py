"""Parameter grids and walk-forward dates: plain driver-side planning."""

from __future__ import annotations

import inspect
import random
from collections.abc import Callable
from datetime import date
from itertools import product


def universe(grid: dict[str, list]) -> list[dict]:
    """Every combination of the lists, the last key fastest."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def random_universe(grid: dict[str, list], n: int, seed: int | None = None) -> list[dict]:
    """n combinations without repetition (all, if there are fewer)."""
    every = universe(grid)
    return every if n >= len(every) else random.Random(seed).sample(every, n)


def parameters(function: Callable) -> list[str]:
    """The names of a function's parameters, without self."""
    return [p for p in inspect.signature(function).parameters if p != "self"]


def _add_months(day: date, months: int) -> date:
    year, month = divmod(day.year * 12 + day.month - 1 + months, 12)
    last = (date(year + (month == 11), (month + 1) % 12 + 1, 1) - date(year, month + 1, 1)).days
    return date(year, month + 1, min(day.day, last))


def months(span: str) -> int:
    """'4Y' or '6M' as months."""
    if span[-1:] not in ("Y", "M") or not span[:-1].isdigit():
        raise ValueError(f"a span is a number and Y or M, not {span!r}")
    return int(span[:-1]) * (12 if span[-1] == "Y" else 1)


def walk_forward(first: date, last: date, train: str, test: str) -> list[tuple[date, date, date, date]]:
    """(train from, train to, test from, test to), moved on by ``test`` each time, as
    long as the test span ends by ``last``."""
    out, start = [], first
    while True:
        middle = _add_months(start, months(train))
        end = _add_months(middle, months(test))
        if end > last:
            return out
        out.append((start, middle, middle, end))
        start = _add_months(start, months(test))


def canonical(point: dict) -> dict:
    """A grid point without the knobs that have no effect: no smoothing ignores both,
    a plain mean ignores the decay. Points with equal canonical forms share one
    column, however many names it gets."""
    out = dict(point)
    if out.get("smoothing_method") is None:
        out["window_smooth"] = out["lambda_smooth"] = None
    elif out["smoothing_method"] == "average":
        out["lambda_smooth"] = None
    return out
