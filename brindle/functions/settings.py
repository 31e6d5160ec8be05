"""Settings documents: merged, checked and compared. They are small and live on the driver."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def merged(base: Mapping[str, Any], changes: Mapping[str, Any]) -> dict[str, Any]:
    """``base`` with ``changes`` put in; sections go into each other, any other value takes the place of the old one."""
    out = dict(base)
    for key, value in changes.items():
        old = out.get(key)
        out[key] = merged(old, value) if isinstance(old, Mapping) and isinstance(value, Mapping) else value
    return out


def problems(settings: Mapping[str, Any], rules: Mapping[str, Callable[[Any], bool]], path: str = "") -> list[str]:
    """Sorted names (with dots) that no rule knows, or whose value breaks its rule."""
    out = []
    for key, value in settings.items():
        name = f"{path}{key}"
        if isinstance(value, Mapping) and name not in rules:
            out += problems(value, rules, name + ".")
        elif name not in rules or not rules[name](value):
            out.append(name)
    return sorted(out)


def between(low: float, high: float, null: bool = False) -> Callable[[Any], bool]:
    """A rule for numbers; with ``null`` a missing value, which turns a setting off, is fine too."""
    return lambda v: (null and v is None) or (isinstance(v, (int, float)) and not isinstance(v, bool) and low <= v <= high)


@F.pandas_udf(StringType())
def unified_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """The lines of a unified diff of two texts, without its head."""
    return pd.Series(["\n".join(list(difflib.unified_diff((a or "").split("\n"), (b or "").split("\n"), lineterm=""))[2:]) for a, b in zip(before, after, strict=True)])
