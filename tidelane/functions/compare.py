"""Comparison of results with tolerance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def beyond(expected: Column, actual: Column, absolute: float = 1e-6, relative: float = 1e-9) -> Column:
    """True where the two are further apart than absolute + relative |expected|, or only one is null; never null."""
    far = F.abs(expected - actual) > F.lit(absolute) + F.lit(relative) * F.abs(expected)
    return F.coalesce(far, expected.isNull() != actual.isNull())


def _leaves(value: object, path: str, out: dict[str, object]) -> dict[str, object]:
    """Every node of a JSON value by its path; containers stand as their kind and, for arrays, length."""
    if isinstance(value, dict):
        out[path] = (dict, None)
        for k, v in value.items():
            _leaves(v, f"{path}.{k}", out)
    elif isinstance(value, list):
        out[path] = (list, len(value))
        for i, v in enumerate(value):
            _leaves(v, f"{path}[{i}]", out)
    else:
        out[path] = value
    return out


def json_differences(expected: object, actual: object, absolute: float = 1e-6, relative: float = 1e-9) -> list[tuple[str, str]]:
    """(path, what) of every difference of two parsed JSON values, by path; kind is missing, unexpected, length or value.

    Nodes below one that is missing, unexpected or of another kind are not listed, nor are elements past the shorter
    of two arrays, whose length is.
    """
    a, b = _leaves(expected, "$", {}), _leaves(actual, "$", {})
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    found: dict[str, str] = {}
    closed: list[str] = []
    for path in [*a, *(p for p in b if p not in a)]:
        if any(path.startswith((f"{c}.", f"{c}[")) for c in closed):
            continue
        x, y = a.get(path), b.get(path)
        if path not in a or path not in b:
            parent = path[: path.rfind("[")] if path.endswith("]") else None
            if parent is None or found.get(parent) != "length":
                found[path] = "missing" if path in a else "unexpected"
            closed.append(path)
        elif isinstance(x, tuple) and isinstance(y, tuple) and x[0] is y[0]:
            if x[1] != y[1]:
                found[path] = "length"
        elif number(x) and number(y):
            if abs(x - y) > absolute + relative * abs(x):
                found[path] = "value"
        elif type(x) is not type(y) or x != y:
            found[path] = "value"
            closed.append(path)
    return sorted(found.items())
