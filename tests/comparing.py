"""Row-by-row comparison of two frames, whatever the order of rows and columns."""

from __future__ import annotations

import math


def cell(x) -> str:
    if x is None or type(x).__name__ in ("NAType", "NaTType") or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    name = type(x).__name__
    if name in ("bool", "bool_"):
        return str(bool(x))
    if name.startswith(("int", "uint")):
        return str(int(x))
    if name.startswith("float") or name == "Decimal":
        return f"{float(x) + 0.0:.4f}"
    return str(x)[:10] if name in ("Timestamp", "date", "datetime") else str(x)


def rows(frame) -> list[tuple[str, ...]]:
    columns = sorted(frame.columns)
    return sorted(tuple(map(cell, r)) for r in frame[columns].itertuples(index=False, name=None))


def assert_same(left, right) -> None:
    assert sorted(left.columns) == sorted(right.columns)
    a, b = rows(left), rows(right)
    assert len(a) == len(b)
    odd = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not odd, odd[:3]
