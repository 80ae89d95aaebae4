"""Literals as SQL text."""

from __future__ import annotations

import math

from .types import ElementType, checked


def literal(value: object, t: ElementType) -> str:
    """SQL for a value of an element type, of exactly its Spark type."""
    return f"cast({_plain(checked(value, t))} as {t.spark})"


def _plain(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, int):
        return str(v) if abs(v) < 1 << 63 else f"cast('{v}' as decimal(38,0))"
    if isinstance(v, float):
        return f"double('{'NaN' if math.isnan(v) else 'Infinity' if v > 0 else '-Infinity'}')" if math.isnan(v) or math.isinf(v) else f"double('{v!r}')"
    if isinstance(v, bytes):
        return f"x'{v.hex()}'"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, list):
        return "array(" + ", ".join(map(_plain, v)) + ")"
    return "named_struct(" + ", ".join(f"'{k}', {_plain(x)}" for k, x in v.items()) + ")"
