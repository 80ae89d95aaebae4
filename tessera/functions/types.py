"""Element types of stores, and how each is held in a DataFrame.

Spark has no unsigned, half or complex types: unsigned ones are held in the next wider signed type (uint64 in decimal(20,0)) with a range
check on entry, half as float, complex as struct<re,im>. Points are structs of longs p0, p1, ...; rectangles structs of two points with
inclusive bounds.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

MAX_DIM = 6

#: name: (Spark type, NumPy type, bytes)
PRIMITIVES = {
    "bool": ("boolean", "?", 1), "int8": ("tinyint", "i1", 1), "int16": ("smallint", "i2", 2), "int32": ("int", "i4", 4), "int64": ("bigint", "i8", 8),
    "uint8": ("smallint", "u1", 1), "uint16": ("int", "u2", 2), "uint32": ("bigint", "u4", 4), "uint64": ("decimal(20,0)", "u8", 8),
    "float16": ("float", "f2", 2), "float32": ("float", "f4", 4), "float64": ("double", "f8", 8),
    "complex64": ("struct<re:float,im:float>", "c8", 8), "complex128": ("struct<re:double,im:double>", "c16", 16), "null": ("void", None, 0),
}


@dataclass(frozen=True)
class ElementType:
    """name, and for compound types their parts: of (element types), n (length or rank)."""

    name: str
    of: tuple[ElementType, ...] = ()
    n: int = 0
    align: bool = False

    @property
    def fixed(self) -> bool:
        return self.name not in ("string", "list") and all(t.fixed for t in self.of)

    @cached_property
    def spark(self) -> str:
        if self.name in PRIMITIVES:
            return PRIMITIVES[self.name][0]
        point = "struct<" + ",".join(f"p{k}:bigint" for k in range(self.n)) + ">"
        return {
            "binary": lambda: "binary", "string": lambda: "string", "array": lambda: f"array<{self.of[0].spark}>", "list": lambda: f"array<{self.of[0].spark}>",
            "struct": lambda: "struct<" + ",".join(f"f{k}:{t.spark}" for k, t in enumerate(self.of)) + ">",
            "point": lambda: point, "rect": lambda: f"struct<lo:{point},hi:{point}>",
        }[self.name]()

    @property
    def size(self) -> int:
        if not self.fixed:
            raise ValueError(f"{self} has no fixed size")
        if self.name in PRIMITIVES:
            return PRIMITIVES[self.name][2]
        if self.name == "struct":
            at = 0
            for t in self.of:
                at += -at % t.alignment if self.align else 0
                at += t.size
            return at + (-at % self.alignment if self.align else 0)
        return {"binary": self.n, "point": 8 * self.n, "rect": 16 * self.n}.get(self.name) or self.n * self.of[0].size

    @property
    def alignment(self) -> int:
        if self.name in PRIMITIVES:
            return max(1, self.size // 2 if self.name.startswith("complex") else self.size)
        if self.name == "struct":
            return max((t.alignment for t in self.of), default=1) if self.align else 1
        return {"binary": 1, "point": 8, "rect": 8}.get(self.name) or self.of[0].alignment

    @property
    def numpy(self) -> np.dtype:
        if self.name in PRIMITIVES and PRIMITIVES[self.name][1]:
            return np.dtype(PRIMITIVES[self.name][1])
        if self.name == "binary":
            return np.dtype(f"V{self.n}")
        if self.name == "point":
            return np.dtype([(f"p{k}", "i8") for k in range(self.n)])
        if self.name == "rect":
            return np.dtype([("lo", point(self.n).numpy), ("hi", point(self.n).numpy)])
        if self.name == "array":
            return np.dtype((self.of[0].numpy, (self.n,)))
        if self.name == "struct":
            return np.dtype([(f"f{k}", t.numpy) for k, t in enumerate(self.of)], align=self.align)
        raise ValueError(f"{self} has no NumPy type")

    @property
    def is_complex(self) -> bool:
        return self.name.startswith("complex")

    @property
    def is_integer(self) -> bool:
        return self.name.startswith(("int", "uint"))

    @property
    def is_float(self) -> bool:
        return self.name.startswith("float")

    def limits(self) -> tuple[int, int]:
        info = np.iinfo(self.numpy)
        return int(info.min), int(info.max)

    def __str__(self) -> str:
        inner = ",".join(map(str, self.of)) or (str(self.n) if self.n else "")
        return f"{self.name}({inner})" if inner else self.name


def primitive(name: str) -> ElementType:
    if name not in PRIMITIVES:
        raise ValueError(f"unknown type {name}")
    return ElementType(name)


bool_, int8, int16, int32, int64 = (ElementType(n) for n in ("bool", "int8", "int16", "int32", "int64"))
uint8, uint16, uint32, uint64 = (ElementType(n) for n in ("uint8", "uint16", "uint32", "uint64"))
float16, float32, float64, complex64, complex128 = (ElementType(n) for n in ("float16", "float32", "float64", "complex64", "complex128"))
null_type, string_type = ElementType("null"), ElementType("string")


def binary_type(n: int) -> ElementType:
    if n <= 0:
        raise ValueError("a binary type needs a positive size")
    return ElementType("binary", n=n)


def array_type(of: ElementType, n: int) -> ElementType:
    if not of.fixed:
        raise ValueError("elements must have a fixed size")
    return ElementType("array", (of,), n)


def list_type(of: ElementType) -> ElementType:
    if not of.fixed:
        raise ValueError("elements must have a fixed size")
    return ElementType("list", (of,))


def struct_type(of: list[ElementType], align: bool = False) -> ElementType:
    if not all(t.fixed for t in of):
        raise ValueError("fields must have a fixed size")
    return ElementType("struct", tuple(of), align=align)


def _rank(n: int) -> int:
    if not 1 <= n <= MAX_DIM:
        raise ValueError(f"rank {n} is not in 1..{MAX_DIM}")
    return n


def point(n: int) -> ElementType:
    return ElementType("point", n=_rank(n))


def rect(n: int) -> ElementType:
    return ElementType("rect", n=_rank(n))


def of_dtype(dtype: np.dtype | str) -> ElementType:
    d = np.dtype(dtype)
    if d.kind == "V" and d.names is None:
        return binary_type(d.itemsize)
    for name, (_, code, _) in PRIMITIVES.items():
        if code and np.dtype(code) == d:
            return ElementType(name)
    raise ValueError(f"no element type for {d}")


def of_value(value: object) -> ElementType:
    """The type of a Python value: int64, float64, complex128, bool, string, bytes, or an array of numbers."""
    if isinstance(value, np.generic):
        return of_dtype(value.dtype)
    if isinstance(value, bool):
        return bool_
    if value is None:
        return null_type
    for kind, t in ((int, int64), (float, float64), (complex, complex128), (str, string_type)):
        if isinstance(value, kind):
            return t
    if isinstance(value, bytes):
        return binary_type(len(value))
    if isinstance(value, (list, tuple)) and value:
        inner = {of_value(v) for v in value}
        if len(inner) == 1:
            return array_type(inner.pop(), len(value))
    raise TypeError(f"no element type for {type(value).__name__}")


def checked(value: object, t: ElementType) -> object:
    """A value as Spark gets it; out of range or of another kind raises."""
    if t.is_complex:
        z = complex(value)
        return {"re": z.real, "im": z.imag}
    if t.name == "bool":
        return bool(value)
    if t.is_integer:
        lo, hi = t.limits()
        if int(value) != value or not lo <= int(value) <= hi:
            raise ValueError(f"{value!r} is no {t}")
        return int(value)
    if t.name == "float16":
        return float(np.float16(value))
    if t.is_float:
        return float(value)
    if t.name == "binary":
        if len(value) != t.n:
            raise ValueError(f"binary of {len(value)} bytes for {t}")
        return bytes(value)
    if t.name == "array":
        if len(value) != t.n:
            raise ValueError(f"{len(value)} elements for {t}")
        return [checked(v, t.of[0]) for v in value]
    if t.name == "point":
        return {f"p{k}": int(v) for k, v in enumerate(value)}
    if t.name == "rect":
        return {"lo": checked(value[0], point(t.n)), "hi": checked(value[1], point(t.n))}
    if t.name == "struct":
        return {f"f{k}": checked(v, f) for k, (v, f) in enumerate(zip(value, t.of, strict=True))}
    return value
