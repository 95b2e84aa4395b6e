"""The algebra of dynamically typed scalars, as column expressions.

Values are typed columns. Where two types meet, the wider one decides: text, then whole numbers by size, then durations,
then floats. Division by zero gives 0; sums that overflow give null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds of each unit.
UNITS_US = {"usec": 1, "msec": 1_000, "sec": 1_000_000, "min": 60_000_000, "hr": 3_600_000_000}


@dataclass(frozen=True, order=True)
class Period:
    """A duration in whole microseconds, with integer arithmetic."""

    us: int

    @classmethod
    def of(cls, n: int, unit: str) -> Period:
        return cls(n * UNITS_US[unit])

    def __add__(self, other: Period) -> Period:
        return Period(self.us + other.us)

    def __sub__(self, other: Period) -> Period:
        return Period(self.us - other.us)

    def __mul__(self, n: int) -> Period:
        return Period(self.us * n)

    def __floordiv__(self, other: int | Period):
        return Period(self.us // other) if isinstance(other, int) else self.us // other.us


def add(a: Column, b: Column) -> Column:
    return F.try_add(a, b)


def subtract(a: Column, b: Column) -> Column:
    return F.try_subtract(a, b)


def multiply(a: Column, b: Column) -> Column:
    return F.try_multiply(a, b)


def divide(a: Column, b: Column) -> Column:
    """a / b as double, 0 where b is 0; operands never change places."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)))


def int_divide(a: Column, b: Column) -> Column:
    """Whole division towards zero, 0 where b is 0."""
    zero = F.lit(0).cast("long")
    return F.when(b == 0, zero).otherwise(F.call_function("div", a.cast("long"), F.nullif(b.cast("long"), zero)))


def text_add(a: Column, b: Column) -> Column:
    return F.concat(a, b)


#: Which of two types decides what an operation gives; the left one where they are equal.
SCORES = {"string": 1, "byte": 10, "short": 20, "int": 40, "long": 80, "float": 80, "duration": 82, "double": 160}
_WHOLE = ("byte", "short", "int", "long", "duration")


@dataclass(frozen=True)
class Typed:
    """A column with the type that it plays: durations are nanoseconds as longs. + - * / give the higher type's result.

    Texts that are no number count as 0 among whole numbers and as NaN among floats; texts are joined by + and by -
    (with the other's sign turned), and * and / leave the left one as it is. The operands of / never change places.
    """

    column: Column
    kind: str

    def _to(self, kind: str) -> Column:
        if self.kind == kind:
            return self.column
        if kind == "string":
            return show(self.column, self.kind)
        if kind in _WHOLE:
            whole = parse_whole(self.column) if self.kind == "string" else to_whole(self.column)
            return whole.cast("long" if kind == "duration" else kind)
        return (parse_float(self.column) if self.kind == "string" else self.column).cast(kind)

    def _with(self, other: Typed) -> tuple[str, Column, Column]:
        kind = other.kind if SCORES[other.kind] > SCORES[self.kind] else self.kind
        return kind, self._to(kind), other._to(kind)

    def __add__(self, other: Typed) -> Typed:
        kind, a, b = self._with(other)
        return Typed(text_add(a, b) if kind == "string" else add(a, b), kind)

    def __neg__(self) -> Typed:
        return Typed(negate_text(self.column) if self.kind == "string" else negate(self.column), self.kind)

    def __sub__(self, other: Typed) -> Typed:
        kind, a, b = self._with(other)
        return self + -other if kind == "string" else Typed(subtract(a, b), kind)

    def __mul__(self, other: Typed) -> Typed:
        kind, a, b = self._with(other)
        return Typed(a if kind == "string" else multiply(a, b), kind)

    def __truediv__(self, other: Typed) -> Typed:
        kind, a, b = self._with(other)
        return Typed(a if kind == "string" else int_divide(a, b) if kind in _WHOLE else divide(a, b), kind)


def negate(a: Column) -> Column:
    return -a


def negate_text(a: Column) -> Column:
    """A numeric text with its sign turned; other texts stay."""
    number = F.try_to_number(F.ltrim(a), F.lit("S99999999999999999999.99999999"))
    turned = F.when(a.startswith("-"), F.substring(a, 2, 1 << 30)).otherwise(F.concat(F.lit("-"), a))
    return F.when(number.isNull() & a.try_cast("double").isNull(), a).otherwise(turned)


def invert(a: Column) -> Column:
    return F.bitwise_not(a)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by native typed comparison."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def to_whole(a: Column) -> Column:
    """Floats to whole numbers: rounds half away from zero."""
    return F.round(a).cast("long")


def parse_whole(a: Column) -> Column:
    """Texts to whole numbers: as whole number, else as rounded float, else 0."""
    return F.coalesce(a.try_cast("long"), F.round(a.try_cast("double")).cast("long"), F.lit(0).cast("long"))


def parse_float(a: Column) -> Column:
    return F.coalesce(a.try_cast("double"), F.lit(float("nan")))


def nanos(a: Column) -> Column:
    """Plain numbers count as nanoseconds."""
    return a.cast("long")


def convert(a: Column, from_unit: str, to_unit: str) -> Column:
    """Whole durations between units, truncating."""
    return F.call_function("div", a.cast("long") * UNITS_US[from_unit], F.lit(UNITS_US[to_unit]).cast("long"))


def hash_value(a: Column) -> Column:
    return F.xxhash64(a)


def show(a: Column, kind: str = "double") -> Column:
    """Floats with six decimals, whole numbers and texts plain."""
    return F.format_string("%.6f", a.cast("double")) if kind in ("float", "double") else a.cast("string")


def scale(a: Column, factor: Column) -> Column:
    return F.when(factor.isNotNull(), a * factor).otherwise(a)
