"""The attribute filter language, compiled to two-valued Spark columns.

A filter is ``[attribute, operator, value]``, ``["And", [f...]]``, ``["Or", [f...]]`` or ``["Not", f]``.
Every leaf is true or false, never null: null equals null only, values of different kinds are never
equal and never ordered, numbers compare exactly as integers or else as doubles, and text compares by bytes.
Leaves over typed columns stay plain comparisons, which Spark pushes into the Parquet scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, FractionalType, IntegralType, LongType, StringType, StructType

#: The operators.
COMPARISONS = ("Eq", "NotEq", "Lt", "Lte", "Gt", "Gte", "In", "NotIn")
JUNCTIONS = ("And", "Or", "Not")

_LONG, _DOUBLE = LongType(), DoubleType()


class FilterError(ValueError):
    """A filter that the language does not allow."""


def _kind(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int" if -(1 << 63) <= value < 1 << 63 else "float"
    if isinstance(value, float):
        return "float"
    if isinstance(value, str):
        return "text"
    raise FilterError(f"a value is null, a boolean, a number or text, not {value!r}")


def _sure(column: Column, test: Column) -> Column:
    """The test, false for null; in this form Spark hands it to the scan."""
    return column.isNotNull() & test


def _order(a: Column, op: str, b: Column) -> Column:
    return {"Eq": a == b, "Lt": a < b, "Lte": a <= b, "Gt": a > b, "Gte": a >= b}[op]


class Typed:
    """A column of one type."""

    def __init__(self, column: Column, kind: DataType):
        self.column, self.kind = column, kind

    def null(self) -> Column:
        return self.column.isNull()

    def test(self, op: str, value: Any) -> Column:
        want = _kind(value)
        if isinstance(self.kind, BooleanType):
            return _sure(self.column, self.column == F.lit(value)) if want == "bool" and op == "Eq" else F.lit(False)
        if isinstance(self.kind, StringType):
            return _sure(self.column, _order(self.column, op, F.lit(value))) if want == "text" else F.lit(False)
        if want not in ("int", "float") or want == "float" and math.isnan(value):
            return F.lit(False)
        if isinstance(self.kind, IntegralType):
            if want == "int":
                return _sure(self.column, _order(self.column, op, F.lit(value)))
            return _sure(self.column, _order(self.column.cast("double"), op, F.lit(float(value))))
        if isinstance(self.kind, FractionalType):
            column = self.column.cast("double")
            test = _order(column, op, F.lit(float(value)))
            # Spark orders NaN above all numbers; here it compares with nothing.
            return _sure(column, test & ~F.isnan(column)) if op in ("Gt", "Gte") else _sure(column, test)
        return F.lit(False)


class Tagged:
    """A column of structs (b, i, f, s) of which at most one field is set: cells of mixed kinds."""

    def __init__(self, column: Column):
        self.parts = {n: Typed(column[n], t) for n, t in zip("bifs", (BooleanType(), _LONG, _DOUBLE, StringType()))}

    def null(self) -> Column:
        return reduce(lambda a, b: a & b, (p.null() for p in self.parts.values()))

    def test(self, op: str, value: Any) -> Column:
        names = {"bool": "b", "int": "if", "float": "if", "text": "s"}[_kind(value)]
        return reduce(lambda a, b: a | b, (self.parts[n].test(op, value) for n in names))


class Missing:
    """An attribute that no row has: null everywhere."""

    def null(self) -> Column:
        return F.lit(True)

    def test(self, op: str, value: Any) -> Column:
        _kind(value)
        return F.lit(False)


def _equal(cell: Typed | Tagged | Missing, value: Any) -> Column:
    return cell.null() if _kind(value) == "null" else cell.test("Eq", value)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def compile_with(expr: Any, cell_of: Callable[[str], Typed | Tagged | Missing]) -> Column:
    """The filter as a column; ``cell_of`` finds an attribute's cells."""
    if not isinstance(expr, (list, tuple)) or len(expr) < 2 or not isinstance(expr[0], str):
        raise FilterError(f"not a filter: {expr!r}")
    head = expr[0]
    if head in JUNCTIONS and len(expr) == 2:
        if head == "Not":
            return ~compile_with(expr[1], cell_of)
        if not isinstance(expr[1], (list, tuple)):
            raise FilterError(f"{head} takes a list of filters")
        parts = [compile_with(e, cell_of) for e in expr[1]]
        if head == "Or":
            return _any(parts)
        return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)
    if len(expr) != 3 or expr[1] not in COMPARISONS:
        raise FilterError(f"not a comparison: {expr!r}")
    cell, op, value = cell_of(head), expr[1], expr[2]
    if op in ("In", "NotIn"):
        if not isinstance(value, (list, tuple)):
            raise FilterError(f"{op} takes a list")
        inside = _any([_equal(cell, v) for v in value])
        return inside if op == "In" else ~inside
    if op in ("Eq", "NotEq"):
        same = _equal(cell, value)
        return same if op == "Eq" else ~same
    return F.lit(False) if _kind(value) == "null" else cell.test(op, value)


def compile_filter(expr: Any, schema: StructType, id_col: str = "id") -> Column:
    """The filter over a table of typed columns; ``id`` names the id column, unknown names are null."""
    fields = {f.name: f.dataType for f in schema.fields}

    def cell_of(name: str) -> Typed | Missing:
        column = id_col if name == "id" else name
        return Typed(F.col(f"`{column}`"), fields[column]) if column in fields else Missing()

    return compile_with(expr, cell_of)


def compile_tagged(expr: Any, attrs: Column, id_column: Column) -> Column:
    """The filter over a map of tagged cells."""
    return compile_with(expr, lambda name: Typed(id_column, _LONG) if name == "id" else Tagged(F.element_at(attrs, name)))


def compile_cells(expr: Any, cells: Column, names: Sequence[str], id_column: Column) -> Column:
    """The filter over a struct of tagged cells with those names; its leaves reach a Parquet scan like typed columns do."""

    def cell_of(name: str) -> Typed | Tagged | Missing:
        if name == "id":
            return Typed(id_column, _LONG)
        return Tagged(cells[name]) if name in names else Missing()

    return compile_with(expr, cell_of)
