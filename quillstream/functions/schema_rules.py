"""Schema documents compiled to one column expression: the paths of a record that break a rule, and the rules.

A record is either columns of a DataFrame or one column of JSON text.  In columns null means absent, and types are compared
with the schema's when the expression is made; in JSON a null is a value of its own type.  Either way the result is an
array of `path: rule` in the order of the schema, empty for a record that keeps all rules, and no Python runs in a task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.functions.text import once

#: What says nothing about whether a record is right.
NOTES = {"$schema", "$id", "title", "description", "examples", "default", "format"}
NONE = "array<string>"
Path = Column


@dataclass(frozen=True)
class Columns:
    """A value of a known type; no column at all stands for a field that the table does not have."""

    column: Column | None
    kind: T.DataType | None

    @property
    def present(self) -> Column:
        return F.lit(False) if self.column is None else self.column.isNotNull()

    def is_a(self, name: str) -> Column:
        if isinstance(self.kind, (T.StructType, T.MapType)):
            own = {"object"}
        elif isinstance(self.kind, T.ArrayType):
            own = {"array"}
        elif isinstance(self.kind, T.IntegralType):
            own = {"integer", "number"}
        elif isinstance(self.kind, T.NumericType):
            own = {"number"}
        elif isinstance(self.kind, T.BooleanType):
            own = {"boolean"}
        else:  # dates and times are written as text
            own = {"string"}
        return F.lit(name in own)

    def field(self, name: str) -> Columns:
        if isinstance(self.kind, T.StructType) and name in self.kind.names:
            return Columns(self.column.getField(name), self.kind[name].dataType)
        if isinstance(self.kind, T.MapType):
            return Columns(F.try_element_at(self.column, F.lit(name)), self.kind.valueType)
        return Columns(None, None)

    def has(self, name: str) -> Column:
        return self.field(name).present

    def in_field(self, name: str, check: Callable[[Columns], Column]) -> Column | None:
        """What is found in a field that the table has."""
        field = self.field(name)
        return None if field.column is None else check(field)

    def names(self) -> Column:
        if isinstance(self.kind, T.StructType):
            return F.array_compact(F.array(*[F.when(self.column.getField(n).isNotNull(), F.lit(n)) for n in self.kind.names]))
        return F.map_keys(self.column) if isinstance(self.kind, T.MapType) else F.array().cast(NONE)

    def each(self, check: Callable[[Columns, Column], Column]) -> Column:
        if not isinstance(self.kind, T.ArrayType):
            return F.array().cast(NONE)
        return F.flatten(F.transform(self.column, lambda x, i: check(Columns(x, self.kind.elementType), i)))

    def size(self) -> Column:
        return F.size(self.column) if isinstance(self.kind, T.ArrayType) else F.lit(0)

    def text(self) -> Column:
        return self.column.cast("string")

    def number(self) -> Column:
        return self.column.cast("double")


@dataclass(frozen=True)
class Json:
    """A variant and the name of its type; SQL's null is a field that is not there.

    Both are variables of a lambda, so that a text is parsed once and a field is looked at once, however many rules there are.
    """

    column: Column
    kind: Column

    @staticmethod
    def bound(column: Column, check: Callable[[Json], Column]) -> Column:
        kind = lambda v: F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)
        return once(column, lambda v: once(kind(v), lambda k: check(Json(v, k))))

    @property
    def present(self) -> Column:
        return self.column.isNotNull()

    def is_a(self, name: str) -> Column:
        own = {"string": ("STRING",), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",), "null": ("VOID",), "integer": ("BIGINT", "DECIMAL", "DOUBLE"), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")}[name]
        found = self.kind.isin(*own)
        return found & (self.number() == F.floor(self.number())) if name == "integer" else found

    def _as(self, kind: str, path: str = "$") -> Column:
        return F.try_variant_get(self.column, path, kind)

    def has(self, name: str) -> Column:
        return self._as("variant", f"$['{name}']").isNotNull()

    def in_field(self, name: str, check: Callable[[Json], Column]) -> Column:
        return Json.bound(self._as("variant", f"$['{name}']"), check)

    def names(self) -> Column:
        return F.map_keys(self._as("map<string,variant>"))

    def each(self, check: Callable[[Json, Column], Column]) -> Column:
        return F.flatten(F.transform(self._as("array<variant>"), lambda x, i: Json.bound(x, lambda v: check(v, i))))

    def size(self) -> Column:
        return F.size(self._as("array<variant>"))

    def text(self) -> Column:
        return self._as("string")

    def number(self) -> Column:
        return self._as("double")


def _child(path: Path | None, name: str) -> Path:
    return F.lit(name) if path is None else F.concat(path, F.lit(f".{name}"))


def _broken(bad: Column, path: Path | None, rule: str) -> Column:
    where = F.lit("$") if path is None else path
    return F.when(F.coalesce(bad, F.lit(False)), F.array(F.concat(where, F.lit(f": {rule}")))).otherwise(F.array().cast(NONE))


def _check(value: Columns | Json, schema: Mapping, path: Path | None) -> list[Column]:
    """Arrays of what is broken in a value that is there."""
    known = NOTES | {"type", "enum", "const", "pattern", "minLength", "maxLength", "minimum", "maximum", "minItems", "maxItems", "items", "required", "properties", "additionalProperties", "allOf", "if", "then", "else"}
    if unknown := set(schema) - known:
        raise ValueError(f"rules that are not understood: {', '.join(sorted(unknown))}")
    out: list[Column] = []
    either = lambda names: reduce(lambda a, b: a | b, [value.is_a(n) for n in names])
    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        out.append(_broken(~either(names), path, "type"))
    allowed = schema.get("enum", [schema["const"]] if "const" in schema else None)
    if allowed is not None:
        if not all(isinstance(x, str) for x in allowed):
            raise ValueError("only texts can be listed")
        out.append(_broken(~value.is_a("string") | ~value.text().isin(*allowed), path, "enum" if "enum" in schema else "const"))
    for rule, of, bad in (
        ("pattern", "string", lambda x: ~value.text().rlike(x)),
        ("minLength", "string", lambda x: F.length(value.text()) < x),
        ("maxLength", "string", lambda x: F.length(value.text()) > x),
        ("minimum", "number", lambda x: value.number() < x),
        ("maximum", "number", lambda x: value.number() > x),
        ("minItems", "array", lambda x: value.size() < x),
        ("maxItems", "array", lambda x: value.size() > x),
    ):
        if rule in schema:
            out.append(_broken(value.is_a(of) & bad(schema[rule]), path, rule))
    for name in schema.get("required", ()):
        out.append(_broken(value.is_a("object") & ~value.has(name), _child(path, name), "required"))
    for name, own in schema.get("properties", {}).items():
        if own.keys() - NOTES:
            at = _child(path, name)
            found = value.in_field(name, lambda f: F.when(f.present, _all(f, own, at)).otherwise(F.array().cast(NONE)))  # noqa: B023
            if found is not None:
                out.append(F.when(value.is_a("object"), found).otherwise(F.array().cast(NONE)))
    if schema.get("additionalProperties", True) is False:
        more = F.array_except(value.names(), F.array(*[F.lit(n) for n in schema.get("properties", {})]).cast(NONE))
        told = F.transform(more, lambda n: F.concat(n if path is None else F.concat(path, F.lit("."), n), F.lit(": additionalProperties")))
        out.append(F.when(value.is_a("object"), told).otherwise(F.array().cast(NONE)))
    if "items" in schema:
        def item(x: Columns | Json, i: Column) -> Column:
            at = F.concat(F.lit("$") if path is None else path, F.lit("["), i.cast("string"), F.lit("]"))
            missing = _broken(F.lit(True), at, "type") if "type" in schema["items"] else F.array().cast(NONE)
            return F.when(x.present, _all(x, schema["items"], at)).otherwise(missing)

        out.append(F.when(value.is_a("array"), value.each(item)).otherwise(F.array().cast(NONE)))
    for part in schema.get("allOf", ()):
        out += _check(value, part, path)
    if "if" in schema:
        holds = _joined(_check(value, schema["if"], path))
        branch = [_joined(_check(value, schema[k], path)) if k in schema else None for k in ("then", "else")]
        then, other = (F.array().cast(NONE) if x is None else x for x in branch)
        out.append(then if holds is None else F.when(F.size(holds) == 0, then).otherwise(other))
    return out


def _joined(parts: list[Column]) -> Column | None:
    return F.concat(*parts) if parts else None


def _all(value: Columns | Json, schema: Mapping, path: Path | None = None) -> Column:
    found = _joined(_check(value, schema, path))
    return F.array().cast(NONE) if found is None else found


def broken(df: DataFrame, schema: Mapping) -> Column:
    """What the rows of df break, as records of all their columns."""
    return _all(Columns(F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema), schema)


def broken_json(text: Column, schema: Mapping) -> Column:
    """What a JSON text breaks; a text that is no JSON breaks `$: json`, null breaks nothing and is null."""
    told = lambda j: F.when(j.isNotNull(), Json.bound(F.try_parse_json(j), lambda v: F.when(v.present, _all(v, schema)).otherwise(F.array(F.lit("$: json")))))
    return once(text, told)
