"""Text templates compiled to one column expression."""

from __future__ import annotations

import re
from collections.abc import Mapping
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F


def fields_of(template: str) -> list[str]:
    """The names of the fields of a template, each once, in order."""
    return list(dict.fromkeys(name for _, name, _, _ in Formatter().parse(template) if name is not None))


def rendered(template: str, fields: Mapping[str, Column], absent: str | None = None) -> Column:
    """The template with columns in place of its {fields}; {{ and }} are braces, {name:.2f} has so many places.

    The template is parsed once.  A field that is null gives `absent`, or makes the text null if there is none.  A field without a
    column gives `absent`, too, or is a KeyError.  Other formats, conversions and attributes are a ValueError, as are braces that do not match.
    """
    parts: list[Column] = []
    for text, name, form, conversion in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is None:
            continue
        if conversion or not re.fullmatch(r"\w+", name):
            raise ValueError(f"a field that is not understood: {name}")
        if name not in fields:
            if absent is None:
                raise KeyError(name)
            parts.append(F.lit(absent))
            continue
        value = fields[name]
        if form:
            places = re.fullmatch(r"\.(\d+)f", form)
            if not places:
                raise ValueError(f"a format that is not understood: {form}")
            value = F.when(value.isNotNull(), F.format_string(f"%{places[0]}", value.cast("double")))
        value = value.cast("string")
        parts.append(value if absent is None else F.coalesce(value, F.lit(absent)))
    return F.concat(*parts) if parts else F.lit("")
