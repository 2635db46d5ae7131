"""Label templates: ``${field}`` with empty text for missing values, ``{field}`` with ``<nil>``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import kind_of, value_text

MAX_BYTES = 4096


class TemplateError(ValueError):
    pass


def _value(df: DataFrame, name: str, missing: str) -> Column:
    if name not in df.columns:
        return F.lit(missing)
    column = F.col(f"`{name}`")
    return F.when(column.isNull(), missing).otherwise(value_text(column, kind_of(df, name)))


def label_template(template: str, df: DataFrame) -> Column:
    """``${field}`` placeholders; a template that is a field's name is that field."""
    if len(template.encode()) > MAX_BYTES:
        raise TemplateError("template too long")
    if template in df.columns:
        return _value(df, template, "")
    parts, at = [], 0
    while (start := template.find("${", at)) >= 0:
        end = template.find("}", start)
        name = template[start + 2 : end].strip() if end >= 0 else ""
        if not name:
            raise TemplateError("empty or unterminated placeholder")
        parts += [F.lit(template[at:start]), _value(df, name, "")]
        at = end + 1
    return F.concat(*parts, F.lit(template[at:]))


def field_template(template: str, df: DataFrame, fid: str = "fid") -> Column:
    """``{field}`` and ``{id}``; other braces stay; all are replaced in one pass over the template."""
    parts = []
    for piece in re.split(r"(\{[^{}]*\})", template or "{id}"):
        name = piece[1:-1]
        if piece.startswith("{") and (name in df.columns or name == "id"):
            parts.append(_value(df, fid if name == "id" else name, "<nil>"))
        else:
            parts.append(F.lit(piece))
    return F.concat(*parts)
