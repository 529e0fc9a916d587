"""Small helpers shared by the expression modules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    """A column from a name or a column."""
    return F.col(c) if isinstance(c, str) else c


def names(by) -> list[str]:
    """A list of column names from a name or a sequence of names."""
    return [by] if isinstance(by, str) else list(by)


def render(template: str, **values) -> Column:
    """Fill `{name}` slots of a template with columns: `render("b64/{stem}.b64", stem=col)`."""
    pieces = []
    for text, slot in re.findall(r"([^{}]*)(?:\{(\w+)\})?", template):
        if text:
            pieces.append(F.lit(text))
        if slot:
            pieces.append(col(values[slot]).cast("string"))
    return F.concat(*pieces)
