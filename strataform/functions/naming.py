"""Names of generated features."""

from __future__ import annotations

# Ordered text replacements that turn a query into a column name.
# The order counts: "<" goes first, so "<=" ends up as "lteq" and ">=" as "gteq".
REPLACEMENTS = (
    ("<", "lt"),
    ("<=", "le"),
    (">", "gt"),
    (">=", "ge"),
    ("!=", "ne"),
    ("=", "eq"),
    ("-", "sub"),
    ("+", "plus"),
    ("/", "div"),
    ("*", "mul"),
    ("case when ", "_if_"),
    ("else null end", ""),
    ("(", "_"),
    (")", "_"),
    ("'", ""),
    (" and ", ""),
    (" else ", "_"),
    (" ", "_"),
)


def feature_name(query: str) -> str:
    name = query
    for text, code in REPLACEMENTS:
        name = name.replace(text, code)
    return name.lower()
