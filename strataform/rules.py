"""Fixed values of the data model: column suffixes, topics, aggregate rules."""

from __future__ import annotations

KEY = "case_id"
KEY_COLUMNS = ("case_id", "WEEK_NUM", "num_group1", "num_group2")
BASE_COLUMNS = ("target", "case_id", "WEEK_NUM")
MISSING_CODE = "a55475b1"
FILL_VALUE = -99999999

# Meaning of the last letter of a column name.
SUFFIX_MEANING = {
    "P": "Transform DPD (Days Past Due)",
    "M": "Masking Categories",
    "A": "Transform Amount",
    "D": "Transform Date",
    "T": "Unspecified Transform",
    "L": "Unspecified Transform",
}

# Logical type that the last letter asks for ("T", "L": as stored).
SUFFIX_TYPE = {"P": "double", "A": "double", "M": "string", "D": "date"}

# Topic names and their (name, depth) pairs.
TOPIC_NAMES = (
    "applprev", "credit_bureau_a", "credit_bureau_b", "person", "debitcard", "deposit",
    "other", "tax_registry_a", "tax_registry_b", "tax_registry_c", "static", "static_cb",
)
TOPICS = (
    ("applprev", 1), ("applprev", 2),
    ("credit_bureau_a", 1), ("credit_bureau_a", 2),
    ("credit_bureau_b", 1), ("credit_bureau_b", 2),
    ("person", 1), ("person", 2),
    ("debitcard", 1), ("deposit", 1), ("other", 1),
    ("tax_registry_a", 1), ("tax_registry_b", 1), ("tax_registry_c", 1),
    ("static", 0), ("static_cb", 0),
)

# Date columns that give period filters, by topic.
PERIOD_COLUMNS = {
    "applprev": ["creationdate_885D"],
    "credit_bureau_a": ["dateofcredstart_181D", "dateofcredstart_739D"],
    "credit_bureau_b": ["contractdate_551D"],
    "debitcard": ["openingdate_857D"],
    "deposit": ["openingdate_313D"],
    "tax_registry_a": ["recorddate_4527225D"],
    "tax_registry_b": ["deductiondate_4917603D"],
    "tax_registry_c": ["processingdate_168D"],
}

# Which aggregates each column family gets, when training and when
# serving. The two differ on purpose; a model must keep to one of them.
TRAIN_RULES = {
    "PA": ("last", "max", "mean", "median", "var"),
    "D": ("last", "max", "median"),
    "M": ("last", "max", "mode"),
    "TL": ("last", "max", "min"),
    "num_group": ("last", "max", "min"),
}
SERVE_RULES = {
    "PA": ("last", "max", "min", "mean", "median"),
    "D": ("last", "max", "min", "mean", "median"),
    "M": ("last", "max", "min"),
    "TL": ("last", "max", "min"),
    "num_group": ("last", "max", "min"),
}


def check_topic(name: str) -> str:
    if name not in TOPIC_NAMES:
        raise ValueError(f"unknown topic {name!r}; known: {', '.join(TOPIC_NAMES)}")
    return name


def suffix(column: str) -> str:
    return column[-1]


def family(column: str) -> str | None:
    """Column family used by the aggregate rule tables, or None for no rule."""
    if "num_group" in column:
        return "num_group"
    last = suffix(column)
    return next((f for f in ("PA", "D", "M", "TL") if last in f), None)
