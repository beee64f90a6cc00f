"""Nested tables reduced to one row per (case, num_group1)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from strataform import rules
from strataform.functions.columns import quoted
from strataform.functions.naming import feature_name
from strataform.operators.aggregates import Measure, aggregate
from strataform.operators.setops import unify_pairs
from strataform.operators.skew import HOT_ROWS

NESTED_KEYS = (rules.KEY, "num_group1")


def count_value(column: str, value: str, shown: str | None = None) -> Measure:
    """Rows in which ``column`` has ``value``; ``shown`` replaces the column in the name."""
    label = f"count(case when ({shown or column} = '{value}') then 1 else null end)"
    return Measure(feature_name(label) + "L", f"count_if({quoted(column)} = '{value}')")


def count_distinct(column: str, name: str | None = None) -> Measure:
    return Measure(name or f"count_distinct_{column.lower()}__L", quoted(column), "distinct")


def value_counts_plan(values: Mapping[str, Sequence[str]]) -> list[Measure]:
    return [count_value(column, v) for column, found in values.items() for v in found]


# Codes counted per prior application.
APPLICATION_VALUES = {
    "cacccardblochreas_147M": ("P33_145_161", "P201_63_60"),
    "conts_type_509L": ("PRIMARY_MOBILE", "HOME_PHONE", "EMPLOYMENT_PHONE"),
    "credacc_cards_status_52L": ("CANCELLED", "ACTIVE", "INACTIVE", "BLOCKED", "RENEWED", "UNCONFIRMED"),
}

# Codes counted per person.
PERSON_VALUES = {
    "addres_district_368M": ("P125_48_164", "P155_139_77", "P114_74_190"),
    "addres_role_871L": ("PERMANENT", "CONTACT", "TEMPORARY", "REGISTERED"),
    "addres_zip_823M": ("P161_14_174", "P144_138_111", "P46_103_143"),
    "conts_role_79M": ("P38_92_157", "P177_137_98", "P7_147_157"),
    "empls_economicalst_849M": (
        "P22_131_138", "P164_110_33", "P28_32_178", "P148_57_109", "P112_86_147", "P191_80_124",
        "P7_47_145", "P164_122_65", "P82_144_169",
    ),
    "empls_employer_name_740M": ("P114_118_163", "P179_55_175", "P26_112_122"),
}

# Columns of active and of closed contracts that mean the same.
BUREAU_PAIRS = {
    "collater_typofvalofguarant_298M407M": ("collater_typofvalofguarant_298M", "collater_typofvalofguarant_407M"),
    "collater_valueofguarantee_1124L876L": ("collater_valueofguarantee_1124L", "collater_valueofguarantee_876L"),
    "collaterals_typeofguarante_359M669M": ("collaterals_typeofguarante_359M", "collaterals_typeofguarante_669M"),
    "pmts_dpd_1073P303P": ("pmts_dpd_1073P", "pmts_dpd_303P"),
    "pmts_month_158T706T": ("pmts_month_158T", "pmts_month_706T"),
    "pmts_overdue_1140A1152A": ("pmts_overdue_1140A", "pmts_overdue_1152A"),
    "pmts_year_1139T507T": ("pmts_year_1139T", "pmts_year_507T"),
    "subjectroles_name_541M838M": ("subjectroles_name_541M", "subjectroles_name_838M"),
}

# Codes counted per bureau contract.
BUREAU_VALUES = {
    "collater_typofvalofguarant_298M407M": ("9a0c095e", "8fd95e4b"),
    "collaterals_typeofguarante_359M669M": ("c7a5ad39", "3cbe86ba"),
    "subjectroles_name_541M838M": ("ab3c25cf", "15f04f45"),
}


def application_measures() -> list[Measure]:
    """A14."""
    return value_counts_plan(APPLICATION_VALUES) + [count_distinct(c) for c in APPLICATION_VALUES]


def person_measures() -> list[Measure]:
    """A15. The district count is of distinct values although its name does not say so."""
    since = "empls_employedfrom_796D"
    return [
        *value_counts_plan(PERSON_VALUES),
        count_distinct("addres_district_368M", "count_addres_district_368m__L"),
        *[count_distinct(c) for c in ("addres_role_871L", "addres_zip_823M", "conts_role_79M",
                                      "empls_economicalst_849M", since)],
        Measure(f"min_{since.lower()}__D", f"min({since})"),
        Measure(f"max_{since.lower()}__D", f"max({since})"),
        *[count_distinct(c) for c in ("empls_employer_name_740M", "relatedpersons_role_762T")],
    ]


def bureau_b_measures() -> list[Measure]:
    """A16."""
    return [
        Measure("count__num_group2__L", "count(num_group2)"),
        Measure("max_pmts_date_1107d_D", "max(pmts_date_1107D)"),
        Measure("min_pmts_date_1107d_D", "min(pmts_date_1107D)"),
        Measure("sum_pmts_dpdvalue_108p_P", "sum(pmts_dpdvalue_108P)"),
        Measure("sum_pmts_pmtsoverdue_635a_A", "sum(pmts_pmtsoverdue_635A)"),
    ]


def year_start(column: str) -> str:
    """First day of a year kept as a number; null and empty years stay null."""
    text = f"replace(CAST({quoted(column)} AS STRING), '.0', '')"
    return f"concat(nullif({text}, ''), '-01-01')"


def bureau_a_measures() -> list[Measure]:
    """A17, over rows stacked by ``stack_contracts``."""
    def distinct(column: str) -> Measure:
        return count_distinct(column, f"count_distinct_{column}__L")

    def total(column: str, letter: str) -> Measure:
        return Measure(f"sum_{column}__{letter}", f"sum({column})")

    year = "pmts_year_1139T507T"
    return [
        Measure("count_status__L", "count(status)"),
        Measure("sum_status__L", "sum(status)"),
        Measure("avg_status__L", "avg(status)"),
        distinct("collater_typofvalofguarant_298M407M"),
        total("collater_valueofguarantee_1124L876L", "L"),
        distinct("collaterals_typeofguarante_359M669M"),
        total("pmts_dpd_1073P303P", "P"),
        total("pmts_month_158T706T", "T"),
        total("pmts_overdue_1140A1152A", "A"),
        Measure(f"min_{year}__D", f"min({year_start(year)})"),
        Measure(f"max_{year}__D", f"max({year_start(year)})"),
        distinct("subjectroles_name_541M838M"),
        *[
            count_value(column, v, shown=BUREAU_PAIRS[column][0])
            for column, found in BUREAU_VALUES.items() for v in found
        ],
    ]


def stack_contracts(depth2: DataFrame, pairs: Mapping[str, tuple[str, str]] = BUREAU_PAIRS) -> DataFrame:
    """X1 for bureau contracts: active rows with status 1, closed ones with 0."""
    return unify_pairs(depth2, NESTED_KEYS, pairs)


def reduce_nested(
    depth2: DataFrame, measures: Sequence[Measure], hot_rows: int = HOT_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """One row per (case, num_group1). Hot cases are looked for in ``sizes``, for stacked
    rows the table before stacking."""
    return aggregate(depth2, NESTED_KEYS, measures, hot_rows, depth2 if sizes is None else sizes)


# Topics whose nested table is folded into depth 1: measures, and whether rows are
# stacked first.
FLATTENED = {
    "applprev": (application_measures, False),
    "person": (person_measures, False),
    "credit_bureau_b": (bureau_b_measures, False),
    "credit_bureau_a": (bureau_a_measures, True),
}
