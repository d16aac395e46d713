"""Quarters: a label YYYYQn and an ordinal 4 * year + (n - 1) beside it."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_index(date: Column) -> Column:
    return (F.year(date) * 4 + F.quarter(date) - 1).cast("int")


def quarter_label(index: Column) -> Column:
    """YYYYQn of an ordinal; null stays null."""
    return F.concat(F.floor(index / 4).cast("int").cast("string"), F.lit("Q"), (F.pmod(index, F.lit(4)) + 1).cast("int").cast("string"))


def label_index(label: Column) -> Column:
    """Ordinal of a label; null if it is none."""
    year, number = F.regexp_extract(label, r"^(\d{4})Q([1-4])$", 1), F.regexp_extract(label, r"^(\d{4})Q([1-4])$", 2)
    return F.when(year != "", year.cast("int") * 4 + number.cast("int") - 1)


def parse_period(text: Column) -> Column:
    """Ordinal of a period written as 2020Q3, 2020-Q3, Q3 2020 or a date; null if it is none of these."""
    t = F.upper(F.trim(text))
    forms = [(r"^(\d{4})[-\s]?Q([1-4])$", 1, 2), (r"^Q([1-4])[-\s]?(\d{4})$", 2, 1)]
    tries = []
    for pattern, y, n in forms:
        year = F.regexp_extract(t, pattern, y)
        tries.append(F.when(year != "", year.cast("int") * 4 + F.regexp_extract(t, pattern, n).cast("int") - 1))
    return F.coalesce(*tries, quarter_index(F.try_to_date(t, "yyyy-MM-dd")))


def quarter_start(index: Column) -> Column:
    return F.make_date(F.floor(index / 4).cast("int"), (F.pmod(index, F.lit(4)) * 3 + 1).cast("int"), F.lit(1))


def quarter_end(index: Column) -> Column:
    """The last day of the quarter."""
    return F.date_sub(F.add_months(quarter_start(index), 3), 1)


def index_of(label: str) -> int:
    """Ordinal of a label, on the driver."""
    m = re.fullmatch(r"(\d{4})Q([1-4])", label.strip().upper())
    if not m:
        raise ValueError(f"no quarter: {label!r}")
    return int(m[1]) * 4 + int(m[2]) - 1


def label_of(index: int) -> str:
    return f"{index // 4}Q{index % 4 + 1}"
