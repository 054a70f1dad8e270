"""Partial dates and durations as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
PRESENT = "^(present|current|now|till date|to date|ongoing|date)$"


def parse_partial_date(value: Column, end_of_period: bool = False) -> Column:
    """First (or last) day of the month that a text such as 'Mar 2020', '03/2020', '2020-03' or '2020' names.

    Without a month it is January (December at the end of a period); words for
    the present, and years outside 1970-2049, give null.
    """
    text = F.regexp_replace(F.lower(F.trim(value)), "[.,]+$", "")
    year = F.regexp_extract(text, r"(19[7-9]\d|20[0-4]\d)", 1)
    name = F.regexp_extract(text, f"({'|'.join(MONTHS)})[a-z]*", 1)
    by_name = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name).cast("int")
    front, back = F.regexp_extract(text, r"^(\d{1,2})[/-]\d{4}$", 1), F.regexp_extract(text, r"^\d{4}[/-](\d{1,2})$", 1)
    number = F.coalesce(F.when(front != "", F.try_to_number(front, F.lit("99")).cast("int")), F.when(back != "", F.try_to_number(back, F.lit("99")).cast("int")))
    month = F.coalesce(F.when(name != "", by_name), number, F.lit(12 if end_of_period else 1))
    first = F.make_date(F.when(year != "", year).cast("int"), F.greatest(F.lit(1), F.least(F.lit(12), month)), F.lit(1))
    return F.when(text.rlike(PRESENT) | (year == ""), None).otherwise(F.last_day(first) if end_of_period else first)
