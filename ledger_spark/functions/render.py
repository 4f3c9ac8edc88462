"""Values and lists as report text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency sign and the text for an empty list.
CURRENCY = "₹"
NOTHING_FOUND = "None identified"


def money_text(value: Column) -> Column:
    """``₹1,234.50``"""
    return F.concat(F.lit(CURRENCY), F.format_number(value, 2))


def plain_money_text(value: Column) -> Column:
    """``₹1234.50``, without grouping"""
    return F.concat(F.lit(CURRENCY), F.call_function("format_number", value, F.lit("0.00")))


def percent_text(value: Column) -> Column:
    """``12.3%``, without grouping"""
    return F.concat(F.call_function("format_number", value, F.lit("0.0")), F.lit("%"))


def day_text(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd")


def money_lines(pairs: Column) -> Column:
    """Map of label to amount as ``- label: ₹amount`` lines, in map order."""
    lines = F.transform(
        F.map_entries(pairs),
        lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), money_text(e["value"])),
    )
    return F.array_join(lines, "\n")


def record_lines(records: Column) -> Column:
    """Array of (date, description, amount) as lines; empty list gets a note.

    A missing part is printed as empty text, so no record is lost.
    """
    lines = F.transform(
        records,
        lambda r: F.concat(
            F.lit("- "),
            F.coalesce(day_text(r["date"]), F.lit("")),
            F.lit(" | "),
            F.coalesce(r["description"], F.lit("")),
            F.lit(" | "),
            money_text(r["amount"]),
        ),
    )
    return F.when(F.size(records) > 0, F.array_join(lines, "\n")).otherwise(F.lit(NOTHING_FOUND))


def item_lines(items: Column) -> Column:
    """Array of plain items as ``- item`` lines; empty list gets a note."""
    lines = F.transform(items, lambda i: F.concat(F.lit("- "), i.cast("string")))
    return F.when(F.size(items) > 0, F.array_join(lines, "\n")).otherwise(F.lit(NOTHING_FOUND))


def comma_list(items: Column) -> Column:
    """Array joined with ``, ``; empty list gets a note."""
    return F.when(F.size(items) > 0, F.array_join(items, ", ")).otherwise(F.lit(NOTHING_FOUND))
