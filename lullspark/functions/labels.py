"""Unit classes and display labels of series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lullspark.registry import DEFAULT_LABEL_CLASS, LABEL_CLASSES

# Fixed values: (matched lower-cased, fragment, axis), first match wins. Column names are in
# lower case, so the first two can only match where every fragment is matched lower-cased.
AXIS_RULES = [
    (False, "Share", "share"),
    (False, "Rel", "share"),
    (True, "price", "price"),
    (False, "radiation", "radiation"),
    (False, "speed", "wind"),
    (False, "repi_", "repi"),
]
DEFAULT_AXIS = "energy"


def series_class(label: Column) -> Column:
    """Unit class of a source label."""
    out = F
    for fragment, name in LABEL_CLASSES:
        out = out.when(F.contains(label, F.lit(fragment)), F.lit(name))
    return out.otherwise(F.lit(DEFAULT_LABEL_CLASS))


def axis_class(column_name: Column, compat: bool = False) -> Column:
    """Chart axis of a column name, upper and lower case alike.

    ``compat`` matches shares and relative changes with their capital letter, which no
    column name has, so that they fall to the axis of energies or prices.
    """
    out = F
    for lowered, fragment, name in AXIS_RULES:
        if lowered or not compat:
            fragment, text = fragment.lower(), F.lower(column_name)
        else:
            text = column_name
        out = out.when(F.contains(text, F.lit(fragment)), F.lit(name))
    return out.otherwise(F.lit(DEFAULT_AXIS))


def display_label(column_name: Column, lower_words: tuple[str, ...] = ()) -> Column:
    """Words of a column name with a capital first letter, the rest untouched."""
    keep = F.lit(list(lower_words)) if lower_words else None

    def word(w: Column) -> Column:
        capital = F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))
        return F.when(F.array_contains(keep, w), w).otherwise(capital) if keep is not None else capital

    return F.array_join(F.transform(F.split(column_name, "_"), word), " ")
