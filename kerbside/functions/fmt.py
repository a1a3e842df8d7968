"""Exact fixed-point text for doubles.

``format_string('%.2f')`` rounds the shortest decimal form half up, so 2.675 prints
2.68 and 0.125 prints 0.13.  ``format_number`` with a pattern rounds the binary value
half even (2.67, 0.12), which is what training text needs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, digits: int) -> Column:
    """``x`` with exactly ``digits`` decimals, correctly rounded; null stays null."""
    return F.call_function("format_number", x.cast("double"), F.lit("0." + "0" * digits))
