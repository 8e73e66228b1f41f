"""Region strings and the binning scheme of coordinate indexes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_region(text: Column) -> Column:
    """``chr``, ``chr:beg`` or ``chr:beg-end`` with optional thousands commas.

    Gives a 0-based half-open interval; an open end is the largest 31-bit value.
    """
    pattern = r"^(.*?)(?::([\d,]+)(?:-([\d,]+)?)?)?$"
    name = F.regexp_extract(text, pattern, 1)
    begin = F.nullif(F.regexp_replace(F.regexp_extract(text, pattern, 2), ",", ""), F.lit("")).cast("long")
    end = F.nullif(F.regexp_replace(F.regexp_extract(text, pattern, 3), ",", ""), F.lit("")).cast("long")
    return F.struct(
        name.alias("chrom"),
        F.greatest(F.coalesce(begin - 1, F.lit(0)), F.lit(0)).alias("beg"),
        F.coalesce(end, F.lit((1 << 31) - 1)).alias("stop"),
    )


# First bin number and width in bits of each level, finest first.
LEVELS = ((4681, 14), (585, 17), (73, 20), (9, 23), (1, 26))


def bins_over(beg: Column, stop: Column) -> Column:
    """All bins, of every level and the whole, that may hold a record overlapping ``[beg, stop)``; none if it is empty."""
    beg, last = F.greatest(beg, F.lit(0)), stop - 1
    parts = [F.sequence((first + F.shiftright(beg, shift)).cast("int"), (first + F.shiftright(last, shift)).cast("int")) for first, shift in reversed(LEVELS)]
    return F.when(stop > beg, F.concat(F.array(F.lit(0)), *parts)).otherwise(F.array().cast("array<int>"))


def region_bin(beg: Column, stop: Column) -> Column:
    """Smallest bin of the five-level scheme that holds ``[beg, stop)``."""
    last = stop - 1
    number: Column | None = None
    for first, shift in LEVELS:
        same = F.shiftright(beg, shift) == F.shiftright(last, shift)
        value = F.lit(first) + F.shiftright(beg, shift)
        number = F.when(same, value) if number is None else number.when(same, value)
    return number.otherwise(F.lit(0)).cast("int")
