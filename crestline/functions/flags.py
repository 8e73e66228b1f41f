"""Alignment flag bits as predicates and as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Flag bits and their names in the alignment format.
FLAG_BITS = {
    "PAIRED": 0x1,
    "PROPER_PAIR": 0x2,
    "UNMAP": 0x4,
    "MUNMAP": 0x8,
    "REVERSE": 0x10,
    "MREVERSE": 0x20,
    "READ1": 0x40,
    "READ2": 0x80,
    "SECONDARY": 0x100,
    "QCFAIL": 0x200,
    "DUP": 0x400,
    "SUPPLEMENTARY": 0x800,
}

SINGLE_END_DROP = 0x604  # unmapped, quality fail, duplicate
MATE_DROP = 0x204  # unmapped, quality fail


def has(flag: Column, name: str) -> Column:
    return flag.bitwiseAND(F.lit(FLAG_BITS[name])) != 0


def usable_single(flag: Column) -> Column:
    return flag.bitwiseAND(F.lit(SINGLE_END_DROP)) == 0


def usable_mate(flag: Column) -> Column:
    return flag.bitwiseAND(F.lit(MATE_DROP)) == 0


def flag_text(flag: Column) -> Column:
    """Comma-separated names of the bits that are set."""
    names = F.array(*[F.when(has(flag, name), F.lit(name)) for name in FLAG_BITS])
    return F.array_join(F.array_compact(names), ",")


def text_flag(text: Column) -> Column:
    """Sum of the named bits; unknown names count nothing."""
    table = F.create_map(*[x for name, bit in FLAG_BITS.items() for x in (F.lit(name), F.lit(bit))])
    parts = F.filter(F.split(text, ","), lambda n: n != "")
    return F.aggregate(parts, F.lit(0), lambda acc, n: acc.bitwiseOR(F.coalesce(F.try_element_at(table, n), F.lit(0))))
