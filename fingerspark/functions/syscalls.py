"""Syscall and network columns: names, categories, flags, addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fingerspark.functions.fixed import (
    CATEGORY_SYSCALLS,
    NETWORK_EVENT_SYSCALLS,
    OTHER_CATEGORY,
    PRIVILEGED_SYSCALLS,
    PROTOCOL_NAMES,
    SYSCALL_NUMBERS,
)


def _listed(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def syscall_name(number: str) -> Column:
    """Name of the syscall numbers in column ``number``; unmapped ones give ``unknown_<n>``."""
    names = ", ".join(f"{n}, '{name}'" for n, name in SYSCALL_NUMBERS.items())
    known = f"try_element_at(map({names}), CAST({number} AS INT))"
    return F.expr(f"coalesce({known}, concat('unknown_', CAST({number} AS STRING)))")


def syscall_dimension(spark: SparkSession) -> DataFrame:
    """The number-to-name table for joins (fixed size)."""
    return spark.createDataFrame(list(SYSCALL_NUMBERS.items()), "syscall_id int, syscall string")


def syscall_category(name: str) -> Column:
    """Category of the syscalls in column ``name``, in any letter case; else OTHER."""
    cases = " ".join(
        f"WHEN lower({name}) IN ({_listed(names)}) THEN '{category}'"
        for category, names in CATEGORY_SYSCALLS.items())
    return F.expr(f"CASE {cases} ELSE '{OTHER_CATEGORY}' END")


def is_network_syscall(name: str) -> Column:
    return F.expr(f"coalesce(lower({name}) IN ({_listed(NETWORK_EVENT_SYSCALLS)}), false)")


def is_privileged_syscall(name: str) -> Column:
    return F.expr(f"coalesce(lower({name}) IN ({_listed(PRIVILEGED_SYSCALLS)}), false)")


def dotted_address(packed: Column) -> Column:
    """Little-endian packed IPv4 address to dotted text."""
    octets = [F.shiftright(packed, shift).bitwiseAND(F.lit(255)) for shift in (0, 8, 16, 24)]
    return F.concat_ws(".", *[o.cast("string") for o in octets])


def protocol_name(code: Column) -> Column:
    """TCP/UDP for their codes, the code itself as text otherwise."""
    column = code.cast("string")
    for number, name in PROTOCOL_NAMES.items():
        column = F.when(code == number, name).otherwise(column)
    return column
