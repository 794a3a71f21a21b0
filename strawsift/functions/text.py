"""Scalar rules on names and values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(value: Column) -> Column:
    """Neither null nor empty; white space counts as something."""
    return value.isNotNull() & (value != "")


def blank(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit(""))) == ""


def extension(path: Column) -> Column:
    """The last dotted part of a path's file name with its dot, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def allowed(path: Column, extensions: tuple[str, ...]) -> Column:
    """Is the extension one of an allow-list (lower-cased, with dots)."""
    return extension(path).isin(*extensions)


def joined(values: Column, separator: str = ";") -> Column:
    return F.array_join(values, separator)


def servers(hosts: list[tuple[str, int]]) -> str:
    """``host:port,host:port``."""
    return ",".join(f"{h}:{p}" for h, p in hosts)


def key_values(arguments: list[str]) -> dict[str, str]:
    """``key=value`` arguments; the value may hold further equal signs, arguments without one are left out."""
    return dict(a.split("=", 1) for a in arguments if "=" in a)
