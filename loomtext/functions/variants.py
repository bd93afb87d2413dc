"""Typed access to variants (JSN4): a value of another type is null, and a number without a fraction is an integer however it is written."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def number(v: Column, path: str) -> Column:
    return F.when(_kind(v, path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, path, "double"))


def integer(v: Column, path: str) -> Column:
    n = number(v, path)
    exact = F.when(_kind(v, path) == "BIGINT", F.try_variant_get(v, path, "bigint"))
    return F.coalesce(exact, F.when(n == F.floor(n), n.cast("long")))


def string(v: Column, path: str) -> Column:
    return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def boolean(v: Column, path: str) -> Column:
    return F.when(_kind(v, path) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))
