"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Characters for which lower() is the identity outside A-Z; any other sends a text to translate().
_MAY_CHANGE = r"[^\x00-\x7F\p{Ll}\p{Lo}\p{M}\p{P}\p{Z}]"
# Everything outside words of letters, digits and non-ASCII characters, before lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLANKS = " \t\n\u000b\f\r"

#: Tables estimated below this size are broadcast after the estimate; larger ones are shuffled.
BROADCAST_BYTES = 8 << 20


def ship(module: str) -> None:
    """Send a module's functions to the executors by value: they need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder: lineage is cut and a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, row_bytes: int, items: Column | None = None, limit: int = BROADCAST_BYTES, text: str | None = None) -> DataFrame:
    """Broadcast a settled table if its counted rows fit ``limit``; otherwise leave the join to a shuffle.

    ``items`` counts 8-byte array items of a row beyond ``row_bytes``; the bytes of the column ``text`` are added up.
    """
    more = F.coalesce(F.sum(items if items is not None else F.lit(0)), F.lit(0)) * 8
    if text is not None:
        more = more + F.coalesce(F.sum(F.octet_length(text)), F.lit(0))
    held = df.agg((F.count("*") * row_bytes + more).alias("b"))
    return F.broadcast(df) if held.first()["b"] <= limit else df


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; the slow translate() runs only where lower() could change other characters."""
    return F.when(c.rlike(_MAY_CHANGE), F.translate(c, UPPER, UPPER.lower())).otherwise(F.lower(c))


def words(text: Column) -> Column:
    """Words in their original case; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def shifted(a: Column, by: int) -> Column:
    return F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))


def zip_shifted(a: Column, by: int, op) -> Column:
    """``op(a[i], a[i + by])`` for every i that has a partner."""
    rest = shifted(a, by)
    return F.zip_with(F.slice(a, 1, F.size(rest)), rest, op)


def gram_hashes(df: DataFrame, col: str, out: str, k: int) -> DataFrame:
    """Column ``out``: hash of every run of ``k`` items of the long array ``col``, by doubling."""
    df, length = df.withColumn(out, F.col(col)), 1
    while length < k:
        step = min(length, k - length)
        df = df.withColumn(out, zip_shifted(F.col(out), step, lambda a, b: F.xxhash64(a, b)))
        length += step
    return df


def sliding_least(df: DataFrame, col: str, out: str, w: int) -> DataFrame:
    """Column ``out``: minimum of every ``w`` consecutive items of ``col``, by doubling."""
    df, length = df.withColumn(out, F.col(col)), 1
    while length < w:
        step = min(length, w - length)
        df = df.withColumn(out, zip_shifted(F.col(out), step, lambda a, b: F.least(a, b)))
        length += step
    return df


def all_equal(left: DataFrame, right: DataFrame, *cols: str) -> Column:
    """Null-safe join condition on equally named columns."""
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[c]) for c in cols))
