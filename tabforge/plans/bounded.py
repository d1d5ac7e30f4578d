"""Size guards: what may go to the driver or be broadcast, and only with a proven bound."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.session import ensure_checkpoint_dir


class BoundExceeded(ValueError):
    """A driver-side domain or broadcast side grew past its declared bound."""


def ship(module: str) -> None:
    """Send a module's functions to the executors by value: they need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def bounded_values(df: DataFrame, col: str | Column, max_values: int = 1000,
                   drop_null: bool = True) -> list:
    """Distinct values of one column, sorted, with a hard cap.

    Used where the *schema* of the result depends on the data (one-hot column
    names, category domains). Reads at most ``max_values + 1`` distinct rows
    back; raises instead of silently truncating.
    """
    c = F.col(col) if isinstance(col, str) else col
    d = df.select(c.alias("v"))
    if drop_null:
        d = d.where(F.col("v").isNotNull())
    rows = d.distinct().limit(max_values + 1).collect()
    if len(rows) > max_values:
        raise BoundExceeded(f"column has more than {max_values} distinct values")
    vals = [r["v"] for r in rows]
    return sorted(vals, key=lambda v: (v is None, v))


def settled(df: DataFrame) -> DataFrame:
    """Checkpoint a derived table into the shared folder.

    A join then shuffles it plainly, so a hot key of the other side can be split at run time; with an aggregate between
    shuffle and join it cannot.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checked_broadcast(df: DataFrame, max_rows: int, max_bytes: int = 64 << 20) -> DataFrame:
    """Settle ``df`` and broadcast it only if it holds at most ``max_rows`` rows and about ``max_bytes`` bytes.

    Beyond either bound the join shuffles it.
    """
    held = settled(df)
    text = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in held.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    n, chars = held.agg(F.count("*"), F.coalesce(F.sum(sum(text, F.lit(0))), F.lit(0))).first()
    return F.broadcast(held) if n <= max_rows and chars + 8 * n * len(held.columns) <= max_bytes else held
