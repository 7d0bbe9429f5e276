"""Helpers that the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florascan.sources.storage import new_path, stored
from florascan.sources.tables import table

__all__ = ["hidden", "new_path", "spread_join", "stored", "table", "text_or_empty"]


def hidden(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that the operator is about to add (names compare without case)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def spread_join(rows: DataFrame, facts: DataFrame, key: str, by: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """rows joined to facts, which has one row for each key; rows of a key are dealt to ``salts`` tasks by the column ``by``.

    facts is repeated ``salts`` times, so it should be narrow. A null ``by`` counts as a value.
    """
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(F.lit("salt"), F.col(by)), F.lit(salts)).cast("int"))
    copies = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [key, "__salt"], how).drop("__salt")
