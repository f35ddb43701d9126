"""Row updates as immutable rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_ignore(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key exists already are dropped."""
    return base.unionByName(new.join(base.select(*keys), keys, "left_anti").select(base.columns))


def upsert_last(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``base`` with the same key."""
    return base.join(new.select(*keys), keys, "left_anti").select(base.columns).unionByName(new.select(base.columns))


def upsert_append(base: DataFrame, new: DataFrame, keys: list[str], append: list[str], replace: list[str]) -> DataFrame:
    """Arrays grow by the new ones; other values are replaced where the new row has one."""
    joined = base.alias("b").join(new.alias("n"), keys, "full_outer")
    arrays = [F.concat(F.coalesce(F.col(f"b.{c}"), F.array().cast(base.schema[c].dataType)), F.coalesce(F.col(f"n.{c}"), F.array().cast(base.schema[c].dataType))).alias(c) for c in append]
    return joined.select(*keys, *arrays, *[F.coalesce(F.col(f"n.{c}"), F.col(f"b.{c}")).alias(c) for c in replace])


def update_by_key(base: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``coalesce(new, old)`` for the given columns."""
    joined = base.alias("b").join(changes.select(*keys, *columns).alias("n"), keys, "left")
    return joined.select(*[(F.coalesce(F.col(f"n.{c}"), F.col(f"b.{c}")).alias(c) if c in columns else F.col(c) if c in keys else F.col(f"b.{c}")) for c in base.columns])


def cascade_delete(children: DataFrame, child_key: str, gone: DataFrame, key: str) -> DataFrame:
    """Children of deleted rows go with them."""
    deleted = gone.select(F.struct(F.col(key).alias("key")).alias("deleted"))
    rows = children.select(F.struct(*[F.col(f"`{c}`") for c in children.columns]).alias("row"))  # no name of theirs meets those used here
    left = rows.join(deleted, F.col("row").getField(child_key) == F.col("deleted.key"), "left_anti")
    return left.select(*[F.col("row").getField(c).alias(c) for c in children.columns])
