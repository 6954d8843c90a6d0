"""Users and the novels they own, as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tomeflow.functions.text import hash_key


def registered(users: DataFrame, name: str, key: str, user_id: str) -> DataFrame:
    """``users`` (user_id, name, api_key, created_at) and a new one, whose key is kept hashed. A name that exists is refused."""
    if not users.where(F.col("name") == name).isEmpty():
        raise ValueError(f"{name} is registered already")
    new = users.sparkSession.range(1).select(F.lit(user_id).alias("user_id"), F.lit(name).alias("name"), hash_key(F.lit(key)).alias("api_key"), F.current_timestamp().alias("created_at"))
    return users.unionByName(new)


def verified(users: DataFrame, name: str, key: str) -> bool:
    return not users.where((F.col("name") == name) & (F.col("api_key") == hash_key(F.lit(key)))).isEmpty()


def removed(users: DataFrame, ownership: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    return users.where(F.col("name") != name), ownership.where(F.col("name") != name)


def assigned(ownership: DataFrame, new: DataFrame) -> DataFrame:
    """``ownership`` (name, novel_id) and the pairs of ``new`` that it doesn't have."""
    pairs = new.select("name", "novel_id").distinct()
    return ownership.unionByName(pairs.join(ownership, ["name", "novel_id"], "left_anti"))


def unassigned(ownership: DataFrame, gone: DataFrame) -> DataFrame:
    return ownership.join(gone.select("name", "novel_id"), ["name", "novel_id"], "left_anti")


def owned(rows: DataFrame, ownership: DataFrame, name: str) -> DataFrame:
    """Only rows of novels that the user owns."""
    return rows.join(ownership.where(F.col("name") == name).select("novel_id"), "novel_id", "left_semi")
