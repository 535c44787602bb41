"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="vigil-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage, and survives a lost executor."""
    path = f"{shared_dir(df.sparkSession)}/vigil-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """One key for equal (id, text) rows; nulls count as values."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("\0null")), F.col(text).isNull(), F.coalesce(F.col(text), F.lit("")))


def one_of_each_row(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows with one of each value of their column row. keys: those values of all rows, counted first, so that only rows that
    come again are shuffled whole."""
    again = staged(keys.groupBy("row").count().where("count > 1").select("row"))
    if again.isEmpty():
        return rows
    return rows.join(again, "row", "left_anti").select(rows.columns).union(rows.join(again, "row").dropDuplicates(["row"]).select(rows.columns))


def unused(df: DataFrame, *names: str) -> list[str]:
    """names that aren't columns of df, whatever their case: each with underscores before it where it must."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def hashed_share(key: Column, wanted: int, total: int | Column) -> Column:
    """A predicate that holds for about 1.5 * wanted of total rows, by hash, so that the least hashes among them
    are the least of all: a top-n sort behind it then gathers no more rows however many tasks there are."""
    share = F.least(F.lit(1.0), (1.5 * wanted + 100) / F.greatest(total if isinstance(total, Column) else F.lit(total), F.lit(1)))
    return F.shiftrightunsigned(key, 33) < (share * (1 << 31)).cast("long")
