"""Tables on disk that batches are appended to and merged into: only partitions that a batch touches are read or written, and a manifest switches at the end."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

MANIFEST = "version long, part string, path string, rows long, replaces boolean"


@dataclass
class StoredTable:
    """A table under root, in parts. Data of each write is a new folder; one file of manifest rows, written after it, makes it count.

    The manifest tells the folders of each part: those of its last write that replaces the part, and of those that only added
    after it. A run that ends before its manifest rows are there leaves the table as it was, and what it wrote is never
    read. One writer at a time. part: an expression of the columns, with few values (years, or a hash of the key)."""

    spark: SparkSession
    root: str
    schema: T.StructType
    key: str
    part: Column

    def manifest(self) -> DataFrame:
        """Live folders of each part."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")
        except Exception as e:  # a table that nothing was written to
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], MANIFEST)
        last = F.max(F.when(F.col("replaces"), F.col("version"))).over(Window.partitionBy("part"))
        return rows.withColumn("last", F.coalesce(last, F.lit(-1))).where(F.col("version") >= F.col("last")).drop("last")

    def read(self, parts: list[str] | None = None) -> DataFrame:
        """The table, or only some of its parts; the list of folders has a row for each part and write since it was replaced."""
        rows = self.manifest()
        paths = [r["path"] for r in (rows if parts is None else rows.where(F.col("part").isin(parts))).select("path").collect()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _parts_of(self, rows: DataFrame) -> list[str]:
        return [r[0] for r in rows.select(self.part.cast("string").alias("part")).distinct().collect()]

    def _write(self, rows: DataFrame, replaces: bool) -> int:
        """Writes rows by part, then the manifest; how many parts were written."""
        at = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.select(*self.schema.names, self.part.cast("string").alias("__part")).write.partitionBy("__part").option("compression", "zstd").parquet(at)
        # Counted in what was written, so that the manifest tells of the files and not of another run of the plan.
        written = self.spark.read.parquet(at).groupBy(F.col("__part").cast("string").alias("part"), F.regexp_extract(F.input_file_name(), r"/(__part=[^/]*)/", 1).alias("folder")).count().collect()
        if not written:
            return 0
        version = (self.manifest().agg(F.max("version")).head()[0] or 0) + 1
        self._switch([(version, r["part"], f"{at}/{r['folder']}", r["count"], replaces) for r in written])
        return len(written)

    def _switch(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def append(self, batch: DataFrame) -> dict[str, int]:
        """Adds one row for each key that the table doesn't hold; rows, inserted, skipped, and parts written. A retried batch writes nothing."""
        rows = batch.count()
        held = self.read(self._parts_of(batch)).select(self.key)
        new = batch.dropDuplicates([self.key]).join(held, self.key, "left_anti").select(*self.schema.names).persist()
        inserted = new.count()
        written = self._write(new, replaces=False) if inserted else 0
        new.unpersist()
        return {"rows": rows, "inserted": inserted, "skipped": rows - inserted, "parts": written}

    def upsert(self, batch: DataFrame, order: str) -> dict[str, int]:
        """Sets the row of each key to the batch's last one (by order); inserted, updated, unchanged keys, and parts written.

        Only parts with a new or different row are written, whole. part must depend on the key alone."""
        by = Window.partitionBy(self.key).orderBy(F.desc(order))
        last = batch.withColumn("__n", F.row_number().over(by)).where("__n = 1").select(*self.schema.names).persist()
        touched = self._parts_of(last)
        old = self.read(touched)
        packed = F.struct(*self.schema.names)
        both = old.select(self.key, packed.alias("__old")).join(last.select(self.key, packed.alias("__new")), self.key, "full").persist()
        kind = F.when(F.col("__new").isNull(), "kept").when(F.col("__old").isNull(), "inserted").when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged").otherwise("updated")
        row = F.coalesce("__new", "__old").alias("r")
        merged = both.select(row).select("r.*")
        counts = {r[0]: r[1] for r in both.groupBy(kind).count().collect()}
        changed = self._parts_of(both.where(kind.isin("inserted", "updated")).select(row).select("r.*"))
        written = self._write(merged.where(self.part.cast("string").isin(changed)), replaces=True) if changed else 0
        both.unpersist()
        last.unpersist()
        return {k: counts.get(k, 0) for k in ("inserted", "updated", "unchanged")} | {"parts": written}
