"""Reading and writing journals, catalogues, registers and reports; ingest rules."""

from __future__ import annotations

import tempfile
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vigil.functions import scalars as S

#: Columns of a raw journal file in order (fixed names of the format), and what they are called here.
JOURNAL_COLUMNS = {"ид_события": "event_id", "ид_канала_данных": "channel_id", "дата": "date_raw", "время": "time_raw", "тревожное": "alarm_raw", "значение_датчика": "value_raw"}
#: Rows of a journal that one task sorts for its export, and years that are written at once.
PIECE, YEARS = 1_000_000, 8


def strings(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """The required columns; raises if one is missing or comes twice. Extra columns are dropped."""
    missing = [c for c in columns if c not in df.columns]
    twice = [c for c in columns if df.columns.count(c) > 1]
    if missing or twice:
        raise ValueError(f"missing columns: {missing}; repeated columns: {twice}")
    return df.select(*columns)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """A journal of CSV files as text columns, with the file name. Types are never inferred; the header is checked by name."""
    raw = spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE").csv(path)
    return require(raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns)), list(JOURNAL_COLUMNS)).select(*(F.col(a).alias(b) for a, b in JOURNAL_COLUMNS.items()), F.input_file_name().alias("file"))


def read_records(spark: SparkSession, path: str, fmt: str, columns: list[str], most: int | None = None) -> DataFrame:
    """Records of a CSV, JSON array, XML (element `record`) or Parquet source as text; booleans become true and false. With more than `most` rows it raises."""
    reader = spark.read.schema(strings(columns)) if fmt in ("json", "xml") else spark.read
    df = {"csv": lambda: reader.option("header", True).csv(path), "json": lambda: reader.option("multiLine", True).json(path), "xml": lambda: reader.format("xml").option("rowTag", "record").load(path), "parquet": lambda: reader.parquet(path)}[fmt]()
    if most is not None and df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return require(df, columns).select(*(F.col(c).cast("string").alias(c) for c in columns))


def is_header() -> Column:
    """Whether a row is the header again."""
    return F.coalesce(F.col("event_id").isin("event_id", *JOURNAL_COLUMNS), F.lit(False))


def without_repeated_headers(raw: DataFrame) -> DataFrame:
    """Rows that aren't the header again."""
    return raw.where(~is_header())


def parse_events(raw: DataFrame, *more: str) -> DataFrame:
    """Typed events with row_hash and error (null for a good row; else the first rule broken), and more columns of raw as they are."""
    time = F.try_to_timestamp(F.concat_ws(" ", F.trim("date_raw"), F.trim("time_raw")), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    out = raw.select(
        F.trim("event_id").try_cast("long").alias("event_id"), F.trim("channel_id").try_cast("long").alias("channel_id"), time.alias("event_time"), S.parse_alarm(F.col("alarm_raw")).alias("alarm"),
        S.parse_number(F.col("value_raw")).alias("value_numeric"), S.parse_state(F.col("value_raw")).alias("value_state"),
        S.row_hash(*(F.col(c) for c in JOURNAL_COLUMNS.values())).alias("row_hash"), *more,
    )
    error = F.when(F.col("event_id").isNull(), "event_id").when(F.col("channel_id").isNull(), "channel_id").when(F.col("event_time").isNull(), "event_time").when(F.col("alarm").isNull(), "alarm")
    return out.withColumn("error", error)


def new_rows(batch: DataFrame, target: DataFrame, key: str = "row_hash") -> DataFrame:
    """One row for each key of the batch that the target doesn't hold: a retried batch adds nothing."""
    return batch.dropDuplicates([key]).join(target.select(key), key, "left_anti")


def append_counts(batch: DataFrame, target: DataFrame, key: str = "row_hash") -> DataFrame:
    """Rows, inserted and skipped."""
    total = batch.agg(F.count("*").alias("rows"))
    added = new_rows(batch, target, key).agg(F.count("*").alias("inserted"))
    return total.crossJoin(added).withColumn("skipped", F.col("rows") - F.col("inserted"))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Old and new rows with the last one of each key: new before old, later before earlier."""
    both = old.withColumns({"__new": F.lit(0), "__at": F.lit(0).cast("long")}).unionByName(new.withColumns({"__new": F.lit(1), "__at": F.col(order).cast("long")}), allowMissingColumns=True)
    by = Window.partitionBy(key).orderBy(F.desc("__new"), F.desc("__at"))
    return both.withColumn("__n", F.row_number().over(by)).where("__n = 1").select(old.columns)


def catalogue(raw: DataFrame) -> DataFrame:
    """Channels from text rows (channel_id, tag, name, position): the last row of each wins; site and picket come from tag and name."""
    rows = raw.select(F.trim("channel_id").try_cast("long").alias("channel_id"), S.empty_to_null(F.col("tag")).alias("tag"), S.empty_to_null(F.col("name")).alias("name"), "position")
    last = rows.where("channel_id is not null").groupBy("channel_id").agg(F.max_by(F.struct("tag", "name"), "position").alias("x"))
    return last.select("channel_id", "x.*", S.first_part(F.col("x.tag")).alias("site"), S.picket(F.col("x.name")).alias("picket"))


def stage_balanced(raw: DataFrame, path: str, year: int | None = None) -> DataFrame:
    """Stages the good events of raw once each as Parquet by year (of one year only, if given), and returns the balance of that write:
    rows = headers + bad + repeated + other_year + staged. unexplained: staged rows that the files don't hold (by their footers); must be 0.

    The counts are metrics observed on the rows as they pass, before and behind the removal of repeated ones: one pass over raw, no other scan of it."""
    seen, kept = Observation(), Observation()
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    header, bad = is_header(), F.col("error").isNotNull()
    parsed = parse_events(raw.withColumn("header", header), "header").observe(seen, F.count("*").alias("rows"), count(F.col("header")).alias("headers"), count(~F.col("header") & bad).alias("bad"))
    once = parsed.where(~F.col("header") & ~bad).drop("header", "error").dropDuplicates(["row_hash"]).withColumn("y", F.year("event_time"))
    wanted = F.lit(True) if year is None else F.col("y") == year
    once = once.observe(kept, F.count("*").alias("distinct_rows"), count(~wanted).alias("other_year"))
    once.where(wanted).write.partitionBy("y").option("compression", "zstd").parquet(path)
    m, k = seen.get, kept.get
    row = (m["rows"], m["headers"], m["bad"], m["rows"] - m["headers"] - m["bad"] - k["distinct_rows"], k["other_year"], k["distinct_rows"] - k["other_year"])
    out = raw.sparkSession.createDataFrame([row], "rows long, headers long, bad long, repeated long, other_year long, staged long")
    staged = raw.sparkSession.read.parquet(path).count() if k["distinct_rows"] > k["other_year"] else 0
    return out.withColumn("unexplained", F.col("staged") - F.lit(staged))


def stage_by_year(events: DataFrame, path: str) -> None:
    """Events as Parquet by year of the event, each once."""
    events.dropDuplicates(["row_hash"]).withColumn("y", F.year("event_time")).write.partitionBy("y").option("compression", "zstd").parquet(path)


def checkpointed(rows: DataFrame) -> DataFrame:
    """rows with their partitions and order in the folder that driver and executors share."""
    spark, sc = rows.sparkSession, rows.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None) or (tempfile.mkdtemp() if sc.master.startswith("local") else None)
        if not base:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(base)
    return rows.checkpoint()


def export_journal(events: DataFrame, path: str, parts: int = 1) -> None:
    """CSV with one file for each calendar year, ordered by time and id; with more parts, that many files a year, in order by name.

    For one file, a year is sorted in ranges of about PIECE rows, a task each, and checkpointed; the task that writes the file
    takes the ranges one after the other and sorts nothing. Years are written side by side. The marker of success comes with the last year."""
    order = ["event_time", "event_id"]
    rows = events.withColumn("y", F.year("event_time"))
    out = lambda df: df.write.option("header", True)
    if parts > 1:
        dealt = rows.repartitionByRange(parts * max(1, rows.select("y").distinct().count()), "y", *order)
        out(dealt.sortWithinPartitions("y", *order)).partitionBy("y").csv(path)
        return
    # The folder is made first: one that is there raises, and a journal without rows has one too.
    out(rows.limit(0)).partitionBy("y").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").csv(path)

    def write(y: int | None, n: int) -> None:
        ranges = rows.where(F.col("y").eqNullSafe(F.lit(y))).drop("y").repartitionByRange(-(-n // PIECE), *order)
        sorted_ranges = checkpointed(ranges.sortWithinPartitions(*order))
        # coalesce without a shuffle reads the partitions in their order.
        out(sorted_ranges.coalesce(1)).csv(f"{path}/y={'__HIVE_DEFAULT_PARTITION__' if y is None else y}")

    with ThreadPool(YEARS) as pool:
        pool.starmap(inheritable_thread_target(rows.sparkSession)(write), [tuple(r) for r in rows.groupBy("y").count().collect()], 1)
    out(rows.limit(0)).partitionBy("y").mode("append").csv(path)


def export_catalogue(channels: DataFrame, path: str, key: str = "channel_id") -> None:
    """CSV with a header, ordered by key over its files; nulls are empty."""
    channels.orderBy(key).write.option("header", True).option("nullValue", "").csv(path)


def write_panel(panel: DataFrame, path: str, groups: int = 8, day: str = "day") -> None:
    """A panel as Parquet by year and group of channels (a hash of the channel), zstd."""
    rows = panel.withColumns({"d_year": F.year(day), "channel_group": F.pmod(F.col("channel_id"), F.lit(groups)).cast("int")})
    rows.repartition("d_year", "channel_group").write.partitionBy("d_year", "channel_group").option("compression", "zstd").parquet(path)


def stage_strings(spark: SparkSession, csv: str, path: str, columns: list[str]) -> None:
    """A CSV source as Parquet of text columns, zstd."""
    read_records(spark, csv, "csv", columns).write.option("compression", "zstd").parquet(path)


def scan_source(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Text columns of a Parquet or CSV source; its name tells which."""
    return read_records(spark, path, "parquet" if path.rstrip("/").endswith(".parquet") else "csv", columns)


def object_catalogue(raw: DataFrame) -> DataFrame:
    """Objects from text rows (object_id, level, parent_id, kind, name): typed, with error for the first rule broken (else null). Optional
    numbers may be empty, but not other text."""
    number = lambda c: F.trim(c).try_cast("int")
    given = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    bad = lambda c: given(c) & number(c).isNull()
    key = F.trim("object_id").try_cast("long")
    error = F.when(~given("object_id"), "empty_id").when(key.isNull(), "invalid_id").when(bad("level"), "invalid_level").when(bad("parent_id"), "invalid_parent")
    return raw.select(key.alias("object_id"), number("level").alias("level"), number("parent_id").alias("parent_id"), S.empty_to_null(F.col("kind")).alias("kind"), S.empty_to_null(F.col("name")).alias("name"), error.alias("error"))


def equipment_verdicts(messages: DataFrame, channels: DataFrame) -> DataFrame:
    """Equipment messages (id, seen, channel_id, object_id, name) with verdict: incomplete without object or name, reassigned if the
    channel belongs to another object (in the catalogue, or by an earlier message), else accepted."""
    held = channels.select("channel_id", F.col("object_id").alias("held"))
    rows = messages.join(held, "channel_id", "left")
    whole = F.col("object_id").isNotNull() & (F.coalesce("name", F.lit("")) != "")
    by = Window.partitionBy("channel_id").orderBy("seen", "id")
    first = F.coalesce("held", F.first(F.when(whole & F.col("channel_id").isNotNull(), F.col("object_id")), ignorenulls=True).over(by))
    verdict = F.when(~whole, "incomplete").when(F.col("channel_id").isNotNull() & (first != F.col("object_id")), "reassigned").otherwise("accepted")
    return rows.withColumn("verdict", verdict).drop("held")


def upsert_equipment(channels: DataFrame, verdicts: DataFrame) -> DataFrame:
    """channel_id, object_id, name of the catalogue after the accepted messages; the last one of a channel names it."""
    new = verdicts.where("verdict = 'accepted' and channel_id is not null").groupBy("channel_id").agg(F.max_by(F.struct("object_id", "name"), F.struct("seen", "id")).alias("x"))
    both = channels.select("channel_id", "object_id", "name").withColumnsRenamed({"object_id": "o", "name": "n"}).join(new, "channel_id", "full")
    return both.select("channel_id", F.coalesce("x.object_id", "o").alias("object_id"), F.coalesce("x.name", "n").alias("name"))


def upsert_equipment_objects(objects: DataFrame, verdicts: DataFrame) -> DataFrame:
    """object_id, name of the catalogue after the accepted messages; the last one of an object names it, whatever its channel."""
    new = verdicts.where("verdict = 'accepted'").groupBy("object_id").agg(F.max_by("name", F.struct("seen", "id")).alias("new_name"))
    both = objects.select("object_id", "name").join(new, "object_id", "full")
    return both.select("object_id", F.coalesce("new_name", "name").alias("name"))


def upsert_locations(locations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """object_id, longitude, latitude after the accepted messages that have a place; the last of them counts."""
    new = verdicts.where("verdict = 'accepted' and longitude is not null").groupBy("object_id").agg(F.max_by(F.struct("longitude", "latitude"), F.struct("seen", "id")).alias("place"))
    both = locations.select("object_id", F.struct("longitude", "latitude").alias("held")).join(new, "object_id", "full")
    return both.select("object_id", F.coalesce("place", "held").alias("p")).select("object_id", "p.longitude", "p.latitude")


def pick_sources(listing: DataFrame) -> DataFrame:
    """listing (path, year, format): the best file of each year, Parquet before CSV before archives."""
    priority = F.when(F.col("format") == "parquet", 0).when(F.col("format") == "csv", 1).otherwise(2)
    return listing.withColumn("n", F.row_number().over(Window.partitionBy("year").orderBy(priority, "path"))).where("n = 1").drop("n")


def missing_years(picked: DataFrame) -> DataFrame:
    span = picked.agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("year"))
    return span.join(picked.select("year"), "year", "left_anti")


def new_files(listing: DataFrame, done: DataFrame) -> DataFrame:
    """listing (path, kind, content) whose SHA-256 of kind and content isn't among the completed imports; failed ones come again."""
    keyed = listing.withColumn("file_key", F.sha2(F.concat(F.col("kind"), F.lit(":"), F.sha2("content", 256)), 256)).dropDuplicates(["file_key"])
    return keyed.join(done.where("status = 'completed'").select("file_key"), "file_key", "left_anti")


def report(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    """At most `limit` rows with spreadsheet-safe text, and whether there are more."""
    some = rows.orderBy(*order).limit(limit + 1)
    numbered = some.withColumns({"__n": F.row_number().over(Window.orderBy(*order)), "truncated": F.count("*").over(Window.partitionBy()) > limit}).where(F.col("__n") <= limit).drop("__n")
    return numbered.withColumns({f.name: S.neutral_cell(F.col(f.name)) for f in rows.schema if isinstance(f.dataType, T.StringType)})


def checked_weather(raw: DataFrame) -> DataFrame:
    """One row: days, whether they have no gap and no null."""
    values = [c for c in raw.columns if c != "day"]
    return raw.agg(F.count("*").alias("days"), (F.count_distinct("day") == F.date_diff(F.max("day"), F.min("day")) + 1).alias("continuous"), (F.count_if(F.greatest(*(F.col(c).isNull().cast("int") for c in [*values, *values[:1]])) == 1) == 0).alias("complete"))


def weather_features(raw: DataFrame, value: str) -> DataFrame:
    """Three and seven row sums and means (null before the window is full), leads and the change by a day."""
    by = Window.orderBy("day")
    full = lambda n, f: F.when(F.count("*").over(by.rowsBetween(-(n - 1), 0)) == n, f(value).over(by.rowsBetween(-(n - 1), 0)))
    return raw.select("day", value, full(3, F.sum).alias("sum_3"), full(7, F.avg).alias("mean_7"), full(7, F.max).alias("max_7"), F.lead(value, 1).over(by).alias("next_1"), F.lead(value, 2).over(by).alias("next_2"), (F.col(value) - F.lag(value).over(by)).alias("change"))


def register(raw: DataFrame, known: DataFrame) -> DataFrame:
    """Confirmed incidents of known types, by day, once each."""
    rows = raw.where("confirmed").join(known, "type", "left_semi")
    return rows.select("object_id", "type", F.to_date("start").alias("day")).distinct()


def manifest(table: DataFrame, by: str, key: str) -> DataFrame:
    """Rows, range of the key and an order-free checksum of each part of a table: the sum of the first 32 bits of each row's MD5."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in table.columns))
    checksum = F.sum(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"))
    return table.groupBy(by).agg(F.count("*").alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"), checksum.alias("checksum"))


def changed_parts(now: DataFrame, then: DataFrame, by: str) -> DataFrame:
    """Parts whose manifest differs, is missing or is new."""
    both = now.select(by, F.struct("rows", "checksum").alias("now")).join(then.select(by, F.struct("rows", "checksum").alias("then")), by, "full")
    return both.where(~F.col("now").eqNullSafe(F.col("then"))).select(by)


def check_messages(messages: DataFrame, now: Column) -> DataFrame:
    """messages with errors: rules that a record breaks."""
    m = F.col
    rules = {"future_time": m("observed_at") > now + F.expr("interval 5 minutes"), "half_location": m("longitude").isNull() != m("latitude").isNull(), "longitude_range": ~m("longitude").between(-180, 180), "latitude_range": ~m("latitude").between(-90, 90), "unknown_kind": ~m("kind").isin("telemetry", "equipment", "ods", "work_status", "weather"), "not_finite": F.isnan("value") | (F.abs("value") == float("inf")), "no_id": S.empty_to_null(m("external_id")).isNull()}
    return messages.withColumn("errors", F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items()))))
