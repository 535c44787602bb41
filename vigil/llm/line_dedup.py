"""Repeated passages of whole lines, found by winnowing and deleted where they come again. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.llm.common import one_of_each_row, row_key, staged, unused

#: Words of a passage that counts as repeated, and of a line at least that is preferred as its fingerprint.
PASSAGE_WORDS, LINE_WORDS = 50, 4
#: White space at the ends of a line, as in the test for words.
BLANKS = " \t\x0b\f\r"
#: Rows of one key that a task takes at most where there are more; and keys that are dealt so (a bound of what is broadcast for it).
HOT_ROWS, HOT_KEYS = 200_000, 100_000


def lines_of(docs: DataFrame) -> DataFrame:
    """row, doc_id, at (number of the line in its text), i (number among lines with words), b (words before it), h and v (two hashes of
    the trimmed line: 128 bits together), w (words)."""
    # Repeated rows have one key; one of them stands for all.
    rows = docs.where("text is not null").select("doc_id", row_key().alias("row"), "text")
    lines = one_of_each_row(rows, rows).select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    line = F.btrim("line", F.lit(BLANKS))
    lines = lines.select("doc_id", "row", "at", F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("v"), F.regexp_count("line", F.lit(r"\S+")).alias("w")).where("w > 0")
    by = Window.partitionBy("row").orderBy("at")
    return lines.withColumns({"i": F.row_number().over(by), "b": F.sum("w").over(by) - F.col("w")})


def fingerprints(lines: DataFrame) -> DataFrame:
    """row, doc_id, g, gi, passages: the lines that winnowing selects, by their hash g and number gi, with the passages that select them
    (i, the number of the first line, and a hash of all lines).

    A passage is the shortest run of PASSAGE_WORDS words from a line on. Its lines are the window: the least hash among them is
    selected, among lines of LINE_WORDS words if there are any. Equal passages select the same line of theirs, and neighbouring
    ones mostly the same as each other, so that two lines in seven are selected where a passage has six. Frames are ranges of words, so they hold no more lines than words."""
    passage = Window.partitionBy("row").orderBy("b").rangeBetween(0, PASSAGE_WORDS - 1)
    marked = lines.withColumn("mark", F.struct((F.col("w") < LINE_WORDS).alias("short"), F.col("h").alias("g"), F.col("i").alias("gi")))
    whole = marked.select("row", "doc_id", "i", F.min("mark").over(passage).alias("least"), F.sum("w").over(passage).alias("words"), F.xxhash64(F.collect_list("h").over(passage)).alias("passage"))
    return whole.where(F.col("words") >= PASSAGE_WORDS).groupBy("row", "doc_id", F.col("least.g").alias("g"), F.col("least.gi").alias("gi")).agg(F.collect_list(F.struct("i", "passage")).alias("passages"))


def _dealt(big: DataFrame, small: DataFrame, on: list[str], key: str, counted: DataFrame | None = None, place: str = "i") -> DataFrame:
    """big joined with small on `on`; the rows of a hot value of key (one of `on`) go to a task for each HOT_ROWS of them.

    small's rows of a hot value are repeated as often. counted: what gives the rows of each value, if not big itself.
    The table of hot values has at most a row for each HOT_ROWS rows; beyond HOT_KEYS of them the join is left to AQE."""
    hot = staged((counted if counted is not None else big).groupBy(key).count().where(F.col("count") > HOT_ROWS).select(key, F.ceil(F.col("count") / HOT_ROWS).cast("int").alias("salts")))
    if not 0 < hot.count() <= HOT_KEYS:
        return big.join(small, on)
    salts = F.coalesce("salts", F.lit(1))
    left = big.join(F.broadcast(hot), key, "left").withColumn("salt", F.pmod(F.xxhash64("row", place), salts).cast("int")).drop("salts")
    right = small.join(F.broadcast(hot), key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return left.join(right, [*on, "salt"]).drop("salt")


def candidates(marks: DataFrame) -> DataFrame:
    """The passages whose fingerprint stands at more places than one: row, doc_id, i, passage, g, gi."""
    place = F.struct("row", "gi")
    shared = marks.groupBy("g").agg(F.min(place).alias("a"), F.max(place).alias("z")).where("a < z").select("g")
    return _dealt(marks, shared, ["g"], "g", place="gi").select("row", "doc_id", "g", "gi", F.explode("passages").alias("p")).select("row", "doc_id", "p.i", "p.passage", "g", "gi")


def repeated_runs(lines: DataFrame) -> DataFrame:
    """row, start, end (line numbers in the text, inclusive) of every run of lines that an earlier place holds.

    Only selected lines that stand at two places or more are joined by position: with the first place whose passage around
    the line is the same (a line's first place alone may have other lines around it, and all pairs of places would be too many)."""
    found = staged(candidates(staged(fingerprints(lines))))
    place = F.struct("doc_id", "row", "i", "gi")
    first = staged(found.groupBy("passage").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("passage", "first"))
    later = _dealt(found, first, ["passage"], "passage").where(F.struct("doc_id", "row", "i") > F.struct("first.doc_id", "first.row", "first.i"))
    # Where a fingerprint stands here and there; shift tells the diagonal.
    pairs = staged(later.select("row", F.col("first.row").alias("other"), (F.col("gi") - F.col("first.gi")).alias("shift"), "gi").distinct())
    diagonals = pairs.select("row", "other", "shift").distinct()
    # Both ways along each diagonal: the lines that are equal on both sides, by all 128 bits.
    own = diagonals.join(lines.select("row", "i", "at", "h", "v", "w"), "row").withColumn("there", F.col("i") - F.col("shift"))
    theirs = lines.select(F.col("row").alias("other"), F.col("i").alias("there"), "h", "v")
    equal = _dealt(own, theirs, ["other", "there", "h", "v"], "other", pairs)
    along = Window.partitionBy("row", "other", "shift").orderBy("i")
    runs = equal.withColumn("run", F.col("i") - F.row_number().over(along)).groupBy("row", "other", "shift", "run").agg(F.min("i").alias("low"), F.max("i").alias("high"), F.min("at").alias("start"), F.max("at").alias("end"), F.sum("w").alias("words"))
    # Equal hashes of passages only proposed the places: a run that holds the fingerprint must have the words itself.
    held = runs.where(F.col("words") >= PASSAGE_WORDS).join(pairs, ["row", "other", "shift"]).where("gi between low and high")
    return held.select("row", "start", "end").distinct()


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with every later repeat of a passage cut out of text, and n_chars renewed; its columns stay as they are.

    A passage is a run of whole lines (trimmed of white space; lines without words are passed over) of PASSAGE_WORDS words or
    more that stands at an earlier place, by doc_id and line. Passages whose winnowed line stands at one place
    only go at once; the others' lines are joined with that of their first place, extended both ways while lines agree, and the runs that have PASSAGE_WORDS words are deleted, with the blank lines in them. So no
    run of PASSAGE_WORDS words that came before stays. Shorter repeats stay.

    Null and empty texts stay as they are. Rows with equal doc_id and text are one document: both keep what
    either keeps. Rows without doc_id come first. A text may lose all its lines and is then empty; no row is
    dropped. An empty table gives an empty result. n_chars is only renewed where it is a column."""
    key, cut = unused(docs, "row_key", "cuts")
    lines = staged(lines_of(docs))
    # Ranges of one text, merged: a range that begins within what came before goes on with it.
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    ranges = repeated_runs(lines).withColumn("fresh", F.when(F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1)), 1).otherwise(0))
    upto = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    merged = ranges.withColumn("group", F.sum("fresh").over(upto)).groupBy("row", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = merged.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias(cut))
    kept = F.filter(F.split("text", "\n"), lambda x, at: ~F.exists(cut, lambda c: (at >= c["start"]) & (at <= c["end"])))
    out = docs.withColumn(key, row_key()).join(cuts.withColumnRenamed("row", key), key, "left")
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    renewed = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": text}
    return out.withColumns(renewed).select(docs.columns)


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines and n_chars kept, n_dropped, and text_sha256 of what is kept, for each row of docs (doc_id, text)."""
    before = docs.select("doc_id", "text", F.size(F.split("text", "\n")).alias("lines"))
    out = drop_repeated_lines(before)
    kept = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n")))
    return out.select("doc_id", kept.cast("long").alias("n_lines"), (F.col("lines") - kept).cast("long").alias("n_dropped"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
