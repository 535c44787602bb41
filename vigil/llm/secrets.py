"""Secrets by fixed patterns and by a battery of randomness tests. DataFrame functions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.llm.common import row_key, staged

#: Fixed patterns, in the order in which kinds are listed. For access and hex the least length is in the
#: pattern, which finds the same matches as taking the longest run and dropping short ones.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
#: Runs of an encoding's letters that are long enough to be tested.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "random")
#: Alphabets of the encodings, in the order in which they are tried, and the share of a natural text's letters they hold.
ENCODINGS = (("hex", "0123456789abcdef", 0.4), ("HEX", "0123456789ABCDEF", 0.4), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.0), ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 1.0), ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=", 1.0), ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_=", 1.0))
#: Shares of a to z in natural text in parts of ten thousand, and the part of it that is taken as even.
LETTERS, EVEN = (820, 150, 280, 430, 1270, 220, 200, 610, 700, 15, 77, 400, 240, 670, 750, 190, 10, 600, 630, 910, 280, 98, 240, 15, 200, 7), 0.02
#: Neighbours of natural text that differ in case or kind, with one case and with both, and its lag-one correlation of letter values.
CHANGES, BOTH_CASES, SERIAL = 0.05, 0.3, 0.4
#: A test beyond this z rejects randomness; share of false discoveries.
REJECT_Z, FALSE_SHARE = 3.3, 0.01
#: Candidates of like length are judged together; p-values are kept in steps of a tenth of a decade.
LENGTH_BINS, P_STEPS = (28, 40, 64, 128), 400


def _matches(kind: str, pattern: str) -> Column:
    """An array of (gap before, length, fine, value) for each match, from the texts between matches."""
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all("text", F.lit(pattern), F.lit(2)) if kind == "assign" else found
    gaps = F.split("text", pattern, -1)
    each = F.zip_with(F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("all")), value, lambda x, v: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["all"]).alias("len"), (F.length(v) >= 8 if kind == "assign" else F.lit(True)).alias("fine"), (v if kind == "random" else F.lit(None).cast("string")).alias("value")))
    # Most texts lack a fixed part of the pattern, which is told without it.
    parts = {"assign": ("password", "passwd", "secret", "token", "api"), "access": ("AKIA",)}.get(kind, ("",))
    own = F.lower("text") if kind == "assign" else F.col("text")
    some = reduce(lambda a, b: a | b, (own.contains(p) for p in parts))
    return F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.when(some, F.when(F.size(found) > 0, each)).alias("found"))


def spans_of(rows: DataFrame) -> DataFrame:
    """row, kind (its place in KINDS), start, end, value for each match that is long enough, by code points."""
    kinds = F.array(*(_matches(k, p) for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, CANDIDATE), strict=True)))
    per_kind = rows.select("row", F.explode(kinds).alias("k")).where("k.found is not null").select("row", "k.kind", F.posexplode("k.found").alias("at", "m"))
    # Repeated rows have one key; one of each match stands for them all.
    each = per_kind.groupBy("row", "kind", "at").agg(F.first("m").alias("m")).select("row", "kind", "at", "m.*")
    upto = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(upto)
    return each.select("row", "kind", (end - F.col("len")).alias("start"), end.alias("end"), "fine", "value").where("fine").drop("fine")


def _normal_cdf(z: Column) -> Column:
    return 1 / (1 + F.exp(-1.5976 * z - 0.070565 * z * z * z))


def randomness(found: DataFrame, value: str = "value") -> DataFrame:
    """found with encoding, z_uniform, z_runs, z_serial, p of each and p: how likely natural text of that length looks so even.

    The encoding is the first whose alphabet holds all characters. z_uniform is the chi-squared statistic of
    its alphabet, brought to a normal scale by its cube root (Wilson and Hilferty) with the degrees of freedom that give
    its exact variance for so few letters over so many cells; z_runs counts runs above and below the alphabet's middle,
    z_serial is the lag-one correlation of letter values.

    p combines what the three tests say against natural text. For the letters' frequencies it is the inverse of
    how much likelier even letters are (by Markov's inequality natural text gets below it that seldom), and for
    hexadecimal text the chance that so many letters come from its alphabet. For runs of one case or kind it is
    Chernoff's bound of so many changes, for the serial test the normal tail. The last two depend on each other,
    so twice the less counts; with the first, which asks for letters whatever their order, by Fisher's method."""
    v = F.col(value)
    encoding = F.coalesce(*(F.when(v.rlike("^[" + a.replace("-", r"\-") + "]+$"), F.lit(name)) for name, a, _ in ENCODINGS))
    pick = lambda f: F.coalesce(*(F.when(F.col("encoding") == name, f(a, share)) for name, a, share in ENCODINGS))
    out = found.withColumn("encoding", encoding).withColumn("letters", F.filter(F.split(v, ""), lambda x: x != ""))
    out = out.withColumn("size", pick(lambda a, _: F.lit(float(len(a.rstrip("="))))))
    out = out.withColumn("at", pick(lambda a, _: F.transform("letters", lambda x: (F.position(x, F.lit(a)) - 1).cast("double"))))
    n, size = F.size("letters").cast("double"), F.col("size")
    squares = F.aggregate(F.array_distinct("letters"), F.lit(0.0), lambda a, x: a + F.pow((F.length(v) - F.length(F.replace(v, x, F.lit("")))).cast("double"), F.lit(2.0)))
    out = out.withColumn("n", n).withColumn("squares", squares)
    n = F.col("n")
    pairs = F.zip_with(F.slice("at", 1, F.size("at") - 1), F.slice("at", 2, F.size("at") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    out = out.withColumn("pairs", pairs).withColumn("high", F.size(F.filter("at", lambda x: x >= F.col("size") / 2)).cast("double"))
    low, high = n - F.col("high"), F.col("high")
    runs = 1 + F.size(F.filter("pairs", lambda p: (p["a"] >= F.col("size") / 2) != (p["b"] >= F.col("size") / 2)))
    mean = 2 * low * high / n + 1
    deviation = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
    serial = F.aggregate("pairs", F.lit(0.0), lambda a, p: a + (p["a"] - (F.col("size") - 1) / 2) * (p["b"] - (F.col("size") - 1) / 2)) / ((size * size - 1) / 12) / F.sqrt(n - 1)
    even = F.array(*(F.lit(-math.log(26 * ((1 - EVEN) * c / sum(LETTERS) + EVEN / 26))) for c in LETTERS))
    gain = F.aggregate("letters", F.lit(0.0), lambda a, x: a + F.coalesce(F.get(even, F.ascii(F.lower(x)) - ord("a")), F.lit(0.0)))
    hexadecimal = pick(lambda _, share: F.lit(share))
    natural = pick(lambda a, _: F.lit(BOTH_CASES if "A" in a and "a" in a else CHANGES))
    share = F.least((F.regexp_count(v, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+")) - 1) / (n - 1), F.lit(1 - 1e-9))
    divergence = share * F.log(F.greatest(share, F.lit(1e-9)) / natural) + (1 - share) * F.log((1 - share) / (1 - natural))
    free = (size - 1) * n / (n - 1)
    out = out.withColumns({"z_uniform": (F.cbrt((size * F.col("squares") / n - n) / (size - 1)) - 1 + 2 / (9 * free)) * F.sqrt(4.5 * free), "z_runs": (runs - mean) / deviation, "z_serial": serial})
    out = out.withColumns({"p_uniform": F.when(hexadecimal < 1, F.pow(hexadecimal, n)).otherwise(F.least(F.exp(-gain), F.lit(1.0))), "p_runs": F.when(share > natural, F.exp((1 - n) * divergence)).otherwise(1.0), "p_serial": F.least(_normal_cdf(F.col("z_serial") - SERIAL * F.sqrt(n - 1)), F.lit(1.0))})
    both = F.greatest(F.col("p_uniform") * F.least(2 * F.least("p_runs", "p_serial"), F.lit(1.0)), F.lit(1e-300))
    out = out.withColumn("p", F.least(both * (1 - F.log(both)), F.lit(1.0)))
    return out.drop("letters", "size", "at", "squares", "pairs", "high")


def discoveries(tested: DataFrame) -> DataFrame:
    """The tested candidates that hold: no test rejects randomness, and p passes the false-discovery bound of its length.

    In each length bin the largest p with p <= FALSE_SHARE * rank / candidates is the bound, found on counts by
    steps of p (P_STEPS at most in a bin), so no list of candidates is sorted or gathered."""
    length_bin = F.lit(0)
    for i, least in enumerate(LENGTH_BINS, 1):
        length_bin = F.when(F.col("n") >= least, i).otherwise(length_bin)
    step = F.least(F.floor(-10 * F.log10(F.greatest("p", F.lit(1e-300)))), F.lit(P_STEPS)).cast("int")
    judged = tested.withColumns({"bin": length_bin, "step": step})
    counts = judged.groupBy("bin", "step").count()
    whole = Window.partitionBy("bin")
    upto = whole.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    passed = F.pow(F.lit(10.0), -F.col("step") / 10) <= FALSE_SHARE * F.sum("count").over(upto) / F.sum("count").over(whole)
    bound = counts.withColumn("passed", passed).where("passed").groupBy("bin").agg(F.min("step").alias("least_step"))
    random = (F.abs("z_uniform") <= REJECT_Z) & (F.abs("z_runs") <= REJECT_Z) & (F.abs("z_serial") <= REJECT_Z)
    # At most one row for each length bin.
    return judged.join(F.broadcast(bound), "bin").where((F.col("step") >= F.col("least_step")) & random)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans for each row of docs (doc_id, text).

    Base kinds are the fixed patterns, each by itself, leftmost and not overlapping. The battery adds `random`
    spans: runs of 20 or more letters of an encoding, with two of lower case, upper case and digits, that no
    base span touches, that look random and pass the false-discovery bound over all documents.

    Null texts are empty. Rows with equal doc_id and text are returned each, with one result. Texts are
    searched to their end; matches of a long text are rows, not one growing array. An empty table gives an
    empty result."""
    rows = docs.select("doc_id", row_key().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    spans = staged(spans_of(rows))
    is_base = F.col("kind") < 3
    # Of spans with one start, base ones come first, so that a candidate sees them.
    ahead = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy("row").orderBy(F.desc("start"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    touched = (F.coalesce(F.max(F.when(is_base, F.col("end"))).over(ahead), F.lit(0)) > F.col("start")) | (F.min(F.when(is_base, F.col("start"))).over(behind) < F.col("end"))
    classes = sum((F.col("value").rlike(c).cast("int") for c in ("[a-z]", "[A-Z]", "[0-9]")), F.lit(0))
    free = spans.withColumn("touched", F.coalesce(touched, F.lit(False))).where(~is_base & ~F.col("touched") & (classes >= 2)).drop("touched")
    random = discoveries(randomness(free).where("encoding is not null"))
    chosen = spans.where(is_base).select("row", "kind", "start", "end").union(random.select("row", "kind", "start", "end"))
    name = F.element_at(F.array(*(F.lit(k) for k in KINDS)), F.col("kind") + 1)
    each = chosen.withColumn("s", F.struct("start", "kind", F.concat_ws(":", name, "start", "end").alias("t")))
    # A text's own spans, as strings: their number is bounded by its length.
    listed = each.groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("all"), *(F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(KINDS)))
    join = lambda c: F.array_join(F.transform(c, lambda x: x["t"]), ",")
    listed = listed.select("row", *(f"n_{k}" for k in KINDS), join(F.filter("all", lambda x: x["kind"] < 3)).alias("base"), join("all").alias("spans"))
    out = rows.select("doc_id", "row").join(listed, "row", "left")
    return out.select("doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
