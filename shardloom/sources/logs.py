"""Benchmark logs, key=value outputs and result tables as DataFrames.

Context lines apply to all that follows them; a running ``last`` over the line
number of each file carries them forward, so files are parsed in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The words of the log lines.
DISTRIBUTION, EXPECTED_MAX = "Distribuzione:", "max/atteso"
PHASES = {"H->D": "h2d_ms", "Kernel": "kernel_ms", "D->H": "d2h_ms", "Totale": "total_ms"}
THROUGHPUT = "Throughput ("


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files, each in one piece for its order."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return text


def field(line: Column, name: str) -> Column:
    """What stands behind ``name=`` in a line of such fields, up to the next
    white space; null if there is none."""
    behind = F.get(F.split(F.concat(F.lit(" "), line), rf"\s\Q{name}=\E", 2), F.lit(1))
    return F.nullif(F.get(F.split(behind, r"\s"), F.lit(0)), F.lit(""))


def _number(line: Column, name: str, kind: str) -> Column:
    return field(line, name).try_cast(kind)


def _framed(line: Column, mark: str) -> Column:
    """The text between two marks at the ends of a line, null without them."""
    n = len(mark)
    return F.when((F.length(line) > 2 * n) & line.startswith(mark) & line.endswith(mark), F.trim(F.substring(line, F.lit(n + 1), F.length(line) - 2 * n)))


def _checksum(line: Column) -> Column:
    value = field(line, "checksum")
    return F.when(value.startswith("0x"), F.substring(value, 3, 64))


def _is_context(line: Column) -> Column:
    return line.startswith("---") & _number(line, "N", "long").isNotNull() & _number(line, "P", "long").isNotNull()


def cpu_results(log: DataFrame) -> DataFrame:
    """One row per result line: experiment, impl, N, P, key_space, median_ms,
    stddev_ms, throughput_Mkeys_s, dist_min, dist_max, dist_ratio, checksum.
    A result line that another follows before the next tag is replaced by it."""
    rows = log.select("file", "line_no", F.trim("line").alias("s")).filter((F.col("s") != "") & ~F.col("s").startswith("#"))
    s = F.col("s")
    is_result = F.lit(True)
    for name in ("N", "median", "stddev", "throughput"):
        is_result = is_result & _number(s, name, "double").isNotNull()
    is_tag = s.startswith("[") & s.endswith("]") & ~F.contains(s, F.lit(" "))
    kind = F.when(_framed(s, "===").isNotNull(), "experiment").when(_is_context(s), "context").when(is_tag, "tag").when(is_result, "result").when(s.startswith(DISTRIBUTION), "distribution").when(_checksum(s).isNotNull(), "checksum").otherwise("other")
    rows = rows.withColumn("kind", kind)
    so_far = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    carried = lambda k, value: F.last(F.when(F.col("kind") == k, value), ignorenulls=True).over(so_far)
    rows = rows.select(
        "file", "line_no", "kind", "s",
        carried("experiment", _framed(s, "===")).alias("experiment"),
        carried("context", _number(s, "P", "long")).alias("p"),
        carried("context", F.coalesce(_number(s, "key_space", "long"), F.lit(0))).alias("ks"),
        carried("tag", F.trim(F.translate(s, "[]", ""))).alias("tag"),
        F.count(F.when(F.col("kind") == "tag", 1)).over(so_far).alias("section"),
    )
    end = Window.partitionBy("file", "section").orderBy(F.desc("line_no"))
    results = rows.filter("kind = 'result'").withColumn("r", F.row_number().over(end)).filter("r = 1")
    results = results.select(
        "file", "section", F.col("line_no").alias("result_line"), F.coalesce("experiment", F.lit("")).alias("experiment"), F.coalesce("tag", F.trim(F.substring_index("s", " N=", 1))).alias("impl"),
        _number(s, "N", "long").alias("N"), F.coalesce("p", F.lit(0)).alias("P"), F.coalesce("ks", F.lit(0)).alias("key_space"),
        _number(s, "median", "double").alias("median_ms"), _number(s, "stddev", "double").alias("stddev_ms"), _number(s, "throughput", "double").alias("throughput_Mkeys_s"),
    )
    notes = rows.filter("kind in ('distribution', 'checksum')").select(F.col("file").alias("f"), F.col("section").alias("sec"), F.col("line_no").alias("note_line"), "kind", "s")
    joined = results.join(notes, (F.col("file") == F.col("f")) & (F.col("section") == F.col("sec")) & (F.col("note_line") > F.col("result_line")), "left")
    last = lambda k, value: F.max_by(F.when(F.col("kind") == k, value), F.when(F.col("kind") == k, F.col("note_line")))
    keys = ["file", "section", "experiment", "impl", "N", "P", "key_space", "median_ms", "stddev_ms", "throughput_Mkeys_s"]
    spread = {"dist_min": _number(s, "min", "long"), "dist_max": _number(s, "max", "long"), "dist_ratio": _number(s, EXPECTED_MAX, "double")}
    out = joined.groupBy(*keys).agg(*(last("distribution", v).alias(n) for n, v in spread.items()), last("checksum", _checksum(s)).alias("checksum"))
    return out.drop("file", "section")


def cuda_results(log: DataFrame) -> DataFrame:
    """One row per context line with its phases, throughputs and checksum."""
    s = F.col("s")
    rows = log.select("file", "line_no", F.trim("line").alias("s")).filter((s != "") & ~s.startswith("#"))
    so_far = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("experiment", F.coalesce(F.last(_framed(s, "==="), ignorenulls=True).over(so_far), F.lit(""))).withColumn("section", F.count(F.when(_is_context(s), 1)).over(so_far)).filter("section > 0")
    # lines of the shape ``name : number unit``
    name, value = F.trim(F.substring_index(s, ":", 1)), F.get(F.split(F.trim(F.substring_index(s, ":", -1)), r"\s+"), F.lit(0)).try_cast("double")
    last = lambda x: F.max_by(x, F.when(x.isNotNull(), F.col("line_no")))
    speed = lambda kernel: last(F.when(name.startswith(THROUGHPUT) & (F.contains(F.lower(name), F.lit("kernel")) == kernel), value))
    in_context = lambda n: F.max(F.when(_is_context(s), _number(s, n, "long"))).alias(n)
    return rows.groupBy("file", "section").agg(
        F.min_by("experiment", "line_no").alias("experiment"), in_context("N"), in_context("P"),
        *(last(F.when(name == phase, value)).alias(column) for phase, column in PHASES.items()),
        speed(True).alias("tput_kernel_Mkeys_s"), speed(False).alias("tput_e2e_Mkeys_s"), last(_checksum(s)).alias("checksum"),
    ).drop("file", "section")


def key_values(log: DataFrame, keys: list[str]) -> DataFrame:
    """One row per file: the last ``key=value`` line of each key, as strings."""
    pair = log.select("file", "line_no", F.regexp_extract("line", r"^(\w+)=(.*)$", 1).alias("k"), F.regexp_extract("line", r"^(\w+)=(.*)$", 2).alias("v")).filter(F.col("k").isin(keys))
    return pair.groupBy("file").agg(*(F.max_by(F.when(F.col("k") == k, F.col("v")), F.when(F.col("k") == k, F.col("line_no"))).alias(k) for k in keys))


def phase_seconds(log: DataFrame, phases: list[str]) -> DataFrame:
    """One row per file: seconds of each phase, the third word of its last line in milliseconds, 0 if none."""
    third = F.element_at(F.split(F.trim("line"), r"\s+"), 3).try_cast("double") / 1000
    of = lambda p: F.coalesce(F.max_by(F.when(F.contains("line", F.lit(p)), third), F.when(F.contains("line", F.lit(p)), F.col("line_no"))), F.lit(0.0))
    return log.groupBy("file").agg(*(of(p).alias(p) for p in phases))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A result table with its schema declared; unsigned checksums are strings, ``#`` lines comments."""
    return spark.read.schema(schema).csv(path, header=True, comment="#")


def write_csv(df: DataFrame, path: str, columns: list[str], decimals: int | None = None) -> None:
    """The columns in this order; doubles with so many decimals, if given."""
    kinds = dict(df.dtypes)
    shown = [F.format_string(f"%.{decimals}f", c).alias(c) if decimals is not None and kinds[c] in ("double", "float") else F.col(c) for c in columns]
    df.select(*shown).write.mode("overwrite").csv(path, header=True)
