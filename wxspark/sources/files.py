"""Readers of the archive's file formats (SC04-SC13). Each takes a path or a frame of lines and returns typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wxspark.operators.asof import latest_at_key


def finite(c: Column) -> Column:
    """A double, with NaN and infinities as null."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def archive_csv(spark: SparkSession, path: str) -> DataFrame:
    """SC04: the report archive's CSV; M is missing, T a trace."""
    raw = spark.read.option("header", True).option("nullValue", "M").option("comment", "#").csv(path)
    return raw.select(F.col("station"), F.to_timestamp_ntz("valid", F.lit("yyyy-MM-dd HH:mm")).alias("obs_time"), *(F.when(F.col(c) == "T", 0.0).otherwise(F.expr(f"try_cast({c} as double)")).alias(c) for c in raw.columns if c not in ("station", "valid", "metar")), *(F.col(c) for c in raw.columns if c == "metar"))


def forecast_csv(spark: SparkSession, path: str, meta: tuple[str, ...] = ("forecasted_at", "forecasted_time", "lat", "lon")) -> DataFrame:
    """SC05, R04: a wide forecast series to tall rows: ISO times without a zone, blanks and NaN as null."""
    raw = spark.read.option("header", True).csv(path)
    fields = [c for c in raw.columns if c not in meta]
    when = lambda c: F.to_timestamp(c).cast("timestamp_ntz")
    wide = raw.select(when("forecasted_at").alias("run"), when("forecasted_time").alias("valid_time"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), *(finite(F.expr(f"try_cast(`{c}` as double)")).alias(c) for c in fields))
    return wide.unpivot(["run", "valid_time", "lat", "lon"], fields, "variable", "value")


def report_json(spark: SparkSession, path: str) -> DataFrame:
    """SC06: reports as JSON rows with epoch seconds."""
    schema = "icaoId string, obsTime long, rawOb string, lat double, lon double"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select(F.col("icaoId").alias("station"), F.timestamp_seconds("obsTime").cast("timestamp_ntz").alias("obs_time"), F.col("rawOb").alias("raw"), "lat", "lon")


def sounding_html(pages: DataFrame, id_col: str, html: str = "html") -> DataFrame:
    """SC07: CSV inside HTML; columns by the header's names; rows without a pressure are left out, a missing field is NaN."""
    text = F.regexp_replace(F.col(html), r"<[^>]+>", "")
    lines = pages.select(id_col, F.filter(F.split(text, r"\r?\n"), lambda l: F.contains(l, F.lit(","))).alias("l")).where("size(l) > 1")
    head = F.transform(F.split(F.element_at("l", 1), ","), lambda x: F.lower(F.trim(x)))
    rows = lines.select(id_col, head.alias("h"), F.posexplode(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0)))).alias("level", "row")).withColumn("f", F.split("row", ","))
    value = lambda name: F.expr(f"try_cast(trim(try_element_at(f, cast(array_position(h, '{name}') as int))) as double)")
    has = lambda name: F.expr(f"array_contains(h, '{name}')")
    field = lambda name: F.when(has(name), F.coalesce(value(name), F.lit(float("nan")))).otherwise(float("nan"))
    out = rows.select(id_col, "level", F.when(has("pressure"), value("pressure")).alias("pres"), *(field(n).alias(n) for n in ("temp", "dewpoint", "dir", "speed")))
    return out.where("pres is not null")


def bulletins(pages: DataFrame, html: str = "html", pattern: str = r"(TAF(?: AMD| COR)? [A-Z]{4} \d{6}Z[^<=]*)") -> DataFrame:
    """SC08, SC10: bulletins out of archive pages, each once."""
    return pages.select(F.explode(F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))).alias("raw")).select(F.trim(F.regexp_replace("raw", r"\s+", " ")).alias("raw")).distinct()


def fixed_width(lines: DataFrame, columns: dict[str, tuple[int, int, str]], key: list[str], newest: str, column: str = "value") -> DataFrame:
    """SC09: a fixed-width catalogue: name -> (start from 1, length, type); of duplicates the newest stays."""
    cut = [F.expr(f"try_cast(nullif(trim(substring({column}, {start}, {size})), '') as {kind})").alias(name) for name, (start, size, kind) in columns.items()]
    return latest_at_key(lines.select(*cut).where(" and ".join(f"{k} is not null" for k in key)), key, [F.col(newest)])


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """SC12: message lists, gzipped or not, one file a run."""
    message = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
    files = spark.read.option("wholetext", True).text(path).withColumn("file", F.input_file_name())
    return files.select("file", F.posexplode(F.from_json("value", message)).alias("turn", "m")).select("file", "turn", "m.role", "m.content")


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """SC13, X43: files by the SHA-256 of their content, with a kind read from their first bytes."""
    head = F.hex(F.substring("content", 1, 4))
    kind = F.when(head == "89504E47", "png").when(head.startswith("FFD8FF"), "jpeg").when(head == "47494638", "gif").when(head.startswith("1F8B"), "gzip").otherwise("other")
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), kind.alias("kind"))


def missing_blobs(keys: DataFrame, found: DataFrame) -> DataFrame:
    """SC13: keys whose blob isn't there; a caller raises if there are any."""
    return keys.join(found.select("sha256").distinct(), "sha256", "left_anti")
