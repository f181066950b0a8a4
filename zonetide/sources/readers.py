"""Table, file and log readers. Paths may be files, folders or globs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonetide import settings as S
from zonetide.functions import clock
from zonetide.functions.numeric import safe_double, safe_int
from zonetide.operators.enrich import zone_types
from zonetide.operators.spatial import in_box
from zonetide.sources import schemas

BAD = "_malformed"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; filters and column choices reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """Zone table from CSV; the type is filled in by name when the file has none."""
    header = spark.read.option("header", True).csv(path)
    kinds = {"zone_id": "int", "lat": "double", "lon": "double"}
    typed = header.select([F.col(c).try_cast(kinds.get(c, "string")).alias(c) for c in header.columns])
    return zone_types(typed)


def read_pings(spark: SparkSession, path: str, now=None) -> DataFrame:
    """Ping CSV: header names are trimmed and lowered, times read as UTC, points outside the box dropped."""
    raw = spark.read.option("header", True).csv(path)
    named = raw.toDF(*[{"latitude": "lat", "longitude": "lon"}.get(c.strip().lower(), c.strip().lower()) for c in raw.columns])
    fallback = F.current_timestamp() if now is None else now
    at = clock.parse_iso("timestamp") if "timestamp" in named.columns else fallback
    typed = named.withColumns({"lat": F.col("lat").try_cast("double"), "lon": F.col("lon").try_cast("double"), "timestamp": at})
    return in_box(typed)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All snapshot CSVs of a folder, typed, with instants. Spark lists and reads the files in parallel."""
    raw = spark.read.schema(schemas.SNAPSHOT_TEXT).option("header", True).csv(path)
    return raw.withColumns({"zone_id": F.col("zone_id").try_cast("int"), "taxi_count": F.col("taxi_count").try_cast("int"),
                            "timestamp": clock.parse_iso("timestamp")})


def newest_snapshots(snapshots: DataFrame, n: int = 12, ts: str = "timestamp") -> DataFrame:
    """Rows of the n newest snapshots."""
    wanted = snapshots.select(ts).distinct().orderBy(F.col(ts).desc()).limit(n)
    return snapshots.join(wanted, ts, "left_semi")


def file_time(name, tz: str = S.LOCAL_TIMEZONE):
    """Capture hour from names like 2026-04-17_08-30.csv (local time); null for other names."""
    part = F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})_(\d{2})-(\d{2})\.[A-Za-z]+$", 0)
    text = F.regexp_replace(part, r"^(\d{4}-\d{2}-\d{2})_(\d{2})-(\d{2})\..*$", "$1 $2:$3:00")
    return clock.hour_floor(clock.instant(text.try_cast("timestamp"), tz))


def read_timed_files(spark: SparkSession, path: str, tz: str = S.LOCAL_TIMEZONE, schema: str | None = None) -> DataFrame:
    """CSV files stamped by their names; files with other names are skipped."""
    reader = spark.read.option("header", True)
    raw = (reader.schema(schema) if schema else reader).csv(path)
    return raw.withColumn("snap_ts", file_time(F.col("_metadata.file_name"), tz)).filter(F.col("snap_ts").isNotNull())


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Log of one JSON object per line; lines that do not parse are skipped."""
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", f"{schema}, {BAD} string", how).alias("r"))
    return parsed.filter(F.col("r").isNotNull() & F.col(f"r.{BAD}").isNull()).select("r.*").drop(BAD)


def newest_lines(log: DataFrame, n: int, by: str = "timestamp") -> DataFrame:
    """The n newest log rows by an ISO time column."""
    at = clock.parse_iso_or_epoch_start(by)
    return log.withColumn("_at", at).orderBy(F.col("_at").desc()).limit(n).drop("_at")


def read_score_history(spark: SparkSession, path: str) -> DataFrame:
    """Run history in long form; keys that are no zone ids are dropped, bad scores become 0."""
    raw = read_json_lines(spark, path, schemas.SCORE_HISTORY)
    long = raw.select(clock.parse_iso("timestamp").alias("timestamp"), F.explode("zones").alias("k", "v"), "taxi_counts")
    return (long.select("timestamp", safe_int("k", -1).alias("zone_id"), safe_double("v").alias("score"),
                        safe_int(F.col("taxi_counts")[F.col("k")], 0).alias("taxi_count"))
            .filter((F.col("zone_id") >= 0) & F.col("timestamp").isNotNull()))


def read_cards(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Recommendation CSV: only empty text is null, so "N/A" stays text."""
    reader = spark.read.option("header", True).option("nullValue", "").option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """Edges (zone, neighbor) from lines of JSON {zone, neighbors}; a null list has no edges."""
    return edges(read_json_lines(spark, path, schemas.ADJACENCY))


def read_adjacency_text(spark: SparkSession, path: str) -> DataFrame:
    """Edges from the plain ``Name: [A, B]`` / ``Name:`` + ``- A`` text form.

    Zone maps are one small file; inside it, list items belong to the last name above them, so each
    file is read whole (one row per file) and split there.
    """
    text = spark.read.option("wholetext", True).text(path)
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: (F.trim(x) != "") & ~F.ltrim(x).startswith("#"))
    line = text.select(F.col("_metadata.file_path").alias("file"), F.posexplode(lines).alias("pos", "line"))
    head = F.regexp_extract("line", r"^([^\s#-][^:]*):", 1)
    inline = F.regexp_extract("line", r"^[^\s#-][^:]*:\s*\[(.*)\]", 1)
    item = F.regexp_extract("line", r"^\s*-\s*(.+?)\s*$", 1)
    from pyspark.sql import Window as W

    order = W.partitionBy("file").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    named = line.select(F.last(F.when(head != "", head), ignorenulls=True).over(order).alias("zone"),
                        F.when(inline != "", F.split(inline, r"\s*,\s*")).when(item != "", F.array(item)).alias("neighbors"))
    clean = lambda c: F.regexp_replace(F.trim(c), r"^[\"']|[\"']$", "")
    return edges(named).select(clean("zone").alias("zone"), clean("neighbor").alias("neighbor"))


def edges(adjacency: DataFrame) -> DataFrame:
    """(zone, neighbors) to one row per edge."""
    return adjacency.select("zone", F.explode("neighbors").alias("neighbor"))


def read_holidays(spark: SparkSession, path: str | None) -> DataFrame:
    """Holiday dates from JSON (wrapped records or a plain list); the built-in dates without a file."""
    if path is None:
        days = F.array(*[F.lit(d) for d in S.PUBLIC_HOLIDAYS]).cast("array<date>")
        return spark.range(1).select(F.explode(days).alias("day"))
    both = f"{schemas.HOLIDAY_PAYLOAD}, {schemas.HOLIDAY_ROW}"
    raw = spark.read.schema(both).option("multiLine", True).json(path)
    rows = F.when(F.col("result").isNotNull(), F.col("result.records")).otherwise(
        F.array(F.struct("date", "holiday_name")))
    return (raw.select(F.explode(rows).alias("r")).select(F.col("r.date").try_cast("date").alias("day"), "r.holiday_name")
            .filter(F.col("day").isNotNull()))
