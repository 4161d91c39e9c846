"""Reading tables, normalising raw laps, loading seasons and building tables."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock import fixed
from paddock.functions.scalars import interval_seconds
from paddock.operators.lookups import join_lookup
from paddock.operators.reshape import top_k
from paddock.schemas import TABLES


def read_table(spark: SparkSession, root: str, name: str, fmt: str = "parquet", **options) -> DataFrame:
    """Read a table of the data model from parquet, csv or json with its fixed schema."""
    reader = spark.read.schema(TABLES[name]).options(**options)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.format(fmt).load(f"{root}/{name}.{fmt}")


def normalize_laps(raw: DataFrame, drivers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(laps, rejects) from feed laps; rejects carry a reason.

    Rows need a mapped driver code and a lap number.  A number that is NaN or does not fit is
    a missing number; only a missing lap number rejects the row.
    """
    def whole(name: str):
        value = F.col(name).try_cast("double")
        return F.when(~F.isnan(value), value).try_cast("int")

    codes = drivers.select(F.col("code").alias("Driver"), F.col("id").alias("driver_id"))
    rows = join_lookup(raw, codes, ["Driver"]).withColumn(
        "reason",
        F.when(F.col("driver_id").isNull(), "unmapped driver").when(
            whole("LapNumber").isNull(), "no lap number"
        ),
    )
    kept = [c for c in ("session_id", "stint_number", "created_at") if c in raw.columns]
    laps = rows.filter("reason is null").select(
        *kept,
        "driver_id",
        whole("LapNumber").alias("lap_number"),
        interval_seconds("LapTime").alias("lap_time_seconds"),
        F.coalesce("Compound", F.lit("UNKNOWN")).alias("compound"),
        F.coalesce(whole("TyreLife"), F.lit(0)).alias("tyre_age_laps"),
        F.coalesce("IsAccurate", F.lit(False)).alias("is_valid"),
        whole("Position").alias("position"),
        F.col("TrackStatus").cast("string").alias("track_status"),
        interval_seconds("Sector1Time").alias("sector1_seconds"),
        interval_seconds("Sector2Time").alias("sector2_seconds"),
        interval_seconds("Sector3Time").alias("sector3_seconds"),
    )
    return laps, rows.filter("reason is not null").select(*raw.columns, "reason")


def validate_laps(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid lap records, rejects with the first failing field)."""
    uuid = "^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"

    def is_id(name: str):
        return F.coalesce(F.col(name).cast("string").rlike(uuid), F.lit(False))

    def bad_number(name: str, kind: str):
        return F.col(name).isNotNull() & F.col(name).try_cast(kind).isNull()

    times = ["lap_time_seconds", "sector1_seconds", "sector2_seconds", "sector3_seconds"]
    have = [t for t in times if t in df.columns]
    field = (
        F.when(~is_id("session_id"), "session_id")
        .when(~is_id("driver_id"), "driver_id")
        .when(F.col("lap_number").try_cast("int").isNull(), "lap_number")
        .when(F.col("compound").isNull(), "compound")
    )
    for name, kind in (("tyre_age_laps", "int"), ("is_valid", "boolean")):
        if name in df.columns:
            field = field.when(bad_number(name, kind), name)
    for t in have:
        field = field.when(bad_number(t, "double"), t)
    rows = df.withColumn("reason", field)

    def or_default(name: str, kind: str, value):
        held = F.col(name).try_cast(kind) if name in df.columns else F.lit(None).cast(kind)
        return F.coalesce(held, F.lit(value)).alias(name)

    ok = rows.filter("reason is null").select(
        "session_id", "driver_id", F.col("lap_number").try_cast("int").alias("lap_number"),
        *[(F.col(t).try_cast("double") if t in have else F.lit(None).cast("double")).alias(t) for t in times],
        "compound", or_default("tyre_age_laps", "int", 0), or_default("is_valid", "boolean", True),
    )
    return ok, rows.filter("reason is not null")


def map_circuits(rounds: DataFrame, circuits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rounds with circuit_id, rejected rounds with a reason) through the location aliases."""
    alias = F.create_map(*[F.lit(x) for pair in fixed.LOCATIONS.items() for x in pair])
    named = rounds.withColumn("circuit_name", F.try_element_at(alias, F.col("location")))
    known = circuits.select(F.col("id").alias("circuit_id"), F.col("name").alias("circuit_name"))
    rows = join_lookup(named, known, ["circuit_name"]).withColumn(
        "reason",
        F.when(F.col("circuit_name").isNull(), "unknown location").when(
            F.col("circuit_id").isNull(), "circuit not seeded"
        ),
    )
    return rows.filter("reason is null").drop("reason"), rows.filter("reason is not null").select(
        *rounds.columns, "reason"
    )


def load_season(
    spark: SparkSession, root: str, season: int, session_type: str = "R",
    rounds: Sequence[int] = tuple(fixed.ROUNDS),
) -> tuple[DataFrame, DataFrame]:
    """(raw laps of a season, rounds that could not be read) from season=/round=/ folders.

    A round is loaded whole or not at all.  Each round is decoded once by a job of its own, and
    one file of it that fails, for whatever reason, rejects the round with the first line of
    the error; the rest are then read strictly in one scan.  The rounds of a season bound the
    number of jobs.
    """
    path = f"{root}/season={season}/session_type={session_type}"
    schema = TABLES["raw_laps"]
    whole, broken = [], []
    for number in map(int, rounds):
        folder = f"{path}/round_number={number}"
        try:
            rows = spark.read.schema(schema).option("ignoreCorruptFiles", "false").parquet(folder)
            rows.select(F.count(F.xxhash64(*rows.columns))).collect()
            whole.append(folder)
        except (PySparkException, Py4JJavaError) as error:
            broken.append((number, str(error).strip().split("\n")[0]))
    reader = spark.read.schema(f"{schema}, round_number int").option("ignoreCorruptFiles", "false").option("basePath", path)
    raw = reader.parquet(*whole) if whole else spark.createDataFrame([], f"{schema}, round_number int")
    raw = raw.withColumns({"season": F.lit(season), "session_type": F.lit(session_type)})
    return raw, spark.createDataFrame(broken, "round_number int, reason string")


def dedupe(batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key by arrival order."""
    return top_k(batch, keys, [F.col(o) for o in order], 1)


def append_new(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of the batch to append: one per key, and only keys the target lacks.

    The target's duplicates cannot multiply rows (anti join), and both sides meet on the
    full key, so no group is large.
    """
    return dedupe(batch, keys, order).join(target.select(*keys), list(keys), "left_anti")


def update_matched(target: DataFrame, updates: DataFrame, keys: Sequence[str], cols: Sequence[str],
                   order: Sequence[str] | None = None) -> DataFrame:
    """New version of the target: matched keys take the update's values, NULLs included.

    ``order`` picks one update per key when there are several (the last wins).
    """
    if order:
        updates = top_k(updates, keys, [F.col(o).desc() for o in order], 1)
    new = updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in cols], F.lit(True).alias("_hit"))
    joined = target.join(new, list(keys), "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
            for c in target.columns
        ]
    )


def ensure_dim(existing: DataFrame, incoming: DataFrame, natural_key: Sequence[str]) -> DataFrame:
    """Dimension rows with incoming keys added; existing rows keep their id.

    New ids are a hash of the natural key, so two jobs creating the same row agree.
    """
    fresh = top_k(incoming, natural_key, [F.to_json(F.struct(*incoming.columns))], 1)
    fresh = fresh.join(existing.select(*natural_key), list(natural_key), "left_anti")
    new_id = F.sha2(F.to_json(F.struct(*natural_key)), 256)
    return existing.unionByName(fresh.withColumn("id", new_id), allowMissingColumns=True)


def write_laps(df: DataFrame, path: str) -> None:
    """Lap table on disk, partitioned so that a season or session prunes."""
    df.write.mode("overwrite").partitionBy("season", "session_id").parquet(path)


def build_strategy_tables(
    windows: DataFrame, overview: DataFrame, path: str
) -> None:
    """Store pit windows and overview, replacing only the sessions present."""
    for name, df in (("pit_windows", windows), ("overview", overview)):
        (
            df.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("session_id")
            .parquet(f"{path}/{name}")
        )
