"""Signal tables: pre-converted arrays, recordings named by their file, and signals assembled from event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from orrery import schemas

# Motor load digit to shaft speed, excluded label, fault names and crack sizes (thousandths of an inch).
LOAD_RPM = {0: 1797, 1: 1772, 2: 1750, 3: 1730}
EXCLUDED_LABEL = 999
CRACK_SIZES = ["000", "007", "014", "021", "028"]
NORMAL_EVENTS = ["view", "click", "signup"]
# Fixed values of the second data set: operating conditions (speed, load torque in Nm, radial force in N), bearings by fault, labels, kHz.
CONDITIONS = {"N15_M07_F10": (1500, 0.7, 1000.0), "N09_M07_F10": (900, 0.7, 1000.0)}
BEARINGS = {
    "N": ["K001", "K002", "K003", "K004", "K005", "K006"],
    "IR": ["KI04", "KI14", "KI16", "KI17", "KI18", "KI21"],
    "OR": ["KA04", "KA15", "KA16", "KA22", "KA30"],
}
BEARING_LABELS = {"N": 0, "IR": 1, "OR": 2}
SAMPLING_KHZ = 64


def read_signals(spark: SparkSession, path: str, excluded_label: int | None = EXCLUDED_LABEL) -> DataFrame:
    """Signals stored one per row; rows of the excluded label go, as after loading the raw recordings."""
    df = spark.read.schema(schemas.SIGNALS).parquet(path)
    return df if excluded_label is None else df.filter(F.col("label").isNull() | (F.col("label") != excluded_label))


def parse_recording_name(name: Column) -> dict[str, Column]:
    """FAULT_SIZE_LOAD or FAULT_LOAD (normal) in the file name: fault type, crack size, shaft speed."""
    stem = F.regexp_extract(name, r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)
    parts = F.split(stem, "_")
    fault = F.upper(F.element_at(parts, 1))
    size = F.when(F.size(parts) >= 3, F.element_at(parts, 2)).otherwise(F.lit("000"))
    load = F.element_at(parts, -1).try_cast("int")
    speed = F.create_map(*[F.lit(x) for kv in LOAD_RPM.items() for x in kv])
    return {"fault_type": fault, "crack_size": size, "rpm": F.try_element_at(speed, load), "is_anomaly": (fault != "N").cast("int")}


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """Recordings kept as parquet files of one ``data`` array each, described by their file names. A file that can't be
    parsed is skipped (``ignoreCorruptFiles``); one whose name doesn't parse has null speed."""
    df = spark.read.option("ignoreCorruptFiles", "true").schema("data array<double>").parquet(path)
    return df.withColumns(parse_recording_name(F.col("_metadata.file_name")))


def parse_bearing_name(name: Column) -> dict[str, Column]:
    """CONDITION_BEARING_NUMBER in the file name: fault type, speed, load, force, label; nulls where a part is unknown."""
    stem = F.regexp_extract(name, r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)
    condition, bearing = F.regexp_extract(stem, r"^(.*)_[^_]+_\d+$", 1), F.regexp_extract(stem, r"_([^_]+)_\d+$", 1)
    fault = F.try_element_at(F.create_map(*[F.lit(x) for f, names in BEARINGS.items() for n in names for x in (n, f)]), bearing)
    of = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for c, v in CONDITIONS.items() for x in (c, v[i])]), condition)
    label = F.try_element_at(F.create_map(*[F.lit(x) for kv in BEARING_LABELS.items() for x in kv]), fault)
    return {"fault_type": fault, "rpm": of(0), "load_torque_nm": of(1), "radial_force_n": of(2), "sampling_rate": F.lit(SAMPLING_KHZ), "label": label, "is_anomaly": (fault != "N").cast("int")}


def pick_channel(channels: Column, part: str | None = None, name: str | None = None) -> Column:
    """The data of one of several named channels (array of ``name, data``): the last whose name holds ``part``, or the first called ``name``; null if none."""
    if part is not None:
        return F.try_element_at(F.filter(channels, lambda c: F.contains(c["name"], F.lit(part))), F.lit(-1))["data"]
    return F.try_element_at(F.filter(channels, lambda c: c["name"] == name), F.lit(1))["data"]


RAW = "channels array<struct<name:string,data:array<double>>>"


def read_raw_recordings(spark: SparkSession, path: str, bearings: bool = False) -> tuple[DataFrame, DataFrame]:
    """Recordings kept as one row of named channels a file: the signals, and the names of files that were skipped for lack of a channel.

    The first data set takes the last channel with "DE" in its name and reports what it skips, the second (``bearings``) the first
    channel "vibration_1". Rows of the excluded label, or with a name that says nothing, are left to ``read_signals``' rule.
    """
    raw = spark.read.option("ignoreCorruptFiles", "true").schema(RAW).parquet(path).withColumn("file", F.col("_metadata.file_name"))
    data = pick_channel(F.col("channels"), name="vibration_1") if bearings else pick_channel(F.col("channels"), part="DE")
    rows = raw.withColumn("data", data).withColumns(parse_bearing_name(F.col("file")) if bearings else parse_recording_name(F.col("file")))
    return rows.filter("data is not null").drop("channels"), rows.filter("data is null").select("file")


def signals_from_events(events: DataFrame, domains: int = 4) -> DataFrame:
    """One signal per (user_id mod domains, event_type): its values in (ts, event_id) order. Errors and purchases are faults."""
    key = [(F.col("user_id") % domains).cast("int").alias("domain"), F.col("event_type").alias("channel")]
    rows = events.filter(F.col("user_id").isNotNull() & F.col("event_type").isNotNull())
    cell = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))
    sig = rows.groupBy(*key).agg(F.transform(cell, lambda s: s["value"]).alias("data"))
    normal = F.col("channel").isin(NORMAL_EVENTS)
    # (domain, channel) pairs are a fixed handful, so the numbering window holds that many rows.
    return sig.select(
        F.row_number().over(Window.orderBy("domain", "channel")).cast("long").alias("signal_id"),
        "domain",
        F.when(normal, "N").otherwise(F.col("channel")).alias("fault_type"),
        (~normal).cast("int").alias("is_anomaly"),
        "data",
    )
