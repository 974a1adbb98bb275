"""The device registry: JSON lines, one device each, merged by last writer wins."""

from __future__ import annotations

import json
import os
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry import schemas
from quarry.functions.scalars import format_utc, rfc3339, truncate
from quarry.operators.changes import newest

HOST_FACTS = ("hostname", "app_id", "app_version", "platform", "arch")


class RegistryError(ValueError):
    """A line of the registry is not a device."""

    def __init__(self, line: int):
        super().__init__(f"line {line} of the device registry is not a device record")
        self.line = line


class DeviceNotFoundError(KeyError):
    """No device has this id or number."""


def parse(lines: DataFrame) -> DataFrame:
    """(line, value) rows to devices; the first bad line raises :class:`RegistryError`."""
    kinds = ", ".join(f"{f.split()[0]} string" for f in schemas.DEVICES.split(", "))
    rows = lines.filter(F.trim("value") != "").withColumn("d", F.from_json("value", kinds, {"mode": "PERMISSIVE"}))
    bad = rows.filter(F.col("d.id").isNull() | F.try_to_timestamp("d.updated_at").isNull()).agg(F.min("line")).first()[0]
    if bad is not None:
        raise RegistryError(bad)
    times = [F.try_to_timestamp(f"d.{c}").alias(c) for c in ("registered_at", "updated_at")]
    return rows.select("d.id", "d.name", *[f"d.{c}" for c in HOST_FACTS], *times)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The devices of a registry file; a missing one has none. Registries have some tens of lines."""
    if not os.path.exists(path):
        return spark.createDataFrame([], schemas.DEVICES)
    with open(path, encoding="utf-8") as file:
        rows = [(i, x.rstrip("\r\n")) for i, x in enumerate(file, 1)]
    return parse(spark.createDataFrame(rows, "line int, value string"))


def to_lines(devices: DataFrame) -> DataFrame:
    """One JSON line per device, by id."""
    shown = devices.select("id", F.to_json(F.struct(*[rfc3339(F.col(c)).alias(c) if c.endswith("_at") else F.col(c) for c in devices.columns])).alias("value"))
    return shown.orderBy("id").select("value")


def save(devices: DataFrame, path: str) -> None:
    """Rewrite the registry file, sorted by id, each line ended by LF."""
    rows = [r["value"] for r in to_lines(devices).collect()]
    with open(f"{path}.new", "w", encoding="utf-8", newline="\n") as file:
        file.writelines(f"{r}\n" for r in rows)
    os.replace(f"{path}.new", path)


def merge_contexts(devices: DataFrame, contexts: DataFrame, now: datetime) -> DataFrame:
    """All devices after hosts report themselves, with ``changed`` for each.

    A new id is added (registered at its own time, or now). Host facts are always
    taken over; name and time only if the report is strictly newer (no time is
    oldest); the time of registration never changes.
    """
    r, c = devices.alias("r"), contexts.alias("c")
    both = r.join(c, F.col("r.id") == F.col("c.id"), "full")
    new, silent = F.col("r.id").isNull(), F.col("c.id").isNull()
    newer = F.coalesce(F.col("c.updated_at") > F.col("r.updated_at"), F.lit(False))
    time = F.coalesce("c.updated_at", F.lit(now).cast("timestamp"))

    def pick(name: str, old, fresh):
        return F.when(new, fresh).when(silent, old).otherwise(F.when(newer, fresh).otherwise(old)).alias(name)

    facts = [F.when(silent, F.col(f"r.{x}")).otherwise(F.col(f"c.{x}")).alias(x) for x in HOST_FACTS]
    moved = F.lit(False)
    for x in HOST_FACTS:
        moved = moved | ~F.col(f"r.{x}").eqNullSafe(F.col(f"c.{x}"))
    changed = F.when(new, True).when(silent, False).otherwise(newer | moved)
    return both.select(
        F.coalesce("r.id", "c.id").alias("id"),
        pick("name", F.col("r.name"), F.col("c.name")),
        *facts,
        F.coalesce("r.registered_at", time).alias("registered_at"),
        pick("updated_at", F.col("r.updated_at"), time),
        changed.alias("changed"),
    )


def set_name(devices: DataFrame, device_id: str, name: str, now: datetime) -> DataFrame:
    if not devices.filter(F.col("id") == device_id).limit(1).count():
        raise DeviceNotFoundError(device_id)
    own = F.col("id") == device_id
    return devices.withColumn("name", F.when(own, F.lit(name)).otherwise(F.col("name"))).withColumn("updated_at", F.when(own, F.lit(now).cast("timestamp")).otherwise(F.col("updated_at")))


def update_if_newer(devices: DataFrame, records: DataFrame) -> DataFrame:
    """Whole records replace strictly older ones; unknown ids are added."""
    return newest(devices, records, "id", "updated_at")


def numbered(devices: DataFrame) -> DataFrame:
    """With ``number``: the 1-based place in the order of ids, that is of registration."""
    return devices.withColumn("number", F.row_number().over(W.orderBy("id")))


def find(devices: DataFrame, target: str) -> DataFrame:
    """The device with this id or number."""
    rows = numbered(devices)
    found = rows.filter(F.col("number") == int(target)) if target.isdigit() else rows.filter(F.col("id") == target)
    if not found.limit(1).count():
        raise DeviceNotFoundError(target)
    return found


def shown(devices: DataFrame) -> DataFrame:
    """As a table for people."""
    return numbered(devices).select("number", truncate(F.col("name"), 20).alias("name"), truncate(F.col("hostname"), 20).alias("hostname"), "platform", "app_version", format_utc(F.col("updated_at")).alias("updated_at"))


def merge_file(spark: SparkSession, path: str, context: dict, now: datetime) -> bool:
    """Report one host to a registry file; whether that changed anything."""
    row = {f.split()[0]: context.get(f.split()[0]) for f in schemas.CONTEXTS.split(", ")}
    merged = merge_contexts(load(spark, path), spark.createDataFrame([tuple(row.values())], schemas.CONTEXTS), now)
    changed = merged.filter("changed").limit(1).count() > 0
    if changed:
        save(merged.drop("changed"), path)
    return changed


def record(line: str) -> dict:
    """One line of a registry as a dict."""
    return json.loads(line)


def newer_names(records: DataFrame, contexts: DataFrame) -> DataFrame:
    """id and name of the known devices that report: the newer name wins, and a null time is the oldest."""
    r, c = records.alias("r"), contexts.alias("c")
    newer = F.coalesce(F.col("c.updated_at") > F.col("r.updated_at"), F.lit(False))
    return r.join(c, F.col("r.id") == F.col("c.id")).select("r.id", F.when(newer, F.col("c.name")).otherwise(F.col("r.name")).alias("name"))
