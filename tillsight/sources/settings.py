"""A site's settings from one small YAML or JSON text, checked as a whole before any job starts."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import PurePosixPath
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import DataFrame, SparkSession

DEVICES = "device_id string, name string, type string, host string, port int, department string, enabled boolean"
UNSAFE_ROOTS = ("/", "/etc", "/usr", "/var", "/home")
#: Bounds of the settings that jobs read: least, most, default.
NUMBERS = {
    "ingestion.max_batch_jobs": (1, 10_000, 100), "correlation.time_window_seconds": (1, 604_800, 7200), "correlation.minimum_score": (0, 100, 60),
    "rules.minimum_percent": (0, 100, 20), "rules.close_minutes": (1, 10_080, 120), "rules.extreme_percent": (0, 100, 70),
}


@dataclass(frozen=True)
class Settings:
    timezone: str
    roots: dict[str, str]
    devices: tuple[dict, ...]
    numbers: dict[str, int] = field(default_factory=dict)

    def device_table(self, spark: SparkSession) -> DataFrame:
        """The configured devices; a few rows."""
        return spark.createDataFrame([tuple(d.get(c.split()[0]) for c in DEVICES.split(", ")) for d in self.devices], DEVICES)


def parsed(text: str) -> dict:
    """The text as a mapping: JSON, or YAML where a YAML reader is installed."""
    try:
        found = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("the settings are no JSON, and no YAML reader is installed") from e
        try:
            found = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ValueError("the settings can't be read") from e
    if not isinstance(found, dict):
        raise ValueError("the settings must be a mapping")
    return found


def checked(text: str, most: int = 1_048_576) -> Settings:
    """The settings, or ValueError naming the first thing that is wrong."""
    if len(text.encode()) > most:
        raise ValueError("the settings are too long")
    raw = parsed(text)
    if unknown := set(raw) - {"version", "timezone", "roots", "devices", "ingestion", "correlation", "rules"}:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    zone = raw.get("timezone", "Europe/Rome")
    try:
        ZoneInfo(zone)
    except (ZoneInfoNotFoundError, ValueError) as e:
        raise ValueError(f"unknown timezone {zone}") from e
    roots = raw.get("roots") or {}
    for name, root in roots.items():
        if not str(root).startswith("/") or "\0" in root or ".." in PurePosixPath(root).parts or str(PurePosixPath(root)) in UNSAFE_ROOTS:
            raise ValueError(f"unsafe root {name}")
    if len(set(roots.values())) != len(roots):
        raise ValueError("roots must differ")
    numbers = {}
    for key, (least, most_, default) in NUMBERS.items():
        part, name = key.split(".")
        value = (raw.get(part) or {}).get(name, default)
        if isinstance(value, bool) or not isinstance(value, int) or not least <= value <= most_:
            raise ValueError(f"{key} must be between {least} and {most_}")
        numbers[key] = value
    devices = []
    for d in raw.get("devices") or []:
        if d.get("type") not in ("pos", "rch") or not re.fullmatch(r"[A-Za-z0-9_.-]{1,64}", str(d.get("device_id", ""))) or not 1 <= int(d.get("port", 0)) <= 65_535:
            raise ValueError(f"device {d.get('device_id')} is malformed")
        devices.append({"name": None, "department": None, "enabled": True} | d)
    if not devices:
        raise ValueError("at least one device is required")
    live = [(d["host"], d["port"]) for d in devices if d["enabled"]]
    if len({d["device_id"] for d in devices}) != len(devices) or len(set(live)) != len(live):
        raise ValueError("device ids and enabled endpoints must be unique")
    return Settings(zone, roots, tuple(devices), numbers)
