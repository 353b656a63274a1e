"""Sends the package to the cluster's Python workers, whatever their search path is."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds this package to the session's application once; the driver serves it to every executor."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    _SENT.add(sc.applicationId)
    package = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="tillsight-code-"), "tillsight.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(target)
