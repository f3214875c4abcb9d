"""Getting the package to Python workers that don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to this application's workers, once, unless PYTHONPATH, which they inherit, has it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    if any(p and Path(p).resolve() == ROOT for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="sparkveil-source-"), "sparkveil-source.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((ROOT / "sparkveil").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(path)
