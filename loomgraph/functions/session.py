"""Getting the library to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the library's sources to the workers, once an application, unless their path has them already."""
    app = spark.sparkContext.applicationId
    at_hand = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if app in _shipped or str(_ROOT) in {os.path.realpath(p) for p in at_hand if p}:
        return
    path = Path(tempfile.mkdtemp(prefix="loomgraph-")) / "loomgraph-src.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((_ROOT / "loomgraph").rglob("*.py")):
            z.write(f, f.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
