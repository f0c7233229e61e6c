"""Making the library known to the executors' Python workers."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark context, so that its functions load there."""
    context = spark.sparkContext
    if getattr(context, "_quire_shipped", False):
        return
    here = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(prefix="quire-", suffix=".zip")
    os.close(handle)
    atexit.register(Path(name).unlink, missing_ok=True)
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    context.addPyFile(name)
    context._quire_shipped = True
