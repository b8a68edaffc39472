"""Makes this package importable in Python workers of any cluster."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package to every executor, once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_colloquy_shipped", False):
        return
    here = Path(__file__).resolve().parent
    held = tempfile.mkdtemp(prefix="colloquy-")  # the driver serves the file from here while it lives
    atexit.register(shutil.rmtree, held, True)
    target = Path(held) / "colloquy_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(str(target))
    sc._colloquy_shipped = True
