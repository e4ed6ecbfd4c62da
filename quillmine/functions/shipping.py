"""Sending the package to the Python workers of a session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable where Python workers run, once per application,
    wherever the driver was started from."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="quillmine-package-")  # the driver sends it from there
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, "quillmine.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(f for f in package.rglob("*") if f.suffix in (".py", ".txt")):
            z.write(file, file.relative_to(package.parent).as_posix())
    context.addPyFile(target)
    _sent.add(context.applicationId)
