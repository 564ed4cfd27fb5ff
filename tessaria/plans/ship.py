"""Sends this package to the executors, so that Python workers find it wherever they run."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_sent: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Once per application: the package's sources as a zip file that Spark serves to every executor."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    files = sorted(p for p in ROOT.rglob("*.py"))
    name = f"{ROOT.name}-{hashlib.sha1(b''.join(p.read_bytes() for p in files)).hexdigest()[:12]}.zip"
    path = os.path.join(tempfile.mkdtemp(prefix="tessaria-package-"), name)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in files:
            z.write(p, str(Path(ROOT.name) / p.relative_to(ROOT)))
    sc.addPyFile(path)
    _sent[sc.applicationId] = name
