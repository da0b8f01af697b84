"""Sends the package to the executors, so that Python work finds it wherever it runs."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each application.

    Spark's own file server hands the archive to executors, to later ones too.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    here = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="folioflow-")
    archive = os.path.join(folder, "folioflow.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*")):
            if p.suffix in (".py", ".npz"):
                z.write(p, p.relative_to(here.parent).as_posix())
    sc.addPyFile(archive)
    _SENT.add(sc.applicationId)
