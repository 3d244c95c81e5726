"""Sends this package to Python workers that can't import it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession, root: str) -> None:
    """Add the package as a zip to the application, once; local workers may find it on the driver's path instead."""
    sc = spark.sparkContext
    app = sc.applicationId
    on_path = sc.master.startswith("local") and root in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if app in _shipped or on_path:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="lorewell-zip-"), "lorewell_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "lorewell")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _shipped.add(app)
