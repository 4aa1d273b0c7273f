"""barline: market time-series jobs as plain Spark DataFrame programs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

_shipped: set[str] = set()


def ship(spark) -> None:
    """Sends this package to the executors, once per application.

    Functions that run in Python workers import it there, whatever the
    cluster's machines have installed and wherever the driver was started.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root, folder = Path(__file__).resolve().parent, Path(tempfile.mkdtemp(prefix="barline-"))
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(folder / "barline.zip", "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, Path(root.name) / file.relative_to(root))
    spark.sparkContext.addPyFile(str(folder / "barline.zip"))
