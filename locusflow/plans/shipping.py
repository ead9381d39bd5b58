"""Makes the package importable on executors that were started without it."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the session's Python files, once per context.

    Skipped where PYTHONPATH already names the repository for every worker.
    """
    sc = spark.sparkContext
    if getattr(sc, "_package_shipped", False) or str(_ROOT) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted((_ROOT / "locusflow").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    path = Path(tempfile.mkdtemp()) / "locusflow_package.zip"
    path.write_bytes(data.getvalue())
    sc.addPyFile(str(path))
    sc._package_shipped = True
