"""Makes the package importable in Spark's Python workers, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent
_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's sources to the executors once in an application, as one zip."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        path = Path(tempfile.mkdtemp(prefix="netloom-ship-")) / "netloom_src.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(HERE.rglob("*.py")):
                z.write(f, f"netloom/{f.relative_to(HERE)}")
        spark.sparkContext.addPyFile(str(path))
        _shipped[app] = str(path)
    return spark
