"""Makes the package importable in the Python workers of any cluster."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent).as_posix())
    folder = Path(tempfile.mkdtemp(prefix="weftline-"))  # read by the driver's own file server only
    (folder / "weftline_src.zip").write_bytes(data.getvalue())
    context.addPyFile(str(folder / "weftline_src.zip"))
    _shipped.add(context.applicationId)
