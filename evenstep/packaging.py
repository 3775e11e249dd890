"""Ships the package to the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: The folder of each application's zip, removed when the driver's Python ends.
_SHIPPED: dict[str, tempfile.TemporaryDirectory] = {}


#: Rows of an Arrow batch between the JVM and Python workers; Spark's own default holds long texts by the ten thousand.
ARROW_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def ship(spark: SparkSession) -> None:
    """Adds the package to the files that workers import from, once per application, and makes Arrow
    batches smaller unless the session says how large they are to be."""
    context = spark.sparkContext
    if not spark._jsparkSession.sessionState().conf().contains(ARROW_ROWS[0]):
        spark.conf.set(*ARROW_ROWS)
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.TemporaryDirectory(prefix="evenstep-", ignore_cleanup_errors=True)
    target = Path(folder.name) / "evenstep.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    context.addPyFile(str(target))
    _SHIPPED[context.applicationId] = folder
