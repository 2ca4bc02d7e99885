"""Ships this package to the executors, so that Python workers need no installation of it."""

from __future__ import annotations

import hashlib
import tempfile
import zipfile
from pathlib import Path
from weakref import WeakSet

from pyspark import SparkContext
from pyspark.sql import SparkSession

_done: WeakSet[SparkContext] = WeakSet()


def ship(spark: SparkSession) -> None:
    """Adds the package's modules to the context's Python files, once a context."""
    context = spark.sparkContext
    if context in _done:
        return
    root = Path(__file__).parent
    files = sorted(p for p in root.rglob("*.py"))
    mark = hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:12]
    archive = Path(tempfile.mkdtemp(prefix="lakesearch_")) / f"lakesearch_{mark}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for p in files:
            out.write(p, p.relative_to(root.parent))
    context.addPyFile(str(archive))
    _done.add(context)
