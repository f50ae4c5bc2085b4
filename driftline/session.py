"""Sessions and what Python workers need."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: dict[str, str] = {}


def session(name: str = "driftline", **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; the master is the launcher's business."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return SparkSession.builder.appName(name).config(map=base | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that functions find their modules there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="driftline-code-")) / "driftline_code.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(home.rglob("*.py")):
            out.write(source, source.relative_to(home.parent))
    context.addPyFile(str(path))
    _shipped[context.applicationId] = str(path)
