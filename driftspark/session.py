"""A Spark session with the settings that the library counts on."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once for each application, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="ship-")) / f"{top.name}_code.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent).as_posix())
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def session(app: str = "driftspark", cores: int | str = "*", shuffle: int = 200, **conf: str) -> SparkSession:
    """UTC times, adaptive plans with skew joins, Arrow batches; conf goes over these."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle),
    }
    if "spark.master" not in conf:
        builder = builder.master(f"local[{cores}]")
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
