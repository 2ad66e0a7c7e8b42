"""Session settings that every part of the engine assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, memory: str = "8g", partitions: int = 8, **extra: str) -> SparkSession:
    """A single-JVM session for tests and benchmarks; clusters bring their own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tessitura")
    for key, value in (DEFAULTS | {"spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(partitions)} | extra).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give executors this package as a zip, unless their Python path has it anyway; once per application."""
    import os
    import tempfile
    import zipfile
    from pathlib import Path

    home = Path(__file__).resolve().parent.parent
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if home in {Path(p).resolve() for p in paths if p} or getattr(spark.sparkContext, "_tessitura_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(), "tessitura.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in (home / "tessitura").rglob("*.py"):
            z.write(f, f.relative_to(home))
    spark.sparkContext.addPyFile(archive)
    spark.sparkContext._tessitura_shipped = True
