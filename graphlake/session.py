"""Session defaults. Cluster settings always win over what is set here."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "graphlake", cores: int | None = None) -> SparkSession:
    """The running session, or a local one with one shuffle partition a core."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    n = cores or os.cpu_count() or 1
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("GRAPHLAKE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
