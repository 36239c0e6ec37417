"""Session settings that the engine's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Pinned because they change answers, not only speed.
PINNED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def build_session(app: str = "sparrowmill", **conf: str) -> SparkSession:
    """A session with the pinned settings; everything else stays with the cluster."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**PINNED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
