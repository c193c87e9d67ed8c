"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Static settings, only for a session this package builds. Call-site capture costs a round trip for every
# column expression, and the HTML and URL expressions have thousands.
BUILD_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}

# Runtime settings: they can be applied to a session somebody else built.
RUNTIME_CONF = {
    # Crawl times are stored in UTC, and hour or second keys must not move with the host.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "crawlframe", master: str | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    """Create or reuse a session; ``master`` is left to spark-submit unless given."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**BUILD_CONF, **RUNTIME_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())
