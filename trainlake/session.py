"""Session set-up and the shared folder that jobs may use for intermediate tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every operator relies on. AQE splits hot join keys and hot write
# partitions; the forced flag keeps the split also where it costs one more shuffle.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}

# Hadoop s3a settings and the environment variables they are read from.
OBJECT_STORE_ENV = {
    "spark.hadoop.fs.s3a.endpoint": "S3_ENDPOINT_URL",
    "spark.hadoop.fs.s3a.access.key": "MINIO_ACCESS_KEY",
    "spark.hadoop.fs.s3a.secret.key": "MINIO_SECRET_KEY",
}


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Set the runtime defaults on an existing session."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def get_session(
    app_name: str = "trainlake",
    env: Mapping[str, str] | None = None,
    conf: Mapping[str, str] | None = None,
) -> SparkSession:
    """Session with the defaults; object-store settings only where the environment has them.

    Without an endpoint the s3a defaults and the cluster's own credential chain apply.
    """
    env = os.environ if env is None else env
    builder = SparkSession.builder.appName(app_name)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, name in OBJECT_STORE_ENV.items():
        if env.get(name):
            builder = builder.config(key, env[name])
    endpoint = env.get("S3_ENDPOINT_URL")
    if endpoint:
        builder = builder.config("spark.hadoop.fs.s3a.path.style.access", "true").config(
            "spark.hadoop.fs.s3a.connection.ssl.enabled",
            str(endpoint.startswith("https")).lower(),
        )
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the checkpoint folder that the session names, else one
    in its warehouse, which all executors share as well."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, not yet existing path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df``; partitions and their row order stay fixed afterwards."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
