"""A row for every run of a job, on success and on failure, with counts that are taken while it writes."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

AUDIT = "run_id string, job string, started_at timestamp, finished_at timestamp, success boolean, counts map<string,bigint>, error_class string, error_message string, duration_ms bigint, metadata map<string,string>"


def audited(df: DataFrame, job: str, write: Callable[[DataFrame], None], audit_path: str, counts: dict[str, Column] | None = None, metadata: dict[str, str] | None = None, fail: bool = True) -> bool:
    """Writes df by `write` and appends a row to the audit table at audit_path (AUDIT); whether it succeeded.

    counts: aggregates by name, besides `rows`; they are observed in the pass that writes, so nothing is
    read again. A run that fails leaves a row with its error and no counts, and the error goes on unless
    fail is False. `write` may read the observed frame once only.
    """
    started, clock = datetime.now(timezone.utc), time.monotonic()
    seen, error = Observation(f"{job}-{uuid.uuid4().hex}"), None
    try:
        write(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.cast("long").alias(k) for k, c in (counts or {}).items())))
    except Exception as e:  # noqa: BLE001 - any failure of the job is recorded, and goes on below
        error = e
    found = {k: int(v) for k, v in seen.get.items() if v is not None} if error is None else None
    message = str(error).splitlines()[0][:1000] if error is not None and str(error) else None
    row = (uuid.uuid4().hex, job, started, datetime.now(timezone.utc), error is None, found, type(error).__name__ if error is not None else None, message, int((time.monotonic() - clock) * 1000), metadata or {})
    df.sparkSession.createDataFrame([row], AUDIT).coalesce(1).write.mode("append").parquet(audit_path)
    if error is not None and fail:
        raise error
    return error is None


def audit_rows(spark: SparkSession, audit_path: str) -> DataFrame:
    return spark.read.schema(AUDIT).parquet(audit_path)
