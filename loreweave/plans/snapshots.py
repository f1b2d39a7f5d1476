"""Query over the six file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.operators.snapshots import snapshot_changes
from loreweave.storage import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files added, removed or changed in listings 2 to 6 against the one before."""
    path = F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), r"^\./", "")
    files = table(spark, sf_dir, "file_snapshots").withColumn("path", path)
    state = F.struct(F.lower("hash").alias("hash"), F.col("size"))
    found = snapshot_changes(files, "snapshot_no", ["project_id", "path"], state, F.col("received_at"))
    return found.withColumn("snapshot_no", F.col("snapshot_no").cast("int"))


P4_FOUND = r"""
WITH r AS (
  SELECT snapshot_no AS n, project_id AS p, regexp_replace(replace(path, '\', '/'), '^\./', '') AS f, lower(hash) AS h, size AS s, received_at AS t
  FROM file_snapshots),
l AS (
  SELECT n, p, f, h, s FROM (
    SELECT *, row_number() OVER (PARTITION BY n, p, f ORDER BY t DESC, h DESC NULLS LAST, s DESC NULLS LAST) AS r FROM r) WHERE r = 1)
SELECT coalesce(a.n, b.n + 1)::INT AS snapshot_no, coalesce(a.p, b.p) AS project_id, coalesce(a.f, b.f) AS path,
  CASE WHEN b.n IS NULL THEN 'added' WHEN a.n IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM l a FULL JOIN l b ON a.n = b.n + 1 AND a.p = b.p AND a.f = b.f
WHERE coalesce(a.n, b.n + 1) BETWEEN 2 AND 6
  AND (a.n IS NULL OR b.n IS NULL OR a.h IS DISTINCT FROM b.h OR a.s IS DISTINCT FROM b.s)
"""

QUERIES = {"p4_found": p4_found}
SQL = {"p4_found": P4_FOUND}
