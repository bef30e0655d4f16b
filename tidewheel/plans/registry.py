"""Where queries register themselves, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Common table expressions: the driver's tables as sensor data, as in sources/driver.py.
CTE = """
sensor AS (
  SELECT event_id, ts AS timestamp_utc, CAST(floor(epoch(ts)) AS BIGINT) AS ts_unix, epoch_us(ts) AS us,
         'Sys.' || CASE WHEN event_type IN ('click', 'view') THEN 'Ui' ELSE 'Biz' END || '.' || event_type AS tagname,
         value, user_id AS lift_id FROM events),
lifts AS (
  SELECT event_id AS movementid, CAST(1 + user_id % 5 AS INTEGER) AS movementtype, ts AS started,
         CAST(floor(value * 60) AS DOUBLE) AS movementduration, user_id FROM events WHERE event_type = 'signup'),
intervals AS (
  SELECT movementid AS iv_id, movementtype, started AS iv_start, started + to_seconds(CAST(movementduration AS BIGINT)) AS iv_end FROM lifts),
alarms AS (
  SELECT event_id, ts AS timestamp_utc, epoch_us(ts) AS us, CAST(event_id % 20 AS INTEGER) AS id, 'alarm ' || (event_id % 20) AS text
  FROM events WHERE event_type = 'error'),
lift_types AS (
  SELECT lift_id, CASE WHEN lift_id % 11 <> 0 THEN CAST(1 + lift_id % 5 AS INTEGER) END AS movementtype FROM (SELECT DISTINCT user_id AS lift_id FROM events)),
bucketed AS (
  SELECT s.*, CASE WHEN tagname IN ('Sys.Ui.click', 'Sys.Ui.view') THEN 'ui' ELSE 'biz' END AS tag_group,
         CASE WHEN tagname IN ('Sys.Ui.click', 'Sys.Ui.view') THEN 43200 ELSE 86400 END AS bucket_size_s,
         CAST(floor(ts_unix / CASE WHEN tagname IN ('Sys.Ui.click', 'Sys.Ui.view') THEN 43200 ELSE 86400 END) AS BIGINT)
           * CASE WHEN tagname IN ('Sys.Ui.click', 'Sys.Ui.view') THEN 43200 ELSE 86400 END AS bucket_start_unix
  FROM sensor s),
biz AS (
  SELECT lift_id, bucket_start_unix, avg(value) FILTER (tagname = 'Sys.Biz.error') AS error,
         avg(value) FILTER (tagname = 'Sys.Biz.purchase') AS purchase, avg(value) FILTER (tagname = 'Sys.Biz.signup') AS signup
  FROM bucketed WHERE tag_group = 'biz' GROUP BY ALL),
ui AS (
  SELECT lift_id, bucket_start_unix, avg(value) FILTER (tagname = 'Sys.Ui.click') AS click, avg(value) FILTER (tagname = 'Sys.Ui.view') AS view
  FROM bucketed WHERE tag_group = 'ui' GROUP BY ALL)
"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query. The SQL may use the tables of CTE."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is there already")
        QUERIES[name] = f
        if sql is not None:
            body = sql.strip()
            SQL[name] = f"WITH {CTE.strip()}{', ' + body[5:] if body.upper().startswith('WITH ') else chr(10) + body}"
        return f

    return add
