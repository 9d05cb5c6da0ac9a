"""Inputs that the queries derive from the given tables: one SQL text each, for Spark and, translated, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The clock of every query that needs one.
NOW = "TIMESTAMP_NTZ '2024-02-01 00:00:00'"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()

SQL = {
    "listing": """
        SELECT concat('docs-', lang) AS pipeline_id,
               concat(source, '/', CASE WHEN doc_id % 9 = 0 THEN 'tmp/' ELSE '' END, 'doc-', doc_id, '.txt') AS key,
               n_chars AS size, md5(coalesce(text, '')) AS version,
               TIMESTAMP_NTZ '2024-01-01 00:00:00' + doc_id * INTERVAL '1' MINUTE AS mod_time, doc_id AS arrival
        FROM documents""",
    "record": """
        SELECT concat('docs-', lang) AS pipeline_id,
               concat(source, '/', CASE WHEN doc_id % 9 = 0 THEN 'tmp/' ELSE '' END, 'doc-', doc_id, '.txt') AS key,
               CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 7 = 0 THEN md5(concat(text, 'old')) ELSE md5(coalesce(text, '')) END AS synced_version,
               md5(coalesce(text, '')) AS source_version, n_chars AS source_size,
               CASE WHEN doc_id % 11 = 0 THEN 'deleted' WHEN doc_id % 13 = 0 THEN 'copying'
                    WHEN doc_id % 17 = 0 THEN 'pending' WHEN doc_id % 19 = 0 THEN 'failed' ELSE 'synced' END AS status,
               CASE WHEN doc_id % 13 = 0 THEN TIMESTAMP_NTZ '2024-02-01 00:00:00' + (doc_id % 3 - 1) * INTERVAL '1' MINUTE END AS claimed_until,
               TIMESTAMP_NTZ '2024-01-01 00:00:00' + doc_id * INTERVAL '1' MINUTE AS event_time,
               TIMESTAMP_NTZ '2024-01-01 00:00:30' + doc_id * INTERVAL '1' MINUTE AS synced_at,
               CASE WHEN doc_id % 19 = 0 THEN 'permission denied' WHEN doc_id % 17 = 0 THEN 'throttled' ELSE '' END AS last_error,
               TIMESTAMP_NTZ '2024-01-01 00:01:00' + doc_id * INTERVAL '1' MINUTE AS updated_at, concat('d', doc_id % 5) AS dest_version
        FROM documents WHERE doc_id % 10 <> 3
        UNION ALL
        SELECT concat('docs-', lang), concat('gone/doc-', doc_id, '.txt'), md5(coalesce(text, '')), md5(coalesce(text, '')), n_chars, 'synced', NULL,
               TIMESTAMP_NTZ '2024-01-01 00:00:00' + doc_id * INTERVAL '1' MINUTE,
               TIMESTAMP_NTZ '2024-01-01 00:00:30' + doc_id * INTERVAL '1' MINUTE, '',
               TIMESTAMP_NTZ '2024-01-01 00:01:00' + doc_id * INTERVAL '1' MINUTE, 'd'
        FROM documents WHERE doc_id % 50 = 0""",
    "full_record": """
        SELECT pipeline_id, key, source_version, source_size, event_time AS source_mtime,
               CASE WHEN source_size % 3 = 0 THEN lower(hex(source_size)) ELSE '' END AS source_sequencer, synced_version,
               event_time AS synced_mtime, CASE WHEN source_size % 3 = 0 THEN lower(hex(source_size)) ELSE '' END AS synced_sequencer,
               sha2(source_version, 256) AS sha256, dest_version, status, CAST(source_size % 4 AS INT) AS attempts, last_error,
               '' AS upload_id, '' AS upload_version, claimed_until, event_time, synced_at
        FROM record""",
    "candidates": """
        SELECT pipeline_id, key, CASE WHEN arrival % 5 = 0 THEN md5(concat(version, 'new')) ELSE version END AS version, size,
               mod_time + (arrival % 3 - 1) * INTERVAL '1' MINUTE AS mtime,
               CASE WHEN arrival % 2 = 0 THEN lower(hex(size + arrival % 3 - 1)) ELSE '' END AS sequencer,
               mod_time + INTERVAL '1' MINUTE AS event_time, arrival * 2 + n AS arrival
        FROM listing CROSS JOIN (VALUES (0), (1)) AS twice(n) WHERE n = 0 OR arrival % 4 = 0""",
    "changes": """
        SELECT concat('users-', user_id % 3) AS pipeline_id,
               CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS kind,
               concat('u/', user_id, '/', event_id % 5, '.json') AS key,
               CASE WHEN event_type = 'error' THEN '' ELSE md5(concat(event_type, event_id)) END AS version,
               CASE WHEN event_id % 4 = 0 THEN '' ELSE lower(hex(event_id)) END AS sequencer,
               ts AS event_time, 'event' AS origin,
               event_id * 2 + CASE WHEN event_id % 13 = 0 THEN 51 ELSE 0 END AS arrival
        FROM events
        UNION ALL
        SELECT concat('users-', user_id % 3), CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END,
               concat('u/', user_id, '/', event_id % 5, '.json'),
               CASE WHEN event_type = 'error' THEN '' ELSE md5(concat(event_type, event_id)) END,
               CASE WHEN event_id % 4 = 0 THEN '' ELSE lower(hex(event_id)) END, ts, 'event', 1000000000 + event_id
        FROM events WHERE event_id % 29 = 0""",
    "ops": """
        SELECT pipeline_id, key, arrival * 10 + k AS arrival,
               CASE WHEN kind = 'delete' THEN CASE WHEN k = 0 THEN 'delete' ELSE 'none' END
                    WHEN k = 0 THEN 'observe' WHEN k = 1 THEN 'claim'
                    WHEN k = 2 THEN CASE WHEN arrival % 2 = 0 THEN 'set_upload' ELSE 'extend' END
                    WHEN arrival % 7 < 3 THEN 'complete' WHEN arrival % 7 < 5 THEN 'fail' ELSE 'none' END AS op,
               version, arrival % 1000 AS size, event_time AS mtime, sequencer, event_time,
               event_time + k * INTERVAL '40' SECOND AS at, arrival % 7 = 3 AS retryable, concat('d', arrival) AS detail
        FROM changes CROSS JOIN (VALUES (0), (1), (2), (3)) AS steps(k)""",
    "messages": """
        SELECT event_id AS message_id, event_id % 8 AS delivery_count,
               CASE WHEN event_id % 41 = 0 THEN '!!!not-base64!!!' WHEN event_id % 43 = 0 THEN concat('[', body, ',{"id":"x"}]')
                    WHEN event_id % 2 = 0 THEN translate(base64(CAST(body AS BINARY)), concat(chr(13), chr(10)), '') ELSE body END AS message
        FROM (SELECT event_id, concat(
                CASE WHEN event_id % 3 = 0 THEN '{"specversion":"1.0","type":"' ELSE '{"eventType":"' END,
                CASE event_type WHEN 'error' THEN 'Microsoft.Storage.BlobDeleted' WHEN 'view' THEN 'Microsoft.Storage.BlobTierChanged'
                     ELSE 'Microsoft.Storage.BlobCreated' END, '","id":"', event_id, '","',
                CASE WHEN event_id % 3 = 0 THEN 'time' ELSE 'eventTime' END, '":"',
                CASE WHEN event_id % 53 = 0 THEN 'yesterday' ELSE '2024-01-01T00:00:00Z' END,
                '","data":{"url":"https://acct.blob.core.windows.net/c', user_id % 3, '/data/u', user_id, '/a%20b+c.json","eTag":"', chr(92), '"0x',
                lower(hex(event_id)), chr(92), '"","contentLength":', event_id, ',"sequencer":"', lower(hex(event_id)), '"}}') AS body
              FROM events) q""",
    "manifest": """
        SELECT concat('orders/', l_orderkey, '.bin') AS key, CAST(l_quantity * 1000 AS BIGINT) AS size,
               sha2(concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey), 256) AS sha256, l_shipdate AS written_at,
               l_linenumber AS ord, l_orderkey
        FROM lineitem""",
    "destination": """
        SELECT key, CASE WHEN l_orderkey % 33 = 0 THEN size + 1 ELSE size END AS size,
               CASE WHEN l_orderkey % 47 = 0 THEN sha2(concat('bad', l_orderkey), 256) WHEN l_orderkey % 7 = 0 THEN upper(sha256) WHEN l_orderkey % 31 = 0 THEN '' ELSE sha256 END AS sha256,
               written_at + (l_orderkey % 90) * INTERVAL '1' SECOND AS mod_time
        FROM (SELECT m.*, row_number() OVER (PARTITION BY key ORDER BY written_at DESC, ord DESC, sha256 DESC, size DESC) AS rn FROM manifest m) q
        WHERE rn = 1 AND l_orderkey % 20 <> 0""",
    "accounts": """
        SELECT c_custkey AS account, c_nationkey AS area, concat(CASE WHEN c_custkey % 4 = 0 THEN 'ACME ' ELSE 'ACME' END, c_custkey) AS title FROM customer""",
    "specs": """
        SELECT replace(lower(title), ' ', '_') AS name, CAST(account % 4 + 1 AS BIGINT) AS revision, account % 6 <> 0 AS enabled,
               concat('{"source":{"prefix":"', lower(title), '","azure":{"container":"c', area, '"}},"part_size":"',
                      CASE WHEN account % 5 = 0 THEN '1MiB' ELSE '64MiB' END, '"}') AS spec, account
        FROM accounts""",
    "targets": """
        SELECT concat('p-', account) AS pipeline_id, concat('c', account % 3) AS container,
               CASE WHEN account = 3 THEN '' WHEN account < 6 THEN 'data/' ELSE concat('data/u', account, '/') END AS prefix, account
        FROM accounts""",
    "metrics_text": """
        SELECT event_id AS line_no, ts AS scraped_at,
               CASE WHEN event_id % 50 = 0 THEN '# HELP sync_files_total files' WHEN event_id % 51 = 0 THEN ''
                    WHEN event_id % 7 = 0 THEN concat('sync_lag_seconds_bucket{pipeline="p', user_id % 3, '",le="',
                         CASE event_id % 4 WHEN 0 THEN '+Inf' WHEN 1 THEN '1' WHEN 2 THEN '5' ELSE 'x' END, '"} ', event_id % 100)
                    WHEN event_id % 7 = 1 THEN concat('sync_lag_seconds_sum{pipeline="p', user_id % 3, '"} ', event_id % 100, '.5 1700000000')
                    WHEN event_id % 7 = 2 THEN concat('sync_lag_seconds_count{pipeline="p', user_id % 3, '"} ', event_id % 100)
                    WHEN event_id % 7 = 3 THEN concat('up ', CASE event_id % 3 WHEN 0 THEN '+Inf' ELSE '1e3' END)
                    WHEN event_id % 7 = 4 THEN concat('sync_files_total{outcome="', event_type, chr(92), 'n', chr(92), '"x",pipeline="p', user_id % 3, '"} ', event_id)
                    WHEN event_id % 7 = 5 THEN concat(CASE user_id % 4 WHEN 0 THEN 'sync_events_total{source="' WHEN 1 THEN 'sync_events_total{kind="k",source="' ELSE 'sync_retries_total{reason="' END,
                         event_type, '",pipeline="p', user_id % 3, '"} ', event_id % 50)
                    ELSE concat(CASE user_id % 6 WHEN 0 THEN 'sync_bytes_copied_total' WHEN 1 THEN 'sync_bytes_uploaded_total' WHEN 2 THEN 'sync_queue_depth' WHEN 3 THEN 'sync_oldest_pending_seconds'
                         WHEN 4 THEN 'sync_copy_duration_seconds_sum' ELSE 'sync_copy_duration_seconds_count' END, '{pipeline="p', user_id % 3, '"} ', event_id % 1000) END AS line
        FROM events""",
    "attempts": """
        SELECT event_id, concat('users-', user_id % 3) AS pipeline_id,
               CASE event_id % 6 WHEN 0 THEN 'SlowDown' WHEN 1 THEN 'AccessDenied' WHEN 2 THEN 'NoSuchKey'
                    WHEN 3 THEN 'NoSuchBucket' WHEN 4 THEN 'InvalidAccessKeyId' ELSE '' END AS code,
               CAST(CASE event_id % 4 WHEN 0 THEN 503 WHEN 1 THEN 403 WHEN 2 THEN 404 ELSE 500 END AS INT) AS status,
               CASE event_id % 5 WHEN 0 THEN 'retry' WHEN 1 THEN 'failed' WHEN 2 THEN 'stale' ELSE 'synced' END AS outcome,
               event_id % 4096 AS bytes, value AS lag_seconds, ts AS finished_at
        FROM events""",
    "jobs": """
        SELECT event_id AS job_id, concat('users-', user_id % 3) AS pipeline_id, concat('u/', user_id, '/', event_id % 5, '.json') AS key,
               CASE event_id % 7 WHEN 0 THEN 'available' WHEN 1 THEN 'running' WHEN 2 THEN 'retryable' WHEN 3 THEN 'scheduled'
                    WHEN 4 THEN 'discarded' WHEN 5 THEN 'cancelled' ELSE 'completed' END AS state
        FROM events""",
}
NEEDS = {
    "listing": ["documents"], "record": ["documents"], "full_record": ["record"], "candidates": ["listing"], "changes": ["events"], "ops": ["changes"], "messages": ["events"],
    "manifest": ["lineitem"], "destination": ["manifest"], "accounts": ["customer"], "specs": ["accounts"], "targets": ["accounts"],
        "metrics_text": ["events"], "attempts": ["events"], "jobs": ["events"],
}


class Inputs:
    """Tables and derived inputs of one data folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        elif name in SQL:
            for need in NEEDS[name]:
                getattr(self, need)
            df = self.spark.sql(SQL[name])
        else:
            raise AttributeError(name)
        df.createOrReplaceTempView(name)
        setattr(self, name, df)
        return df


def needed(names) -> list[str]:
    out: list[str] = []
    for name in names:
        for x in [*needed([n for n in NEEDS.get(name, []) if n in SQL]), name]:
            if x not in out:
                out.append(x)
    return out


def duck(text: str) -> str:
    for a, b in (("sha2(", "sha256("), (", 256)", ")"), ("TIMESTAMP_NTZ", "TIMESTAMP"), ("base64(CAST(body AS BINARY))", "base64(encode(body))")):
        text = text.replace(a, b)
    return text


def with_inputs(names: str, body: str) -> str:
    """body for DuckDB, with the named inputs as common table expressions."""
    ctes = ", ".join(f"{n} AS MATERIALIZED ({duck(SQL[n])})" for n in needed(names.split()))
    body = body.strip()
    if body.startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
