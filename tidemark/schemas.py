"""Schemas of the tables that the operators exchange. Inputs are read with these, never inferred."""

LISTING = "pipeline_id string, key string, size bigint, version string, mod_time timestamp_ntz, sequencer string"
CHANGES = "pipeline_id string, kind string, key string, version string, size bigint, sequencer string, event_time timestamp_ntz, detected_at timestamp_ntz, origin string"
RECORD = (
    "pipeline_id string, key string, source_version string, source_size bigint, source_mtime timestamp_ntz, source_sequencer string, "
    "synced_version string, synced_mtime timestamp_ntz, synced_sequencer string, sha256 string, dest_version string, status string, attempts int, "
    "last_error string, upload_id string, upload_version string, claimed_until timestamp_ntz, event_time timestamp_ntz, synced_at timestamp_ntz"
)
MANIFEST = "key string, size bigint, sha256 string, written_at string"
EVENT = (
    "array<struct<id:string,subject:string,eventType:string,eventTime:string,specversion:string,type:string,time:string,"
    "data:struct<url:string,eTag:string,contentLength:bigint,sequencer:string,validationCode:string>>>"
)
# The columns of a soak sample file.
SOAK = (
    "ts pid rss_kb go_goroutines go_heap_inuse_bytes queue_depth oldest_pending_s bytes_copied bytes_uploaded files_synced files_already_synced files_stale files_retry "
    "files_failed events_event events_reconcile reconcile_runs file_record_rows file_record_pending file_record_bytes river_job_rows river_completed river_available "
    "river_running river_retryable river_scheduled river_discarded river_cancelled river_job_bytes db_bytes"
)
SOAK_SCHEMA = ", ".join(f"{c} {'timestamp' if c == 'ts' else 'bigint'}" for c in SOAK.split())
STATUSES = ("pending", "copying", "synced", "failed", "deleted")
