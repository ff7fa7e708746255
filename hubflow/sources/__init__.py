"""Sources and sinks: catalog/parquet scans, the full-refresh sink, the shared
folder for materialised tables, and the test-table mapping."""

from hubflow.sources.sinks import full_refresh, materialize, read_refreshed, recover, shared_dir  # noqa: F401
from hubflow.sources.tables import read_source  # noqa: F401
