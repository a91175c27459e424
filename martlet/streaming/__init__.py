"""Sheets that arrive as files.

The reference has no streaming: its load is a one-shot full refresh (empty the
tables, load the whole sheet).  The only streaming piece here keeps exactly
those semantics for sheets that keep arriving: a Structured Streaming query
stages every new file's rows into a sheet store (``foreachBatch``, one
partition per micro-batch, overwritten on replay so a retried batch cannot
double rows), and ``refresh_from_store`` reruns the batch ingest over
everything staged so far.
"""

from martlet.streaming.sheet_stream import refresh_from_store, stage_sheet_stream

__all__ = ["refresh_from_store", "stage_sheet_stream"]
