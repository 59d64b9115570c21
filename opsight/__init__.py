"""Operational analytics on Spark: typed log ingest, ranked and cumulative
reports, time-series alignment, concurrency, catalog reconciliation and
event-driven processing, all as DataFrame -> DataFrame functions."""
