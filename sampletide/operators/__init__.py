"""Operators over samples and telemetry records: sampling, routing, digests, events, metrics."""
