"""Queries without SQL see all their rows."""

from __future__ import annotations

from strideline import queries_state
from strideline.sources import tables


def test_every_event_is_a_tagged_record(spark, sf):
    ids = [r["record_id"] for r in queries_state.tagged_records(spark, sf).collect()]
    events = {f"G{r[0]}" for r in tables.box(spark, sf).select("event_id").distinct().collect()}
    assert len(ids) == len(events) and set(ids) == events
