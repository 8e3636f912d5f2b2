"""Stored tables that are rewritten in part."""

import pytest
from pyspark.sql import functions as F

from cardwatch.operators.incidents import store_incidents
from cardwatch.sources import sinks as S
from cardwatch.sources.versions import SnapshotTable, VersionFiles

DAY = 86_400_000
SCHEMA = "incident_id string, status string, first_ms bigint, detected_ms bigint, last_ms bigint, score double"


def incidents(spark, rows):
    return spark.createDataFrame([(f"i{i}", s, f, f + 1, last, x) for i, s, f, last, x in rows], SCHEMA)


def read(table):
    return {r.incident_id: (r.status, r.first_ms, r.last_ms, r.score) for r in table.read().collect()}


def test_upserts_are_committed_by_bucket(spark, tmp_path):
    table = SnapshotTable(spark, tmp_path.as_uri(), incidents(spark, [(0, "open", 0, 0, 0.0)]).schema, "incident_id", buckets=8)
    assert table.read().count() == 0 and store_incidents(table, incidents(spark, [(0, "x", 0, 0, 0.0)]).limit(0)) == []
    store_incidents(table, incidents(spark, [(i, "contained", 10, 20, 0.5) for i in range(30)]))
    folders = table.version()["folders"]
    touched = store_incidents(table, incidents(spark, [(3, "open", 11, 40, 0.9), (99, "open", 50, 60, 0.7)]))
    assert len(touched) <= 2
    want = {f"i{i}": ("contained", 10, 20, 0.5) for i in range(30)} | {"i3": ("contained", 10, 40, 0.9), "i99": ("open", 50, 60, 0.7)}  # status and first time stay
    assert read(table) == want
    now = table.version()["folders"]
    assert {b for b in folders if now[b] == folders[b]} == {b for b in folders if int(b) not in touched}


def test_a_failed_write_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = SnapshotTable(spark, tmp_path.as_uri(), incidents(spark, [(0, "open", 0, 0, 0.0)]).schema, "incident_id", buckets=4)
    store_incidents(table, incidents(spark, [(i, "open", 1, 2, 0.1) for i in range(10)]))
    want, held = read(table), table.read()

    def stop(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(VersionFiles, "write", stop)
        with pytest.raises(RuntimeError):
            store_incidents(table, incidents(spark, [(i, "open", 1, 9, 0.9) for i in range(10)]))
    assert read(table) == want
    store_incidents(table, incidents(spark, [(i, "open", 1, 9, 0.9) for i in range(10)]))
    assert {v[2] for v in read(table).values()} == {9}
    assert held.agg(F.max("last_ms")).first()[0] == 2  # a reader of the version before still finds its files
    with pytest.raises(RuntimeError):
        table.files.write("versions", 2, {})  # a second writer


def test_purge_and_clear_touch_only_what_they_must(spark, tmp_path):
    rows = [(i, "processed" if i % 2 else "failed", i * DAY, f"body{i}", None, "replay" if i == 6 else "live", "f1" if i == 6 else None) for i in range(20)]
    like = spark.createDataFrame(rows, "event_id bigint, status string, received_ms bigint, raw_body string, purged_ms bigint, source string, family string")
    table = SnapshotTable(spark, tmp_path.as_uri(), like.schema, "event_id", buckets=16)
    table.put(like)
    S.purge_stored(table, now_ms=12 * DAY)
    first = {r.event_id: (r.raw_body, r.purged_ms) for r in table.read().collect()}
    assert first == {i: (None, 12 * DAY) if i in (1, 3) else (f"body{i}", None) for i in range(20)}
    S.purge_stored(table, now_ms=14 * DAY)  # what is purged already keeps its time
    assert {r.event_id: r.purged_ms for r in table.read().filter("purged_ms IS NOT NULL").collect()} == {1: 12 * DAY, 3: 12 * DAY, 5: 14 * DAY}
    assert S.purge_stored(table, now_ms=14 * DAY) == []
    assert len(S.clear_stored(table, "f1")) == 1 and S.clear_stored(table, "f1") == []
    assert {r.event_id for r in table.read().collect()} == set(range(20)) - {6}
