"""The event stream against a plain batch, for a table that is one file and for one that is a folder of part files."""

from __future__ import annotations

import shutil

import pytest

from meridex.streaming.events import deduplicated

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("parts", [0, 4, 120])
def test_every_event_once(spark, tmp_path, parts):
    if parts:
        events = spark.read.parquet(f"{SF}/events.parquet")
        events.union(events.limit(50)).repartition(parts).write.parquet(f"{tmp_path}/events.parquet")
    else:
        shutil.copy(f"{SF}/events.parquet", tmp_path / "events.parquet")
    want = spark.read.parquet(f"{tmp_path}/events.parquet").dropDuplicates(["event_id"]).select("event_id", "user_id", "event_type").collect()
    got = deduplicated(spark, str(tmp_path)).select("event_id", "user_id", "event_type").collect()
    assert len(want) == 1000 and sorted(got) == sorted(want)
