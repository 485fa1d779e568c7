"""Connected components: few links in one task, many by rounds, against a brute-force version; and what they cost the driver."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from meridex.llm import common, simhash
from meridex.llm.components import connected_components


def brute(links):
    root = {x: x for link in links for x in link if link[0] != link[1]}
    for _ in root:
        before = dict(root)
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    return root


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        run()
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


@pytest.mark.parametrize("one_task", [0, 1 << 19])
def test_both_ways_give_the_components(spark, one_task):
    rng = random.Random(5)
    links = [(rng.randrange(-150, 150), rng.randrange(-150, 150)) for _ in range(120)]
    links += [(1000 + k, 999 + k) for k in range(40)] + [(5000, 5001 + k) for k in range(30)] + [(7, 7), (9999, 9999), (2**62, -(2**62))]
    got = connected_components(spark.createDataFrame(links, "a long, b long"), one_task=one_task)
    assert {r.node: r.root for r in got.collect()} == brute(links) and got.count() == len(brute(links))
    named = [(a.to_bytes(9, "big", signed=True), b.to_bytes(9, "big", signed=True)) for a, b in links]
    got = connected_components(spark.createDataFrame(named, "a binary, b binary"), one_task=one_task)
    assert {bytes(r.node): bytes(r.root) for r in got.collect()} == brute(named)
    assert connected_components(spark.createDataFrame([(3, 3)], "a long, b long"), one_task=one_task).collect() == []


def test_few_links_cost_the_driver_few_jobs(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long")
    assert jobs_of(spark, "a chain", lambda: connected_components(links).collect()) <= 8  # by rounds: several of them for each


def test_near_dedup_costs_the_driver_few_jobs(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=80)) for _ in range(60)]
    texts += [t + " more" * k for t in texts[::3] for k in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert jobs_of(spark, "near-dedup", lambda: simhash.drop_near_duplicates(docs).collect()) <= 150


def test_near_dedup_gives_the_drivers_memory_back(spark, monkeypatch):
    returned, give_back = [], common.give_back_on_driver
    monkeypatch.setattr(simhash, "give_back_on_driver", lambda s: returned.append(give_back(s)))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "A B C D E F"), (3, "g h i")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == [1, 3]
    assert len(returned) == 4 and all(x is returned[0] for x in returned)
    monkeypatch.setattr(type(spark.sparkContext), "_jvm", None)  # where it can't be done, nothing happens
    assert give_back(spark) is False


@pytest.mark.parametrize("words", range(7))
def test_shingles_of_a_batch_of_few_words(words):
    text = " ".join("abcdefg"[:words])
    alone, = simhash.stage_shingles(pa.array([text]))
    among, _ = simhash.stage_shingles(pa.array([text, "and a longer text of more than five words"]))
    assert len(alone) == (max(1, words - 4) if words else 0) and list(alone) == list(among)
