"""Chunks against a plain fold."""

from __future__ import annotations

import re

import pytest

from meridex.functions import chunks


def fold(parts, budget, sep):
    out = []
    for p in parts:
        if out and len(out[-1]) + len(sep) + len(p) <= budget:
            out[-1] += sep + p
        else:
            out.append(p)
    return out


def test_chunks(spark):
    texts = [None, "", " \n ", "one", "a\n\nb\n\nc" * 9, "# t\nintro\n## x\nbody\n## y\n" + "long paragraph\n\n" * 5 + "\n## z\nend", "w" * 100 + "\n\n" + "v"]
    budget = 40
    want = []
    for i, t in enumerate(texts):
        sections = [s for s in re.split(r"\n(?=## )", t or "") if s.strip()]
        parts = [p for s in sections for p in (fold([q for q in re.split(r"\n{2,}", s) if q.strip()], budget, "\n\n") if len(s) > budget else [s])]
        at = 0
        for k, c in enumerate(fold(parts, budget, "\n")):
            want.append((i, k, c, at, at + len(c)))
            at += len(c) + 1
    got = chunks.chunk(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), budget).collect()
    assert sorted(map(tuple, got)) == want
    with pytest.raises(ValueError):
        chunks.chunk(spark.createDataFrame([], "doc_id long, text string"), 0)
