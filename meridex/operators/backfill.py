"""Embeddings that are missing or out of date, computed anew; those that are current are never sent to the backend."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Backend = Callable[[list[str]], list[list[float] | None]]


def pending(entries: DataFrame, stored: DataFrame, model: str, everything: bool = False) -> DataFrame:
    """The entries (label, text, fallback) without a stored row of this label, model and source_hash (SHA-256 of the text)."""
    wanted = entries.where(F.col("text").isNotNull()).withColumn("source_hash", F.sha2("text", 256))
    if everything:
        return wanted
    return wanted.join(stored.where(F.col("model") == model).select("label", "source_hash"), ["label", "source_hash"], "left_anti")


def backfill(entries: DataFrame, stored: DataFrame, model: str, backend: Backend, everything: bool = False) -> DataFrame:
    """label, state, vector, source_hash of every pending entry. state: embedded; fallback, where only the fallback text gave
    a finite vector; skipped_nan, where no text did; errored, where the backend failed on the entry's text.

    backend takes a batch of texts and returns a vector or None for each (a vector with a NaN counts as none). If a
    batch fails, its texts are tried one by one, so that one bad text costs its own entry only.
    """

    def tried(texts: list[str]) -> list[tuple[str, list[float] | None]]:
        if not texts:
            return []
        try:
            got = backend(texts)
        except Exception:
            return [("errored", None)] if len(texts) == 1 else [tried([t])[0] for t in texts]
        return [("embedded", v) if v is not None and all(map(pd.notna, v)) else ("skipped_nan", None) for v in got]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import sha256

        for f in frames:
            first = tried(f["text"].tolist())
            again = [i for i, ((state, _), text, other) in enumerate(zip(first, f["text"], f["fallback"], strict=True)) if state == "skipped_nan" and other and other != text]
            second = dict(zip(again, tried([f["fallback"].iloc[i] for i in again]), strict=True))
            rows = []
            for i, (state, vector) in enumerate(first):
                used = f["source_hash"].iloc[i]
                if i in second:
                    state, vector = second[i]
                    if state == "embedded":
                        state, used = "fallback", sha256(f["fallback"].iloc[i].encode()).hexdigest()
                rows.append((f["label"].iloc[i], state, vector, used))
            yield pd.DataFrame(rows, columns=["label", "state", "vector", "source_hash"])

    todo = pending(entries, stored, model, everything).select("label", "text", "fallback", "source_hash")
    return todo.mapInPandas(run, "label string, state string, vector array<double>, source_hash string")
