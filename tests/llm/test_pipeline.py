"""The pipeline and each of its stages on its own input, against brute-force versions, on a small fixture."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from meridex.llm.tokens import chunk_tokenizer, tokenizer_path

from .test_operators import brute_lines, brute_stage


def made(rng, n):
    return ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]


def fixture(spark, folder):
    rng = random.Random(31)
    passage = [" ".join(made(rng, 12)) for _ in range(6)]
    rows, labels = [], []
    for i in range(400):
        w = made(rng, rng.randint(20, 120))
        if i % 5 == 0:
            w[rng.randrange(len(w))] = rng.choice(["scoundrel", "nitwit"])
        lines = [" ".join(w[k : k + 9]) for k in range(0, len(w), 9)]
        if i % 7 == 0:
            lines[2:2] = passage
        rows.append((i, "\n".join(lines), "en", ("a", "b", None)[i % 3 and 1 + i % 2], 0))
        labels.append((i, 1, int(i % 5 == 0)))
    for i in range(40):  # near copies, around the similarity
        w = rows[i * 9 + 1][1].split()
        for _ in range(rng.choice([0, 1, 2, 4])):
            w[rng.randrange(len(w))] = "zzz"
        rows.append((1000 + i, " ".join(w), "en", "a", 0))
    rows += [(2000, None, "en", "a", 0), (2001, "", "en", "b", 0), (None, "no name at all", "en", "a", 0), rows[3], rows[3]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def pieces(texts):
    tok = chunk_tokenizer(tokenizer_path()).tok
    out = Counter()
    for doc, text in texts:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s : s + 4096]
            out[doc, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    return out


def test_stages_and_run(spark, tmp_path):
    folder = f"file://{tmp_path}"
    fixture(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, [(r.doc_id, r.text) for r in docs.collect()]
    for nth, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{nth}")
        docs = spark.read.parquet(f"{folder}/{nth}")
        if nth < 4:
            assert docs.columns == columns, name
            after = [(r.doc_id, r.text) for r in docs.collect()]
        if nth == 0:
            bad = lambda t: any(x in (t or "").split() for x in ("scoundrel", "nitwit"))
            assert Counter(after) == Counter((d, t) for d, t in before if not bad(t))
        elif nth == 1:
            want = brute_lines(before, 50)
            told = [(d, t, want[d, t]) for d, t in before]
            assert Counter(after) == Counter((d, w) for d, t, w in told if w == t or w.replace("\n", "").strip(" "))
            assert any(w != t for _, t, w in told)
        elif nth == 2:
            assert sorted((d is None, d or 0) for d, _ in after) == brute_stage(before) and len(after) < len(before)
            assert not Counter(after) - Counter(before)
        elif nth == 3:  # as many tokens as there are, so that hardly any document of this even mixture goes
            assert set(after) <= set(before) and len(after) > 0.9 * len(before)
        else:
            got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in docs.collect())
            assert got == pieces(before)
        before = after
    again = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in again) == got
