"""Each operator against a brute-force version, and its edge cases: nulls, empty and long texts, ties, empty tables."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from meridex.llm import chat, exact_dedup, fingerprint, line_dedup, mixing, packing, simhash, token_counts, toxicity, warc
from meridex.llm.components import connected_components
from meridex.llm.tokens import chunk_tokenizer, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, fp string, rank int"


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["ab", "cde", "Fgh,", "ij.", "klm", "nö", "pqr***", "it's", "42"]) + rng.choice(["", "", "x", "yz"]) for _ in range(n))


def corpus() -> list[tuple]:
    rng = random.Random(5)
    texts = [words(rng, rng.randint(1, 400)) for _ in range(40)]
    texts += [texts[0], texts[1] + " more", texts[2].replace(" ", "  \n"), None, "", "   ", words(rng, 9000), "one", "two words", texts[0]]
    rows = [(i, t, "en", ("a", "b", None)[i % 3], "clash", 1) for i, t in enumerate(texts)]
    return [*rows, (None, texts[3], None, "a", None, None), rows[5], rows[5]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_packing(docs, none):
    got = packing.best_fit_pack(docs, capacity=300).collect()
    tok = chunk_tokenizer(tokenizer_path()).tok
    want = Counter()
    for doc, text, *_ in corpus():
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 300)):
            part = ids[s : s + 300]
            want[(doc, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in pairwise(p)) and sum(p[-1]) <= 300
    assert len(places) <= math.ceil(sum(r.length for r in got) / 300) + 1
    assert packing.best_fit_pack(none).count() == 0


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(50):
        cap = rng.randint(5, 60)
        sizes = sorted((rng.randint(1, cap) for _ in range(rng.randint(1, 200))), reverse=True)
        bins: list[int] = []
        for s in sizes:
            fit = [g for g in bins if g >= s]
            if fit:
                bins.remove(min(fit))
                bins.append(min(fit) - s)
            else:
                bins.append(cap - s)
        plan = packing.plan_best_fit(dict(Counter(sizes)), cap)
        assert plan.sequences == len(bins)


def test_fingerprints(docs, none):
    got = fingerprint.fingerprint_report(docs).collect()
    rows = corpus()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    text = {r[0]: r[1] or "" for r in rows}
    ids = [*sorted((i for i in text if i is not None), reverse=True), None]
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))

    def likeness(a, b):
        a, b = Counter(a.encode().split()), Counter(b.encode().split())
        return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0

    error = []
    prints = {}
    for r in got:
        t, k = text[r.doc_id], len(text[r.doc_id]) // 3
        edited = t[: len(t) - k] + text[after[r.doc_id]][:k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        error += [r.near_edited - likeness(t, edited), r.near_next - likeness(t, text[after[r.doc_id]])]
    assert max(map(abs, error)) < 0.4 and abs(np.mean(error)) < 0.05
    assert fingerprint.fingerprint_report(none).count() == 0


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, copies int"
    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    rows = [(c, t, *turns[t], 0) for c, n in ((1, 2), (2, 4), (3, 4), (4, 1)) for t in range(n)]
    rows += [(5, 0, "user", "z", 0), (6, 0, None, None, 0), (7, 0, "user", "c", 0), (8, 0, "assistant", "b", 0), (8, 1, "user", "a", 0)]
    rows += [(9, t, "user", str(t), 0) for t in range(2000)] + [(10, t, "user", str(t), 0) for t in range(700)]
    got = {(r.conv_id, r.part): r for r in chat.format_chats(spark.createDataFrame(rows, schema)).collect()}
    assert sorted(got) == [(2, 0), (5, 0), (6, 0), (7, 0), (8, 0), (9, 0), (9, 1)]
    assert got[2, 0].text == "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in turns) and got[2, 0].copies == 2
    assert got[6, 0].text == "<|user|>\n\n<|end|>\n"
    assert "".join(got[9, p].text for p in (0, 1)) == "".join(f"<|user|>\n{t}\n<|end|>\n" for t in range(2000))
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0


def test_token_counts(spark, none):
    rng = random.Random(3)
    tok = chunk_tokenizer(tokenizer_path()).tok
    rows, want = [], {}
    for i, (_, text, *_) in enumerate(corpus()):
        edits, now = [], text or ""
        for _ in range(rng.randint(0, 5)):
            a = rng.randint(-2, len(now) + 5)
            b = a + rng.randint(-3, 900)
            put = rng.choice([None, "", " ", "x", "new words here", "  \n"])
            edits.append((a, b, put))
            s = min(max(a, 0), len(now))
            now = now[:s] + (put or "") + now[min(max(b, s), len(now)) :]
        rows.append((i, text, edits))
        want[i] = (*(len(tok.encode(t, add_special_tokens=False).ids) for t in (text or "", now)), len(now))
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start int, stop int, put string>>")
    got = token_counts.edited_counts(df).collect()
    assert {r.doc_id: (r.n_tokens, r.edited_tokens, r.edited_chars) for r in got} == want
    assert token_counts.edited_counts(token_counts.with_sample_edits(none)).count() == 0


def test_mixing(spark, none):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randint(1, 30)), "en", s, None, None) for i, s in enumerate(["big"] * 3000 + ["mid"] * 300 + [None] * 30)]
    rows += [(9000, None, "en", "empty", None, None), (9001, "", None, "empty", None, None)]
    df = spark.createDataFrame(rows, DOCS)
    tok = chunk_tokenizer(tokenizer_path()).tok
    count = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)
    tokens = defaultdict(int)
    for r in rows:
        tokens[r[3]] += count(r[1])
    total = sum(tokens.values())
    for how in ({"max_repeats": 4.0}, {"target_entropy": 0.9}, {"max_repeats": 2.0, "budget": total // 2}):
        got = mixing.mix_sources(df, **how).collect()
        taken = defaultdict(int)
        for r in got:
            taken[r.source] += count(r.text)
        budget = how.get("budget", total)
        assert sum(taken.values()) <= budget and sum(taken.values()) >= budget - 200
        p = np.array([taken[s] / sum(taken.values()) for s in ("big", "mid", None)])
        if "target_entropy" in how:
            assert abs(-(p * np.log(p)).sum() - 0.9) < 0.01
        else:
            most = max(taken[s] / tokens[s] for s in ("big", "mid", None))
            assert most <= how["max_repeats"] + 1e-6 and most > 0.9 * how["max_repeats"]
        each = Counter((r.doc_id, r.epoch) for r in got)
        assert max(each.values()) == 1
        brute_mix(rows, got, tokens, count, how, budget)
        # a pass is a permutation of its own
        orders = [[r.doc_id for r in sorted(got, key=lambda r: r.place) if r.epoch == e and r.source is None] for e in (1, 2)]
        assert orders[0] != sorted(orders[0])
        if len(orders[1]) > 5:
            assert [x for x in orders[0] if x in set(orders[1])] != orders[1]
    assert mixing.mix_sources(none).count() == 0
    assert mixing.mix_sources(df, budget=0).count() == 0
    for bad in ({"budget": 9 * total}, {"target_entropy": 1.2}, {"target_entropy": -0.1}, {"budget": -1}):
        with pytest.raises(ValueError):
            mixing.mix_sources(df, **bad)
    clash = df.withColumnsRenamed({"fp": "block", "rank": "epoch", "lang": "mix_key"}).selectExpr("*", "source AS key", "1 AS rest")
    got = mixing.mix_sources(clash)
    assert sorted(got.columns) == sorted([*clash.columns, "place"]) and got.count() > 3000


def brute_mix(rows, got, tokens, count, how, budget):
    """The mixture told by plain loops: exponent, quotas, whole passes, and the last pass as far as the quota goes."""
    total = sum(tokens.values())
    shares = {s: n / total for s, n in tokens.items() if n}
    weights = lambda a: {s: x**a / sum(y**a for y in shares.values()) for s, x in shares.items()}
    if "target_entropy" in how:
        good = lambda a: -sum(w * math.log(w) for w in weights(a).values()) <= how["target_entropy"]
    else:
        good = lambda a: max(w * budget / tokens[s] for s, w in weights(a).items()) <= how["max_repeats"] * (1 + 1e-9)
    low, high = 0.0, 1.0 if "target_entropy" not in how else 8.0
    if good(low):
        high = low
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if good(mid) else (mid, high)
    taken, passes = defaultdict(int), defaultdict(int)
    for r in got:
        taken[r.source] += count(r.text)
        passes[r.source] = max(passes[r.source], r.epoch)
    size = {s: max(count(r[1]) for r in rows if r[3] == s) for s in shares}
    for s, w in weights(high).items():
        assert abs(taken[s] - w * budget) <= size[s] + 1e-4 * budget
        full = int(w * budget / tokens[s] - 1e-3)
        assert full <= passes[s] <= full + 1
        for e in range(1, full + 1):
            assert sum(r.epoch == e and r.source == s for r in got) == sum(r[3] == s for r in rows)


def test_warc(spark):
    rng = random.Random(4)
    schema = "page_id long, url string, html string, digest string"
    htmls = ["<p>" + "".join(chr(rng.randint(32, 0x2FF)) for _ in range(rng.randint(0, 3000))) for _ in range(60)]
    htmls += [htmls[0]] * 20 + [None, "", "WARC/1.1\r\n\r\n\x1f"]
    rows = [(i, f"http://h/{i}", h, "clash") for i, h in enumerate(htmls)]
    rows += [rows[3], rows[3], (None, None, htmls[1], None), (None, "u", "lonely", None)]
    pages = spark.createDataFrame(rows, schema)
    top = {}
    for i, _, h, _ in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    left = Counter()
    want = Counter()
    for i, _, h, _ in rows:
        body = (h or "").encode()
        alone = sum((x[2] or "") == (h or "") for x in rows) == 1
        first = alone or (i == top[h or ""] and not left[(i, h)])
        left[(i, h)] += 1
        want[(i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first else "revisit", None if first else top[h or ""])] += 1
    assert Counter(map(tuple, warc.round_trip(pages).collect())) == want
    from meridex.llm.common import scratch_path

    path = scratch_path(spark, "test-warc")
    files = warc.write_archives(pages, path)
    for split in (100, 1000):
        got = warc.read_archives(spark, path, files, split).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        assert Counter(map(tuple, got.collect())) == want
    assert warc.round_trip(spark.createDataFrame([], schema)).count() == 0
    # record ids are unique, and revisits name that of their response
    import gzip
    from urllib.parse import urlparse

    ids, refers = [], []
    for name, _ in files:
        for block in gzip.open(f"{urlparse(path).path}/{name}").read().split(b"WARC/1.1\r\nWARC-Type")[1:]:
            head = block.partition(b"\r\n\r\n")[0].split(b"\r\n")
            ids += [x.split(b": ")[1] for x in head if x.startswith(b"WARC-Record-ID: ")]
            refers += [x.split(b": ")[1] for x in head if x.startswith(b"WARC-Refers-To: ")]
    assert len(ids) == len(set(ids)) == len(rows) and set(refers) <= set(ids) and len(refers) == sum(n for k, n in want.items() if k[3] == "revisit")
    # a record of another version, without a digest, behind bytes that aren't one
    old = scratch_path(spark, "old-warc")
    fs, root = warc.filesystem(old)
    fs.create_dir(root, recursive=True)
    body = gzip.compress(b"WARC/1.0\r\nWARC-Type: revisit\r\nContent-Length: 0\r\n\r\n\r\n\r\n") + b"\x1f\x8b\x08noise" + gzip.compress(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: text/plain\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    with fs.open_output_stream(f"{root}/a.warc.gz", compression=None) as out:
        out.write(body)
    got = warc.read_archives(spark, old, [("a.warc.gz", len(body))], 16).collect()
    assert sorted((r.record_type, r.payload, r.payload_digest is None) for r in got) == [("revisit", None, True), ("warcinfo", b"abc", False)]
    with pytest.raises(ValueError):
        warc.filesystem("/tmp/x")


def brute_lines(rows, least):
    """What later windows repeat, by looking at all windows of all documents in order."""
    seen, gone = {}, defaultdict(set)
    order = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    todo = []
    for doc, text in order:
        lines = [(i, x.strip(" ")) for i, x in enumerate((text or "").split("\n")) if x.strip(" ")]
        n = [len(re.split(" +", x)) for _, x in lines]
        for a in range(len(lines)):
            for step in (1, -1):
                b, got = a, 0
                while 0 <= b < len(lines) and got < least:
                    got += n[b]
                    b += step
                if got >= least:
                    lo, hi = sorted((a, b - step))
                    todo.append((doc, lines[lo][0], lines[hi][0], tuple(x for _, x in lines[lo : hi + 1])))
    for doc, lo, hi, content in sorted(todo, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])):
        first = seen.setdefault(content, (doc, lo, hi))
        if first[0] != doc or lo > first[2]:
            gone[doc] |= set(range(lo, hi + 1))
    return {(doc, text): (text if text is None or doc not in gone else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[doc] or not x.strip(" "))) for doc, text in order}


def test_line_dedup(spark, none):
    rng = random.Random(6)
    stock = [words(rng, rng.randint(1, 30)) for _ in range(60)] + [""]
    rows = []
    for i in range(60):
        lines = [rng.choice(stock) if rng.random() < 0.3 else words(rng, rng.randint(1, 40)) for _ in range(rng.randint(1, 12))]
        at = rng.randint(0, 40)
        if rng.random() < 0.6:
            lines[2:2] = stock[at : at + rng.randint(2, 8)]
        rows.append((i, "\n".join(lines), None, None, None, None))
    rows += [(100, None, None, None, None, None), (101, "", None, None, None, None), (102, rows[0][1], None, None, None, None), (103, "\n".join(["same old line"] * 80), None, None, None, None), (None, rows[1][1], None, None, None, None), rows[7]]
    want = brute_lines(rows, 50)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], want[r[0], r[1]]) for r in rows)
    assert sum(r.lines_deleted > 0 for r in got) > 10
    assert line_dedup.dedup_lines(none).count() == 0
    clash = spark.createDataFrame(rows, DOCS).withColumnsRenamed({"fp": "gone", "rank": "lines_deleted", "lang": "gone_rid"})
    again = line_dedup.dedup_lines(clash)
    assert again.columns == ["doc_id", "text", "gone_rid", "source", "gone", "lines_deleted"] and Counter((r.doc_id, r.text) for r in again.collect()) == Counter((r.doc_id, r.text) for r in got)
    kept = line_dedup.drop_repeated_lines(clash)
    assert kept.columns == clash.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((r[0], w) for r in rows for w in [want[r[0], r[1]]] if w == r[1] or w.replace("\n", "").strip(" "))


def test_line_dedup_joins_alike_at_every_size(spark):
    run = "\n".join("same old line" for _ in range(30))
    out = line_dedup.dedup_lines(spark.createDataFrame([(i, f"{run}\nown {i}", None, None, None, None) for i in range(3)], DOCS))
    assert [(r.doc_id, r.lines_deleted) for r in out.orderBy("doc_id").collect()][1:] == [(1, 30), (2, 30)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_exact_dedup(spark, docs, none):
    flat = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    rows, groups = corpus(), defaultdict(list)
    for r in rows:
        groups[flat(r[1])].append(r[0])
    want, seen = Counter(), set()
    for r in rows:
        g = groups[flat(r[1])]
        keep = min((x for x in g if x is not None), default=None)
        want[(r[0], keep, len(g), r[0] == keep and (keep, flat(r[1])) not in seen, hashlib.sha256(flat(r[1]).encode()).hexdigest())] += 1
        if r[0] == keep:
            seen.add((keep, flat(r[1])))
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs).collect())) == want
    assert exact_dedup.exact_dedup(none).count() == 0
    # a second batch meets what the first left in the index
    index = exact_dedup.DigestIndex(spark, buckets=3)
    exact_dedup.exact_dedup(docs.where("doc_id < 30"), index).count()
    again = exact_dedup.exact_dedup(docs.where("doc_id >= 30 and doc_id < 60"), index).collect()
    firsts = {flat(r[1]) for r in rows if r[0] is not None and r[0] < 30}
    assert all(not r.kept for r in again if any(hashlib.sha256(f.encode()).hexdigest() == r.text_sha256 for f in firsts)) and any(r.keep_id < 30 for r in again)
    # a batch that is given again gives the same again
    last = Counter(map(tuple, again))
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs.where("doc_id >= 30 and doc_id < 60"), index).collect())) == last
    n = index.table().count()
    index.compact()
    assert index.table().count() == n == index.table().select("digest").distinct().count()


def test_toxicity(spark, none):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        text = words(rng, rng.randint(5, 60)).split()
        if bad:
            text[rng.randrange(len(text))] = rng.choice(["scoundrel", "nitwit,"])
        rows.append((i, " ".join(text), None, None, None, None))
        labels.append((i, 1, int(bad)))
    rows += [(5000, None, None, None, None, None), (5001, "", None, None, None, None), (None, "nitwit", None, None, None, None)]
    schema = "doc_id long, quality int, toxic int"
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5000, 0, None)], schema)
    got = toxicity.toxicity_report(spark.createDataFrame(rows, DOCS), marks).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held) and len(held) > 150
    known = {i: t for i, _, t in labels}
    assert np.mean([r.predicted == known[r.doc_id] for r in held if r.doc_id in known]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert toxicity.toxicity_report(none, marks).count() == 0
    # nothing to learn from: no document is rejected
    unmarked = spark.createDataFrame([], schema)
    assert all(r.score < 0.01 and not r.predicted for r in toxicity.toxicity_report(spark.createDataFrame(rows, DOCS), unmarked).collect())
    assert toxicity.drop_toxic(spark.createDataFrame(rows, DOCS), unmarked).count() == len(rows)
    # one text that exceeds the bound of the sample doesn't stand in the way of the others; a column of the score's name stays
    long = spark.createDataFrame([(r[0], "x " * 4000, *r[2:]) if r[0] == 7 else r for r in rows], DOCS)
    few = toxicity.training_rows(long, marks, max_chars=200_000)
    assert few.count() > 400
    assert toxicity.training_rows(long, marks, max_chars=3000).where("length(text) > 3000").count() == 0
    kept = toxicity.drop_toxic(long.withColumnRenamed("fp", "toxicity"), marks)
    assert "toxicity" in kept.columns and 700 <= kept.count() <= 760


def brute_simhash(text):
    found = re.findall(rb"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode())
    if not found:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(found[i : i + 4]), 42) for i in range(max(1, len(found) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, most):
    names = sorted(set(fps))
    root = {f: f for f in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if (a ^ b).bit_count() <= most:
                root[find(a)] = find(b)
    return {f: find(f) for f in names}


def test_simhash(spark, docs, none):
    rng = random.Random(9)
    rows = corpus()
    base = [words(rng, 300) for _ in range(12)]
    for i in range(150):  # near copies: one or two words changed
        t = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = rng.choice("abcdefgh")
        rows.append((1000 + i, " ".join(t), None, None, None, None))
    fps = [brute_simhash(r[1]) for r in rows]
    comp = brute_components(fps, 4)
    least = {}
    for r, f in zip(rows, fps, strict=True):
        if r[0] is not None:
            least[comp[f]] = min(least.get(comp[f], r[0]), r[0])
    want = Counter((r[0], f"{f:016x}", least.get(comp[f])) for r, f in zip(rows, fps, strict=True))
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter(map(tuple, got)) == want
    assert simhash.near_duplicates(none).count() == 0


def test_pigeonhole_finds_every_link(spark):
    rng = random.Random(11)
    fps = []
    for _ in range(60):
        centre = rng.getrandbits(64)
        fps += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(12)]
    fps = sorted(set(fps))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f), [signed(f)], 1) for f in fps], "fid long, fp array<long>, docs long")
    comp = brute_components(fps, 4)
    want = defaultdict(set)
    for f, c in comp.items():
        want[c].add(signed(f))
    want = {frozenset(x) for x in want.values() if len(x) > 1}
    for parts in ((3,), (2, 3, 4, 5)):
        got = defaultdict(set)
        for r in simhash.near_components(df, 1, 4, 4, parts).collect():
            got[r.root].add(r.node)
        assert {frozenset(x) for x in got.values()} == want
    cost, thresholds = simhash.allocate(4, [22, 21, 21], [1e3, 1e6, 1e3], 1000)
    assert sum(thresholds) == 2 and thresholds[1] == min(thresholds) and math.isfinite(cost)


def test_stage_drops_near_duplicates(spark):
    rng = random.Random(12)
    base = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(400)) for _ in range(20)]
    rows = [(i, t, "en", "s", None, None) for i, t in enumerate(base)]
    for i, t in enumerate(base):
        w = t.split()
        for _ in range(3):  # similarity of 0.92 or more
            w[rng.randrange(400)] = "zz"
        rows.append((100 + i, " ".join(w), "en", "s", None, None))
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.doc_id for r in got) == list(range(20))


def brute_stage(rows):
    """doc_ids that stay: of texts linked by a Jaccard similarity of 0.8 of their five-word shingles the smallest, null last."""
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least.setdefault(find(i), []).append((r[0] is None, r[0] or 0))
    return sorted(min(x) for x in least.values())


def test_stage_finds_every_pair_of_the_similarity(spark, none):
    rng = random.Random(21)
    made = lambda n: [("".join(rng.choices("abcdefgh", k=5))) for _ in range(n)]
    passage, rows = made(60), []
    for i in range(60):  # similarities from about 0.6 to 0.95, around 0.8 above all
        w = made(rng.choice([8, 9, 30, 100, 300]))
        w += passage if i % 2 else []
        rows.append((i, " ".join(w), "en", "s", None, None))
        cut = rng.choice([0.02, 0.08, 0.1, 0.11, 0.12, 0.2, 0.25])
        rows.append((1000 + i, " ".join(w[: len(w) - max(1, int(len(w) * cut))] + made(rng.choice([0, int(len(w) * cut)]))), "en", "s", None, None))
    rows += [(3000, None, None, None, None, None), (3001, "", None, None, None, None), (3002, "one", None, None, None, None), (3003, " ONE\n", None, None, None, None)]
    rows += [rows[0], rows[0], (7, "other words than seven has", None, None, None, None)]
    rows += [(None, rows[0][1], None, None, None, None), (None, "nobody else has these words here", None, None, None, None), (1, rows[2][1], "en", "s", None, None)]
    core = made(200)
    for i in range(150):  # near copies, most of them not similar to each other
        w = list(core)
        for k in rng.sample(range(200), 5):
            w[k] = "".join(rng.choices("xyz", k=6))
        rows.append((5000 + i, " ".join(w), "en", "s", None, None))
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == brute_stage(rows)
    assert simhash.drop_near_duplicates(none).count() == 0


def test_stage_searches_fingerprints(spark):
    rng = random.Random(23)
    made = lambda n: ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]
    texts = [" ".join(made(300)) for _ in range(40)]
    for t in texts[:20]:
        w = t.split()
        w[rng.randrange(300)] = "zz"
        texts += [" ".join(w), t.upper()]
    rows = list(enumerate([*texts, None, " "]))
    docs = spark.createDataFrame(rows, "fid long, text string")
    marks = simhash.prefixes(docs, simhash.cell_ranks(docs)).select("fid", "mark").cache()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = {}
    for (fid, text), h in zip(rows, simhash.stage_shingles(pa.array([t for _, t in rows])), strict=True):
        want[fid] = signed(sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > len(h)))
    assert {r.fid: r.mark for r in marks.collect()} == want
    # of all pairs within the radius, each is in one component of the candidates, and no candidate is beyond the distance
    bits = lambda a, b: ((want[a] ^ want[b]) & (2**64 - 1)).bit_count()
    found = simhash.fingerprint_candidates(marks)
    assert all(bits(r.a, r.b) <= simhash.STAGE_DISTANCE for r in found.collect())
    root = {r.node: r.root for r in connected_components(found).collect()}
    close = [(a, b) for a in want for b in range(a) if bits(a, b) <= simhash.STAGE_RADIUS]
    assert len(close) > 30 and all(root[a] == root[b] for a, b in close)


def test_stage_uses_the_search(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(1, text), (2, text.upper()), (3, text + " more"), (4, "quite another text of a few words")], "fid long, text string")
    planned, plan = [], simhash.plan
    monkeypatch.setattr(simhash, "plan", lambda *a: planned.append(plan(*a)) or planned[-1])
    assert {r.node: r.root for r in simhash.similar_components(docs).collect()} == {1: 1, 2: 1, 3: 1}
    (layout, thresholds), = planned
    assert sorted(b for p in layout for b in p) == list(range(64)) and sum(thresholds) == simhash.STAGE_RADIUS - len(layout) + 1


def test_components(spark):
    rng = random.Random(13)
    links = [(i, i + 1) for i in range(300)] + [(1000, 2000 + i) for i in range(200)] + [(rng.randint(5000, 5200), rng.randint(5000, 5200)) for _ in range(90)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    alone = {x for x in root if all(a == b for a, b in links if x in (a, b))}
    assert got == {x: find(x) for x in root if x not in alone}
