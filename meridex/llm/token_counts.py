"""Edit-aware token counts.

A document is cut into leaves of some hundred characters, each ending in white space, which pre-tokens never span. A
segment tree holds every leaf's characters and tokens, and their sums. An edit (start, stop, put; code points of the text
as it then is) is found by descending the character sums; only the leaves it touches are encoded again, with the next
ones as far as the edit took away the white space between them, and the sums on the way to the root are updated.

Defined cases: a null text counts as empty; starts and stops beyond the text are its end, a stop before its start is its
start; a null replacement is empty; edits of a document apply in order; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import ChunkTokenizer, chunk_tokenizer, tokenizer_path

LEAF_CHARS = 512
SPACE = re.compile(r"[ \t-\r]+")


def leaves(text: str, size: int = LEAF_CHARS) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = SPACE.search(text, at + size)
        stop = m.end() if m else len(text)
        out.append(text[at:stop])
        at = stop
    return out or [""]


class CountTree:
    """Sums of characters and tokens over leaves; leaf i is node width + i, the root is node 1."""

    def __init__(self, parts: list[str]):
        self.width = 1
        while self.width < len(parts):
            self.width *= 2
        self.parts = parts + [""] * (self.width - len(parts))
        self.chars = [0] * self.width + [len(p) for p in self.parts]
        self.tokens = [0] * (2 * self.width)
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    def fill(self, tokens: list[int]) -> None:
        self.tokens[self.width : self.width + len(tokens)] = tokens
        for i in range(self.width - 1, 0, -1):
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf with the character at (the last leaf with any, if beyond), and its place in there."""
        node, at = 1, min(at, self.chars[1])
        while node < self.width:
            node *= 2
            if at >= self.chars[node] and self.chars[node + 1]:
                at -= self.chars[node]
                node += 1
        return node - self.width, at

    def touch(self, start: int, stop: int, put: str) -> tuple[int, int, str]:
        """The leaves (first to last) that an edit changes, and the text that takes their place."""
        start = min(max(start, 0), self.chars[1])
        stop = min(max(stop, start), self.chars[1])
        i, a = self.find(start)
        j, b = self.find(stop)
        text = self.parts[i][:a] + put + self.parts[j][b:]
        # context: without white space at the end, the next leaf belongs to the last word
        while text and not SPACE.match(text[-1]) and j + 1 < self.width:
            j += 1
            text += self.parts[j]
        # a leaf before always ends in white space, except where earlier edits emptied it
        return i, j, text

    def put(self, i: int, j: int, text: str, tokens: int) -> None:
        for k in range(i, j + 1):
            self.parts[k] = text if k == i else ""
            node = self.width + k
            self.chars[node], self.tokens[node] = (len(text), tokens) if k == i else (0, 0)
            while node > 1:
                node //= 2
                self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
                self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]


def _counts(tok: ChunkTokenizer, texts: list[str]) -> list[int]:
    _, offsets = tok.encode(pa.array(texts, pa.large_string()))
    return (offsets[1:] - offsets[:-1]).tolist()


def edited_counts(docs: DataFrame, edits: str = "edits", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, edited_tokens, edited_chars, reencoded_chars of docs, whose column edits is an array of structs
    (start, stop, put)."""
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = chunk_tokenizer(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                trees = [CountTree(leaves(t or "")) for t in batch.column(1).to_pylist()]
                edits = [e or [] for e in batch.column(2).to_pylist()]
                used = [[p for p in t.parts if p] for t in trees]
                got, k = _counts(tok, [p for u in used for p in u]), 0
                for t, u in zip(trees, used, strict=True):
                    t.fill(got[k : k + len(u)])
                    k += len(u)
                before, again = [t.tokens[1] for t in trees], [0] * len(trees)
                for n in range(max(map(len, edits), default=0)):
                    now = [(x, *trees[x].touch(e[n]["start"] or 0, e[n]["stop"] or 0, e[n]["put"] or "")) for x, e in enumerate(edits) if n < len(e) and e[n] is not None]
                    for (x, i, j, new), c in zip(now, _counts(tok, [new for *_, new in now]), strict=True):
                        trees[x].put(i, j, new, c)
                        again[x] += len(new)
                columns = [batch.column(0), *(pa.array(v, pa.int64()) for v in (before, [t.tokens[1] for t in trees], [t.chars[1] for t in trees], again))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "edited_tokens", "edited_chars", "reencoded_chars"])

    schema = "doc_id long, n_tokens long, edited_tokens long, edited_chars long, reencoded_chars long"
    return docs.select(F.col("doc_id").cast("long"), F.col(text), F.col(edits)).mapInArrow(run, schema)


def with_sample_edits(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the query's edits: a cut at a quarter, words put in at a half, and a replacement across a word's middle."""
    n = F.char_length(F.coalesce(F.col(text), F.lit("")))
    edit = lambda a, b, put: F.struct(F.floor(a).cast("int").alias("start"), F.floor(b).cast("int").alias("stop"), F.lit(put).alias("put"))
    return docs.withColumn("edits", F.array(edit(n / 4, n / 4 + 16, ""), edit(n / 2, n / 2, " as amended, "), edit(n * 3 / 4, n * 3 / 4 + 5, "re")))
