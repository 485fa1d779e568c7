"""Fast exact token ids for word_bpe_49k and other tokenizers whose tokens never span ASCII white space.

White space is dropped by that tokenizer and separates its pre-tokens, so a text's ids are those of its ASCII-space
separated chunks, in order. Chunks repeat: a batch's texts are split and dictionary-encoded by Arrow, each distinct
chunk is encoded by the tokenizer once for a worker (a bounded cache), and the ids are laid out by numpy.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of a worker's cache of chunks; it is emptied when full (about 220 bytes an entry).
CACHE_ENTRIES = 100_000
#: Texts are laid out about so many bytes at a time.
SLICE_BYTES = 2_000_000
#: Letters below U+0250, which NFC leaves alone, then ASCII signs; "<" and "|" could begin a special token.
WORD = re.compile(r"([A-Za-z\u00c0-\u024f]+)([!-&(-/:;=-@\[-`{}~]*)")


def _byte_chars() -> dict[int, str]:
    """Byte-level BPE writes printable Latin-1 characters as themselves and other bytes as characters from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_CHARS = _byte_chars()


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def sub_batches(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about SLICE_BYTES of text (column at), of one row at least, so that ids are held for few texts."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0), dtype=np.int64))
        a = 0
        while a < len(batch):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE_BYTES)))
            yield batch.slice(a, b - a)
            a = b


class ChunkTokenizer:
    """encode(texts) gives (ids uint32, offsets): ids[offsets[i]:offsets[i + 1]] are those of text i."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        # the short way for words holds for tokenizers that fold case and mark word ends; others take whole chunks
        self.plain = getattr(self.tok.model, "end_of_word_suffix", None) == "</w>" and self.tok.normalizer is not None and self.tok.normalizer.normalize_str("\u00c4B") == "\u00e4b"

    def _raw(self, chunk: str) -> bytes:
        return np.asarray(self.tok.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _core(self, core: str) -> bytes:
        """Of one lower-case pre-token of letters below U+0250, which the model can be given as it is."""
        if (out := self.cores.get(core)) is None:
            if len(self.cores) >= CACHE_ENTRIES:
                self.cores.clear()
            units = core if core.isascii() else core.encode().decode("latin-1").translate(BYTE_CHARS)
            out = self.cores[core] = array("I", [t.id for t in self.tok.model.tokenize(units)]).tobytes()
        return out

    def _encode(self, chunk: str) -> bytes:
        """Of one chunk. Letters and the signs behind them (an apostrophe apart) are separate pre-tokens, and case is folded,
        so that such chunks share what is known of the bare word. All others go through the whole tokenizer."""
        if not self.plain:
            return self._raw(chunk)
        if (m := WORD.fullmatch(chunk)) and m[1].isalpha() and "\u0130" not in chunk:
            return self._core(m[1].lower()) + (self._core(m[2]) if m[2] else b"")
        return self._raw(chunk)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_string()).fill_null("")
        ends = np.cumsum(np.asarray(pc.binary_length(texts), dtype=np.int64))
        if len(texts) > 1 and ends[-1] > SLICE_BYTES:
            parts, at = [], 0
            while at < len(texts):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES)))
                parts.append(self.encode(texts.slice(at, stop - at)))
                at = stop
            shift = np.cumsum([0, *(len(ids) for ids, _ in parts)])
            return np.concatenate([ids for ids, _ in parts]), np.concatenate([np.zeros(1, np.int64), *(o[1:] + d for (_, o), d in zip(parts, shift, strict=False))])
        lists = pc.ascii_split_whitespace(texts)
        bounds = np.asarray(lists.offsets, dtype=np.int64)
        coded = lists.values.dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices)
        cache = self.cache
        if len(cache) >= CACHE_ENTRIES:
            cache.clear()
        got = list(map(cache.get, words))
        for i, ids in enumerate(got):
            if ids is None:
                w = words[i]
                got[i] = cache[w] = self._encode(w)
        flat = np.frombuffer(b"".join(got), "<u4")
        size = np.fromiter(map(len, got), np.int32, len(got)) >> 2
        begin = np.cumsum(size, dtype=np.int64) - size
        n = size[codes]
        end = np.cumsum(n, dtype=np.int64)
        at = np.repeat(begin[codes] - (end - n), n)
        at += np.arange(len(at))
        return flat[at], np.concatenate((np.zeros(1, np.int64), end))[bounds]


@lru_cache(maxsize=2)
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """One a worker and path."""
    return ChunkTokenizer(path)
