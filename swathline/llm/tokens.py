"""The whole corpus as token ids of a public byte-level BPE vocabulary.

Texts are split into words by the vocabulary's pattern; the distinct words of a slice of texts are merged
together in numpy rounds: the symbols of all words lie in one flat array, every adjacent pair is looked up by
binary search among the sorted pair keys, each word merges all its pairs of lowest rank, finished words leave.
The results fan out to the texts by gathering. A slice is bounded by its number of words, so that neither many
nor very long texts make a worker grow; encoded words are kept in a bounded cache of the worker.

Defined results: a NULL text and an empty text give an empty list; blank texts are encoded like any other;
the strings of special tokens are ordinary text; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from swathline.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's texts are split (white space by its Unicode property).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
SLICE_WORDS = 200_000
CACHE_WORDS = 300_000


class Bpe:
    """Ranks, pair keys and the worker's cache of one vocabulary."""

    def __init__(self, path: str):
        import regex

        rank: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                word, n = line.split()
                rank[base64.b64decode(word)] = int(n)
        self.byte = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        pairs = [(rank[w[:i]] << 20 | rank[w[i:]], n) for w, n in rank.items() for i in range(1, len(w)) if w[:i] in rank and w[i:] in rank]
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.ids = np.array([n for _, n in pairs], np.int32)
        self.split = regex.compile(PATTERN)
        self.cache: dict[str, np.ndarray] = {}

    @classmethod
    def of(cls, path: str) -> Bpe:
        """The worker's one instance for a vocabulary."""
        kept = sys.modules.setdefault("_swathline_vocabularies", types.ModuleType("_swathline_vocabularies"))
        if not hasattr(kept, "by_path"):
            kept.by_path = {}
        if path not in kept.by_path:
            kept.by_path[path] = cls(path)
        return kept.by_path[path]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of many words, and each word's number of ids."""
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        sym = self.byte[np.frombuffer(b"".join(raw), np.uint8)].astype(np.int64)
        word = np.repeat(np.arange(len(raw)), size)
        none = np.int64(1) << 40
        done_s, done_w = [], []
        while len(sym):
            key = sym[:-1] << 20 | sym[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ids[at], none)
            rank = np.append(rank, none)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            span = np.diff(np.append(first, len(sym)))
            least = np.repeat(best, span)
            over = least == none
            if over.any():
                done_s.append(sym[over])
                done_w.append(word[over])
                live = ~over
                sym, word, rank, least = sym[live], word[live], rank[live], least[live]
                if not len(sym):
                    break
            hit = rank == least
            # In a row of overlapping hits every other one merges, from the left.
            i = np.flatnonzero(hit)
            run = np.cumsum(np.append(True, np.diff(i) > 1)) - 1
            start = i[np.append(True, np.diff(i) > 1)]
            i = i[(i - start[run]) % 2 == 0]
            # Two hits side by side overlap only if they share a symbol, i.e. lie in one word.
            sym[i] = least[i]
            keep = np.ones(len(sym), bool)
            keep[i + 1] = False
            sym, word = sym[keep], word[keep]
        if not done_s:
            return np.zeros(0, np.int32), size
        sym, word = np.concatenate(done_s), np.concatenate(done_w)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.int32), np.bincount(word, minlength=len(raw))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a sequence of words, one after the other, and each word's number of ids."""
        seen: dict[str, int] = {}
        index = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
        fresh = [w for w in seen if w not in self.cache]
        if len(self.cache) + len(fresh) > CACHE_WORDS:
            self.cache.clear()
            fresh = list(seen)
        if fresh:
            flat, n = self.merge(fresh)
            ends = np.cumsum(n)
            for w, part in zip(fresh, np.split(flat, ends[:-1]), strict=True):
                self.cache[w] = part
        parts = [self.cache[w] for w in seen]
        size = np.array([len(p) for p in parts], np.int64)
        flat = np.concatenate(parts)
        start = np.cumsum(size) - size
        n = size[index]
        shift = np.repeat(start[index] - (np.cumsum(n) - n), n)
        return flat[shift + np.arange(len(shift))], n

    def encode_slices(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(text number, ids) pieces in order; a long text comes in several pieces."""
        words: list[str] = []
        marks: list[tuple[int, int]] = []

        def flush() -> Iterator[tuple[int, np.ndarray]]:
            ids, n = self.encode_words(words)
            ends = np.append(0, np.cumsum(n))
            a = 0
            for k, count in marks:
                yield k, ids[ends[a] : ends[a + count]]
                a += count
            words.clear()
            marks.clear()

        for k, t in enumerate(texts):
            if not t:
                continue
            if len(t) < SLICE_WORDS:
                found = self.split.findall(t)
                words += found
                marks.append((k, len(found)))
            else:
                n = 0
                for m in self.split.finditer(t):
                    words.append(m.group())
                    n += 1
                    if len(words) >= SLICE_WORDS:
                        marks.append((k, n))
                        yield from flush()
                        n = 0
                if n:
                    marks.append((k, n))
            if len(words) >= SLICE_WORDS:
                yield from flush()
        if words:
            yield from flush()


def _encode(path: str, count_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.of(path)
        for batch in batches:
            texts = batch.column(batch.schema.names.index("_text")).to_pylist()
            keep = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "_text"]
            names = [n for n in batch.schema.names if n != "_text"]
            total = np.zeros(len(texts), np.int64)
            pieces = []
            for k, ids in bpe.encode_slices(texts):
                total[k] += len(ids)
                if not count_only:
                    pieces.append(ids)
            if count_only:
                out = pa.array(total, pa.int64())
            else:
                values = pa.array(np.concatenate(pieces) if pieces else np.zeros(0, np.int32), pa.int32())
                out = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(total)).astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([*keep, out], [*names, "n_tokens" if count_only else "ids"])

    return run


def _kept(df: DataFrame, keep: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in keep)


def encode(df: DataFrame, keep: list[str], text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The kept columns and ``ids`` (array<int>), one row for each row."""
    rows = spread(df.select(*keep, df[text].alias("_text")))
    return rows.mapInArrow(_encode(vocabulary, False), _kept(df, keep) + ", ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The kept columns and ``n_tokens``, one row for each row."""
    rows = spread(df.select(*keep, df[text].alias("_text")))
    return rows.mapInArrow(_encode(vocabulary, True), _kept(df, keep) + ", n_tokens bigint")
