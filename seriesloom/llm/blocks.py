"""Substring dedup with fixed-block anchors: words covered by windows that occur elsewhere are removed.

Each document's words are cut into blocks that don't overlap. The blocks are the index; every rolling window of a block's
length of every document probes it. A window of ``2 * block - 1`` words holds a whole block wherever it starts, so only
windows around a block that was met again can be repeated; those hits are extended by comparing the whole windows, and
neighbouring repeated windows join to maximal repeats.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import columns_of, mix64
from seriesloom.llm.exchange import SENT, Chunk, Round, bucket_bits, covered, in_chunks, replies

WINDOW = 35
CHUNK_BYTES = 2 << 20
BYTE_SYMBOLS = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256, dtype=np.uint64)
OUT = "doc_id {id}, n_words long, n_removed long, kept binary"
PLACE = np.uint64(0xD6E8FEB86659FD93)
WORDS_AT_ONCE = 1 << 12
"""words whose bytes are mixed together, so that they stay in cache and a worker small"""


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words that don't overlap: every byte is mixed with its place before the sum.

    A sum of powers modulo 2**64 would take long words of two letters in the Thue-Morse order and its mirror for equal.
    """
    out = np.zeros(len(starts), np.uint64)
    for low in range(0, len(starts), WORDS_AT_ONCE):
        some = slice(low, low + WORDS_AT_ONCE)
        sizes = ends[some] - starts[some]
        first = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum()))
        mixed = BYTE_SYMBOLS[data[place + np.repeat(starts[some] - first, sizes)]]
        place -= np.repeat(first, sizes)
        mixed += place.view(np.uint64) * PLACE
        out[some] = np.add.reduceat(mix64(mixed), first)
    return mix64(out)


class Runs:
    """Hashes of all runs of so many symbols. Lengths double, and each pair of halves is mixed."""

    def __init__(self, symbols: np.ndarray):
        self.names = {1: symbols}

    @staticmethod
    def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return mix64(first * np.uint64(0x9E3779B97F4A7C15) ^ second)

    def windows(self, width: int) -> np.ndarray:
        """Hash of the run of ``width`` symbols from each place on where it fits."""
        size = 1
        if len(self.names[1]) < width:
            return np.zeros(0, np.uint64)
        while 2 * size <= width:
            if 2 * size not in self.names:
                half = self.names[size]
                self.names[2 * size] = self._pair(half[:-size], half[size:])
            size *= 2
        names = self.names[size]
        return names if size == width else self._pair(names[: len(names) - (width - size)], names[width - size :] + np.uint64(width))

    def at(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Hashes of runs of several lengths."""
        out = np.zeros(len(starts), np.uint64)
        for size in np.unique(sizes).tolist():
            own = sizes == size
            out[own] = self.windows(size)[starts[own]]
        return out


class Words:
    """Words of a chunk, as hashes in one sequence, with the document of each."""

    def __init__(self, chunk: Chunk):
        data, offsets = chunk.bytes, chunk.offsets
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
        after = np.concatenate([inside[1:], [False]]) if len(data) else inside
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.n = len(starts)
        self.hashes = word_hashes(data, starts, ends)
        self.first = np.searchsorted(starts, offsets)  # of each document; the last entry is the end
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.runs = Runs(self.hashes)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where a window of that many words lies in one document, and its hashes."""
        if self.n < width:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        fits = self.doc[width - 1 :] == self.doc[: self.n - width + 1]
        at = np.flatnonzero(fits)
        return at, self.runs.windows(width)[at]


def _indexed(words: Words, at: np.ndarray, block: int) -> np.ndarray:
    """Which windows are blocks of the index: those that start at a multiple of the block length in their document."""
    return (at - words.first[words.doc[at]]) % block == 0 if len(at) else np.zeros(0, bool)


def _candidates(words: Words, block: int, window: int, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that hold a block which was met again."""
    at, hashes = words.windows(window)
    if not len(live):
        return at[:0], hashes[:0]
    near = covered(np.maximum(live - (window - block), 0), window - block + 1, words.n)
    # a start before the document's own first word can't fit, so marks that spill over from the next document do no harm
    mine = near[at]
    return at[mine], hashes[mine]


def repeated_words(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` per row: the words outside repeated windows, joined by one space (binary UTF-8).

    A null text has no words. A repeated row is a copy like any other, so its windows are repeated. Windows never cross
    documents. Windows are compared by 64-bit hashes; blocks by fewer bits, where a false hit only costs a comparison.
    """
    docs = columns_of(docs, "doc_id", "text")
    block = (window + 1) // 2
    dealt, total = in_chunks(docs, chunk_bytes)
    probe, extend = Round(1, bucket_bits(total / 6, 4), 4), Round(2, bucket_bits(total / 12, 8), 8)

    def emit_probes(key: tuple, rows: pa.Table) -> pa.Table:
        words = Words(Chunk(rows))
        at, hashes = words.windows(block)
        return pa.Table.from_batches([probe.question(key[0].as_py(), hashes, _indexed(words, at, block))])

    def live_blocks(words: Words, reply: pa.Table) -> np.ndarray:
        at, hashes = words.windows(block)
        asked = _indexed(words, at, block)
        return at[asked][probe.answers(hashes, asked, reply)]

    def emit_windows(key: tuple, rows: pa.Table, reply: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.Table.from_batches([extend.question(0, np.zeros(0, np.uint64))])
        words = Words(Chunk(rows))
        _, hashes = _candidates(words, block, window, live_blocks(words, reply))
        return pa.Table.from_batches([extend.question(key[0].as_py(), hashes)])

    def finish(rows: pa.Table, reply: pa.Table) -> Iterator[pa.RecordBatch]:
        chunk = Chunk(rows)
        words = Words(chunk)
        at, hashes = _candidates(words, block, window, live_blocks(words, reply))
        gone = covered(at[extend.answers(hashes, None, reply)], window, words.n)
        removed = np.add.reduceat(np.append(gone, False).astype(np.int64), words.first[:-1]) if words.n else np.zeros(len(words.first) - 1, np.int64)
        removed[np.diff(words.first) == 0] = 0
        kept = []
        for k, text in enumerate(chunk.texts()):
            own = text.split()
            if removed[k]:
                own = itertools.compress(own, ~gone[words.first[k] : words.first[k + 1]])
            kept.append(b" ".join(own))
        return pa.table({"doc_id": chunk.doc_ids, "n_words": pa.array(np.diff(words.first).astype(np.int64)), "n_removed": pa.array(removed), "kept": pa.array(kept, pa.binary())})

    schema = OUT.format(id=docs.schema["doc_id"].dataType.simpleString())
    first = probe.ask(dealt.groupBy("chunk").applyInArrow(emit_probes, SENT))
    second = extend.ask(dealt.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(emit_windows, SENT))
    told = replies([first, second])
    return dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(finish, schema)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
