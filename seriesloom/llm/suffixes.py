"""Suffix-array dedup by distributed prefix doubling: bytes covered by long strings that occur elsewhere are removed.

Positions of a suffix array get a rank for their first ``h`` bytes; positions whose rank is unique are settled, the others
are ranked by pairs of ranks at a growing offset until they are unique or the threshold is passed. Ranks are names here
(hashes that buckets sort): which positions share a name matters, the order between different names doesn't.

Not every position has to be ranked from the start. The smallest ``h``-byte name inside a string of the threshold's length
is in the same place in every equal string, so it stands for the string; such minima are about two in ``threshold - h``
positions.

1. Minima are ranked by pairs: their own ``h`` bytes, and all bytes that strings they stand for can reach. A unique first
   rank settles all those strings as unique; a pair that is met again settles them as repeated.
2. What is left stands at the ends of repeats. Its strings are ranked with all ``threshold`` bytes, as the pair of the ranks
   of their halves, against the same strings of one holder of each settled pair with the same first rank.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.blocks import BYTE_SYMBOLS
from seriesloom.llm.common import columns_of, mix64
from seriesloom.llm.exchange import ANSWER, SENT, Chunk, Rolling, Round, bucket_bits, in_chunks, replies

THRESHOLD = 200
CHUNK_BYTES = 1 << 19
PLACE_BITS = 24
PAIRS = "bucket long, chunk long, names binary, reaches binary, again binary"
OUT = "doc_id {id}, n_bytes long, n_removed long, kept binary, spans array<struct<start:bigint,end:bigint>>"
UNIQUE, SETTLED, HOLDER, OPEN = range(4)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values; runs that would pass the end are left out."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All integers of the ranges ``first .. last``, one range after the other."""
    sizes = last - first + 1
    if not len(sizes):
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) + np.repeat(first - (ends - sizes), sizes)


class Minima:
    """The minima of a chunk (places of the smallest name of some string), with the range of strings each stands for."""

    def __init__(self, chunk: Chunk, threshold: int, h: int):
        self.n, self.threshold, self.h, offsets = len(chunk.bytes), threshold, h, chunk.offsets
        self.rolling = Rolling(BYTE_SYMBOLS[chunk.bytes])
        fits = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(self.n) >= threshold
        starts = np.flatnonzero(fits)
        bits = max(PLACE_BITS, self.n.bit_length())
        place = np.uint64((1 << bits) - 1)
        names = self.rolling.windows(h)
        marked = (names & ~place) | np.arange(len(names), dtype=np.uint64)
        owner = (sliding_min(marked, threshold - h + 1)[starts] & place).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1])])) if len(owner) else np.zeros(0, np.int64)
        self.at = owner[new]
        self.names = names[self.at]
        self.first, self.last = starts[new], starts[np.append(new[1:], len(starts)) - 1] if len(new) else starts
        doc = np.searchsorted(offsets, self.at, side="right") - 1
        low = np.maximum(self.at - (threshold - h), offsets[doc])
        high = np.minimum(self.at + threshold, offsets[doc + 1])
        cut = (self.at - low).astype(np.uint64) << np.uint64(32) | (high - self.at).astype(np.uint64)
        self.reaches = mix64(self.rolling.at(low, high) + mix64(cut))

    def ranks(self, at: np.ndarray) -> np.ndarray:
        """Names of ``threshold`` bytes from each place on: pairs of the names of both halves (which overlap where it is odd)."""
        half = (self.threshold + 1) // 2
        first, second = self.rolling.at(at, at + half), self.rolling.at(at + self.threshold - half, at + self.threshold)
        return mix64(first * np.uint64(0x9E3779B97F4A7C15) ^ (second + np.uint64(self.threshold)))


class PairRound:
    """Buckets own first ranks (shortened: a false hit only opens a pair that would be settled) and sort pairs."""

    def __init__(self, bits: int):
        self.bits = bits

    def _pairs(self, minima: Minima) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs in order: shortened names with the bucket on top, reaches; and for each minimum its pair."""
        short = minima.names >> np.uint64(32 - self.bits)
        order = np.lexsort((minima.reaches, short))
        a, b = short[order], minima.reaches[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
        where = np.empty(len(a), np.int64)
        where[order] = np.cumsum(new) - 1
        return a[new], b[new], where

    @staticmethod
    def _cuts(short: np.ndarray) -> list[tuple[int, int]]:
        cut = (np.flatnonzero(np.diff(short >> np.uint64(32))) + 1).tolist()
        return list(zip([0, *cut], [*cut, len(short)])) if len(short) else []

    def question(self, chunk: int, minima: Minima) -> pa.Table:
        short, reaches, where = self._pairs(minima)
        again = np.bincount(where, minlength=len(short)) > 1
        rows = [
            (int(short[a] >> np.uint64(32)), chunk, short[a:b].astype(np.uint32).tobytes(), reaches[a:b].tobytes(), np.packbits(again[a:b]).tobytes())
            for a, b in self._cuts(short)
        ]
        columns = list(zip(*rows)) if rows else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "chunk", "names", "reaches", "again"])

    @staticmethod
    def resolve(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")  # the first chunk holds a settled pair, also when the task runs again
        names = [np.frombuffer(x, np.uint32) for x in rows.column("names").to_pylist()]
        sizes = [len(x) for x in names]
        again = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=k) for x, k in zip(rows.column("again").to_pylist(), sizes)])
        name, reach = np.concatenate(names), np.concatenate([np.frombuffer(x, np.uint64) for x in rows.column("reaches").to_pylist()])
        order = np.lexsort((reach, name))  # stable: chunks stay in order
        a, b = name[order], reach[order]
        new_name = np.concatenate([[True], a[1:] != a[:-1]])
        new_pair = new_name | np.concatenate([[True], b[1:] != b[:-1]])
        pair, group = np.cumsum(new_pair) - 1, np.cumsum(new_name) - 1
        met = np.bincount(pair, weights=1 + again[order]) > 1
        several = np.bincount(group, weights=new_pair) > 1
        code = np.where(met[pair], np.where(several[group] & new_pair, HOLDER, SETTLED), np.where(several[group], OPEN, UNIQUE))
        out = np.empty(len(order), np.uint8)
        out[order] = code
        ends = np.cumsum(sizes)
        bits = [out[e - k : e].tobytes() for e, k in zip(ends.tolist(), sizes)]
        return pa.table({"chunk": rows.column("chunk"), "round": pa.array([1] * len(sizes), pa.int32()), "bucket": rows.column("bucket"), "bits": pa.array(bits, pa.binary())})

    def answers(self, minima: Minima, reply: pa.Table) -> np.ndarray:
        short, _, where = self._pairs(minima)
        own = {r["bucket"]: r["bits"] for r in reply.to_pylist() if r["round"] == 1}
        codes = np.zeros(len(short), np.uint8)
        for a, b in self._cuts(short):
            codes[a:b] = np.frombuffer(own[int(short[a] >> np.uint64(32))], np.uint8)
        return codes[where]


def whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """The bytes to remove, without those of characters that aren't covered as a whole."""
    leads = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(leads):
        return gone
    full = np.logical_and.reduceat(gone, leads)
    return np.concatenate([gone[: leads[0]], np.repeat(full, np.diff(np.append(leads, len(data))))])


def repeated_bytes(docs: DataFrame, threshold: int = THRESHOLD, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, kept, spans`` per row; ``spans`` are the removed runs as byte offsets.

    A null text counts as an empty one. A repeated row is a copy like any other. Strings never cross documents. Whatever
    decides is compared by 64-bit names.
    """
    docs = columns_of(docs, "doc_id", "text")
    return _ranked(docs, threshold, chunk_bytes, (), OUT.format(id=docs.schema["doc_id"].dataType.simpleString()), _spans)


def without_repeats(docs: DataFrame, threshold: int = THRESHOLD, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of ``doc_id, text, n_chars`` and any others, without the characters that lie in repeats as a whole.

    ``n_chars`` is counted anew where the text changed. Null texts stay null; a text of nothing but repeats becomes empty.
    """
    names = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    kinds = ["doc_id", "text", *names]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kinds)

    def texts(chunk: Chunk, gone: np.ndarray) -> pa.Table:
        gone = whole_characters(chunk.bytes, gone)
        carried = chunk.table.column("carried").chunk(0)
        old, counts = chunk.table.column("text").to_pylist(), carried.field("n_chars").to_pylist()
        out = []
        for k, (a, b) in enumerate(zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist())):
            own = gone[a:b]
            text = None if old[k] is None else chunk.bytes[a:b][~own].tobytes().decode() if own.any() else old[k].decode()
            if own.any():
                counts[k] = len(text)
            out.append(text)
        columns = {"doc_id": chunk.doc_ids, "text": pa.array(out, pa.string())} | {c: carried.field(c) for c in names}
        columns["n_chars"] = pa.array(counts, carried.field("n_chars").type)
        return pa.table(columns)

    return _ranked(docs, threshold, chunk_bytes, names, schema, texts).select(*[F.col(f"`{c}`") for c in docs.columns])


def _spans(chunk: Chunk, gone: np.ndarray) -> pa.Table:
    kept, removed, spans = [], [], []
    cut = np.concatenate([[0], np.cumsum(gone)])
    whole = chunk.bytes.tobytes()
    for a, b in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist()):
        n = int(cut[b] - cut[a])
        removed.append(n)
        if not n:
            kept.append(whole[a:b])
            spans.append([])
            continue
        own = gone[a:b]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
        spans.append([{"start": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)])
        kept.append(chunk.bytes[a:b][~own].tobytes())
    return pa.table(
        {
            "doc_id": chunk.doc_ids,
            "n_bytes": pa.array(np.diff(chunk.offsets)),
            "n_removed": pa.array(removed, pa.int64()),
            "kept": pa.array(kept, pa.binary()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        }
    )


def _ranked(docs: DataFrame, threshold: int, chunk_bytes: int, carry: tuple[str, ...], schema: str, give: Callable[[Chunk, np.ndarray], pa.Table]) -> DataFrame:
    """Both rounds, then ``give`` for each chunk and the bytes that lie in repeats. The texts are dealt out once for all."""
    h = (threshold + 1) // 2
    dealt, total = in_chunks(docs, chunk_bytes, carry)
    pairs = PairRound(bucket_bits(2.0 * total / (threshold - h + 2), 12))
    strings = Round(2, bucket_bits(total / 8, 8), 8)

    def ask_pairs(key: tuple, rows: pa.Table) -> pa.Table:
        return pairs.question(key[0].as_py(), Minima(Chunk(rows), threshold, h))

    def open_strings(minima: Minima, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Strings to be ranked, and which of them aren't settled."""
        use = codes >= HOLDER
        at = runs(minima.first[use], minima.last[use])
        return at, np.repeat(codes[use] == OPEN, (minima.last - minima.first + 1)[use])

    def ask_strings(key: tuple, rows: pa.Table, reply: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.Table.from_batches([strings.question(0, np.zeros(0, np.uint64))])
        minima = Minima(Chunk(rows), threshold, h)
        at, wanted = open_strings(minima, pairs.answers(minima, reply))
        return pa.Table.from_batches([strings.question(key[0].as_py(), minima.ranks(at), wanted)])

    def finish(rows: pa.Table, reply: pa.Table) -> pa.Table:
        chunk = Chunk(rows)
        minima = Minima(chunk, threshold, h)
        codes = pairs.answers(minima, reply)
        at, wanted = open_strings(minima, codes)
        met = at[wanted][strings.answers(minima.ranks(at), wanted, reply)]
        settled = (codes == SETTLED) | (codes == HOLDER)
        steps = np.zeros(minima.n + 1, np.int64)
        for first, last in ((minima.first[settled], minima.last[settled]), (met, met)):
            np.add.at(steps, first, 1)
            np.add.at(steps, last + threshold, -1)
        gone = np.cumsum(steps[: minima.n]) > 0
        return give(chunk, gone)

    first = dealt.groupBy("chunk").applyInArrow(ask_pairs, PAIRS).groupBy("bucket").applyInArrow(PairRound.resolve, ANSWER)
    second = strings.ask(dealt.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(ask_strings, SENT))
    return dealt.groupBy("chunk").cogroup(replies([first, second]).groupBy("chunk")).applyInArrow(finish, schema)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
