"""Finding hashes that occur more than once in a corpus, with documents dealt out in chunks.

A chunk sends the distinct hashes of its documents to the buckets that own them, packed into one binary value per bucket,
and gets back one bit per hash: whether it occurs again, in this chunk or another. Equal hashes are merged before they
are shuffled, so the commonest one arrives once per chunk. Chunks and buckets have a bounded size, whatever the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import mix64, ship, shuffle_partitions, sized

PARTITION_BYTES = 128 << 20
"""text in one partition at most, about"""
SENT = "bucket long, chunk long, keys binary, again binary, asked binary"
ANSWER = "chunk long, round int, bucket long, bits binary"
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, INVERSE):
        p = np.full(1 << bits, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64."""
    a, b = _powers(max(16, n.bit_length()))
    return a[:n], b[:n]


class Rolling:
    """Hashes of all runs of symbols of a sequence, from one prefix sum."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(symbols * up[:n], out=self.sums[1:])

    def windows(self, width: int) -> np.ndarray:
        """Hash of the run of ``width`` symbols from each place on where it fits."""
        if len(self.sums) <= width:
            return np.zeros(0, dtype=np.uint64)
        n = len(self.sums) - width
        return mix64((self.sums[width:] - self.sums[:n]) * self.down[:n])

    def at(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a run of ``width`` from one of the starts on."""
    steps = np.zeros(n + 1, dtype=np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + width, n), -1)
    return np.cumsum(steps[:n]) > 0


class Chunk:
    """Texts of a chunk as one byte buffer. Rows are put in an order of their own, so that a task that runs again agrees."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        ids, texts = rows.column("doc_id"), rows.column("text")
        self.table = rows
        text = (texts.chunk(0) if texts.num_chunks else pa.array([], pa.binary())).cast(pa.large_binary())
        self.doc_ids = ids
        if text.null_count:
            text = text.fill_null(b"")
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        raw = text.buffers()[2] if len(text) else None
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        self.bytes = data[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]

    def texts(self) -> Iterator[bytes]:
        whole = self.bytes.tobytes()
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist()):
            yield whole[a:b]


def in_chunks(docs: DataFrame, chunk_bytes: int, carry: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """``doc_id, text, chunk`` dealt out by chunk, with the columns of ``carry`` in a struct ``carried``; and the bytes of all
    texts. Rows are dealt by id and text together."""
    ship(docs.sparkSession)
    _, total = sized(docs)
    chunks = max(1, math.ceil(total / chunk_bytes))
    at = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk")
    carried = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    dealt = docs.select("doc_id", F.col("text").cast("binary").alias("text"), at, *carried)
    partitions = max(shuffle_partitions(docs.sparkSession), math.ceil(total / PARTITION_BYTES))
    return dealt.repartition(partitions, "chunk"), total


def bucket_bits(keys: float, key_bytes: int, bucket_bytes: int = 2 << 20, least: int = 6) -> int:
    """Bits of the bucket number, so that a bucket gets about ``bucket_bytes`` of keys."""
    return max(least, math.ceil(math.log2(max(1.0, keys * key_bytes / bucket_bytes))))


class Round:
    """One question to the buckets: a name, the bits of the bucket number, and how many bytes of a hash are sent (3, 4 or 8).

    Three or four bytes besides the bucket are enough where false hits only cost work.
    """

    def __init__(self, number: int, bits: int, key_bytes: int):
        self.number, self.bits, self.key_bytes = number, bits, key_bytes

    def reduced(self, hashes: np.ndarray) -> np.ndarray:
        return hashes if self.key_bytes == 8 else hashes >> np.uint64(64 - 8 * self.key_bytes - self.bits)

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return keys >> np.uint64(64 - self.bits if self.key_bytes == 8 else 8 * self.key_bytes)

    def packed(self, keys: np.ndarray) -> bytes:
        """The low bytes of each key, one key after the other."""
        return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.key_bytes].tobytes()

    def unpacked(self, sent: bytes) -> np.ndarray:
        if self.key_bytes != 3:
            return np.frombuffer(sent, f"<u{self.key_bytes}")
        out = np.zeros((len(sent) // 3, 4), np.uint8)
        out[:, :3] = np.frombuffer(sent, np.uint8).reshape(-1, 3)
        return out.view("<u4").ravel()

    def question(self, chunk: int, hashes: np.ndarray, asked: np.ndarray | None = None) -> pa.RecordBatch:
        """Rows for the buckets; ``asked`` marks hashes whose answer is wanted (all, if None)."""
        reduced = self.reduced(hashes)
        keys, counts = np.unique(reduced, return_counts=True)
        wanted = np.ones(len(keys), bool) if asked is None else np.isin(keys, reduced[asked])
        rows: list[tuple] = []
        if len(keys):
            bucket = self._bucket(keys)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                rows.append(
                    (int(bucket[a]), chunk, self.packed(keys[a:b]), np.packbits(counts[a:b] > 1).tobytes(), np.packbits(wanted[a:b]).tobytes())
                )
        columns = list(zip(*rows)) if rows else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["bucket", "chunk", "keys", "again", "asked"])

    def resolve(self) -> Callable[[pa.Table], pa.Table]:
        """What a bucket does with its rows."""
        number, unpacked = self.number, self.unpacked

        def run(rows: pa.Table) -> pa.Table:
            keys = [unpacked(k) for k in rows.column("keys").to_pylist()]
            bit = lambda name: [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).astype(bool) for x, k in zip(rows.column(name).to_pylist(), keys)]
            again, asked = bit("again"), bit("asked")
            every = np.sort(np.concatenate(keys))
            repeated = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *[k[a] for k, a in zip(keys, again)]]))
            bits = []
            for k, q in zip(keys, asked):
                own = k[q]
                at = np.searchsorted(repeated, own)
                hit = np.zeros(len(own), bool)
                inside = at < len(repeated)
                hit[inside] = repeated[at[inside]] == own[inside]
                bits.append(np.packbits(hit).tobytes())
            n = rows.num_rows
            return pa.table({"chunk": rows.column("chunk"), "round": pa.array([number] * n, pa.int32()), "bucket": rows.column("bucket"), "bits": pa.array(bits, pa.binary())})

        return run

    def ask(self, sent: DataFrame) -> DataFrame:
        return sent.groupBy("bucket").applyInArrow(self.resolve(), ANSWER)

    def answers(self, hashes: np.ndarray, asked: np.ndarray | None, reply: pa.Table) -> np.ndarray:
        """Whether each asked hash occurs again, from the bits that came back for this chunk."""
        wanted = hashes if asked is None else hashes[asked]
        if not len(wanted):
            return np.zeros(0, bool)
        reduced = self.reduced(wanted)
        keys = np.unique(reduced)
        bucket = self._bucket(keys)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        own = {r["bucket"]: r["bits"] for r in reply.to_pylist() if r["round"] == self.number}
        hit = np.zeros(len(keys), bool)
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            hit[a:b] = np.unpackbits(np.frombuffer(own[int(bucket[a])], np.uint8), count=b - a)
        return hit[np.searchsorted(keys, reduced)]


def replies(rounds: Iterable[DataFrame]) -> DataFrame:
    out = None
    for r in rounds:
        out = r if out is None else out.unionByName(r)
    return out
