"""Best-two-fit packing: documents into token sequences of fixed length.

The plan is made on the histogram of piece lengths, which has at most ``capacity`` entries whatever the corpus: a bin is
filled greedily with the longest pieces that still fit; then its smallest piece is replaced with two unpacked ones that fit
the expanded gap more tightly, as long as such pairs exist. A bin's pattern is repeated as often as the histogram allows, so
the plan has few rows and pieces find their places by their rank among the pieces of their length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import UnitCache, columns_of, in_slices, ship, shuffle_partitions
from seriesloom.sources.artifacts import settle

CAPACITY = 2048
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BEYOND_LATIN = re.compile("[^\x00-ɏ‐-‧€]")
SPACE_AFTER_SPACE = re.compile(r"\s ")
UNIT_START = re.compile(r"(?<=\S)(?= )")


class ByteBpe:
    """Token ids of whole texts as little-endian 32-bit words, equal to the tokenizers library's for the same vocabulary file.

    A blank after a visible character always starts a new token, so a text is cut there and the ids of each unit are
    kept. A text that holds an added token goes to the tokenizers library as a whole. Units within Latin script go to tiktoken, which has the same vocabulary as ranks and is faster; all others go to
    the tokenizers library, so that differences between the libraries' Unicode tables can't matter.
    """

    def __init__(self, path: str | None = None):
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = path or public_tokenizers.path("byte_bpe_50k.json")
        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        printable = self._byte_characters()
        special = {t["content"] for t in stated.get("added_tokens", [])}
        self.added = sorted(special)
        ranks = {bytes(printable[c] for c in t): i for t, i in stated["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first = UnitCache(self._encode, 50_000)
        self.later = UnitCache(lambda unit: self._encode(" " + unit))

    @staticmethod
    def _byte_characters() -> dict[str, int]:
        """The published byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        out, n = {chr(b): b for b in plain}, 0
        for b in range(256):
            if b not in plain:
                out[chr(256 + n)] = b
                n += 1
        return out

    def _encode(self, unit: str) -> bytes:
        ids = self.slow.encode(unit, add_special_tokens=False).ids if BEYOND_LATIN.search(unit) else self.fast.encode_ordinary(unit)
        return np.array(ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if any(content in text for content in self.added):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if SPACE_AFTER_SPACE.search(text):
            units = UNIT_START.split(text)
            return b"".join([self.first[units[0]], *[self.later[u[1:]] for u in units[1:]]])
        units = text.split(" ")
        head = units[0]
        if not head:  # the text starts with a blank
            return b"".join(map(self.later.__getitem__, units[1:]))
        return b"".join([self.first[head], *map(self.later.__getitem__, units[1:])])


_bpe: dict[str | None, ByteBpe] = {}


def byte_bpe(path: str | None) -> ByteBpe:
    """One encoder per worker process and vocabulary file."""
    if path not in _bpe:
        _bpe[path] = ByteBpe(path)
    return _bpe[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(
    docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer_path: str | None = None, with_ids: bool = False
) -> DataFrame:
    """One row per piece of each document's ids followed by ``end_id``; ``with_ids`` adds the ids themselves.

    A null text is an empty one and gives the end id alone. Repeated rows are packed as often as they come.
    """
    ship(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = PIECES + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer_path)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = bpe.ids(text or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(out, (doc, k, start, length, zlib.crc32(own), own if with_ids else None)):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            use = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(out[i], kinds[i]) for i in range(use)], names[:use])

    return columns_of(docs, "doc_id", "text").mapInArrow(run, schema)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, last rank + 1, pieces per bin, first bin, offset) for a histogram of piece lengths.

    At most 63 different lengths share a bin and each pattern uses up at least one length or leaves less of it than the
    bin takes, so the plan is bounded by the capacity, not by the corpus.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    used = np.zeros(capacity + 1, dtype=np.int64)
    slots, bins = [], 0

    def longest(limit: int, own: dict[int, int]) -> int:
        while limit > 0:
            have = np.flatnonzero(left[1 : limit + 1])
            if not len(have):
                return 0
            length = int(have[-1]) + 1
            if left[length] > own.get(length, 0):
                return length
            limit = length - 1
        return 0

    def best_two(room: int, above: int, own: dict[int, int]) -> tuple[int, int] | None:
        """Two unpacked pieces whose sum is largest, over ``above`` and at most ``room``."""
        free = left.copy()
        for length, n in own.items():
            free[length] -= n
        have = np.flatnonzero(free[: room + 1] > 0)
        if not len(have):
            return None
        at = np.searchsorted(have, room - have, side="right") - 1
        other = np.where(at >= 0, have[np.maximum(at, 0)], -capacity * 2)
        same = (other == have) & (free[have] < 2)
        before = np.where(at >= 1, have[np.maximum(at - 1, 0)], -capacity * 2)
        sums = have + np.where(same, before, other)
        k = int(np.argmax(sums))
        if sums[k] <= above:
            return None
        return int(have[k]), int(sums[k] - have[k])

    while (seed := longest(capacity, {})) > 0:
        own, gap = {seed: 1}, capacity - seed
        while gap > 0 and (length := longest(gap, own)) > 0:
            own[length] = own.get(length, 0) + 1
            gap -= length
        while gap > 0:
            small = min(own)
            rest = dict(own)
            rest[small] -= 1
            pair = best_two(gap + small, small, own)
            if pair is None:
                break
            for length in pair:
                rest[length] = rest.get(length, 0) + 1
            own = {k: v for k, v in rest.items() if v}
            gap = capacity - sum(k * v for k, v in own.items())
        times = min(int(left[k]) // v for k, v in own.items())
        offset = 0
        for length, each in sorted(own.items(), reverse=True):
            first = int(used[length])
            slots.append((length, first, first + times * each, each, bins, offset))
            used[length] += times * each
            left[length] -= times * each
            offset += length * each
        bins += times
    return slots


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to settled pieces that have ``doc_id, piece, length``."""
    spark = pieces.sparkSession
    ship(spark)
    parts = shuffle_partitions(spark)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = np.array(sorted(plan_bins(counts, capacity)), dtype=np.int64).reshape(-1, 6)
    total = sum(counts.values())
    slices = {k: in_slices(total, n, parts) for k, n in counts.items()}
    hot = [F.when(F.col("length") == k, F.lit(n)) for k, n in slices.items() if n > 1]
    cutter = F.coalesce(*hot, F.lit(1)) if hot else F.lit(1)
    cutd = pieces.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece"), cutter).cast("int"))
    sizes = cutd.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_slice").orderBy("doc_id", "piece")
    ranked = (
        cutd.withColumn("_rank", F.row_number().over(inside))
        .join(starts, ["length", "_slice"])
        .withColumn("_rank", F.col("_rank") - 1 + F.col("_before"))
        .select(*pieces.columns, "_rank")
    )
    names = pieces.columns
    at = names.index("length")
    key = slots[:, 0] << np.int64(48) | slots[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(at).to_numpy(zero_copy_only=False)
            rank = batch.column(len(names)).to_numpy(zero_copy_only=False)
            slot = slots[np.searchsorted(key, length << np.int64(48) | rank, side="right") - 1]
            nth = rank - slot[:, 1]
            sequence = slot[:, 4] + nth // slot[:, 3]
            offset = slot[:, 5] + nth % slot[:, 3] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def best_two_fit(
    docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer_path: str | None = None, with_ids: bool = False
) -> DataFrame:
    """Pack all documents: a row per piece with its place. An empty table gives no rows; other columns are ignored."""
    pieces, _ = settle(token_pieces(docs, capacity, end_id, tokenizer_path, with_ids), "pieces")
    return place(pieces, capacity)
