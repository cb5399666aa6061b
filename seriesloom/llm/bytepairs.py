"""Byte-pair encoding and decoding with a contiguous rank array per word.

A word's bytes are its first parts. Beside the parts lies one array with the rank of joining each part to its right
neighbour. The smallest rank is looked for by scanning, the boundary between its two parts is deleted, and the ranks left
and right of the new part are looked up again, until no rank is left. For short words the scan of a small array beats any
pointer structure. Words over ``SHORT`` bytes, where scanning would cost the square of their length, keep their parts in
linked places and the ranks in a heap; both give the same ids.

Words come from the vocabulary file's own cut: text of Latin script by the published pattern, all other text by the
library's cutter, so that differences between Unicode tables can't matter.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import UnitCache, columns_of, ship
from seriesloom.llm.packing import BEYOND_LATIN, SPACE_AFTER_SPACE, UNIT_START, ByteBpe

SHORT = 96
"""bytes of a word up to which its ranks are scanned"""
NO_RANK = 1 << 60
FLUSH_BYTES = 8 << 20
"""bytes of ids and decoded text that a task holds before it hands them on"""


class RankArray:
    """Ids of texts and texts of ids for one vocabulary file."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        from tokenizers import Tokenizer

        path = path or public_tokenizers.path("byte_bpe_50k.json")
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        alphabet = ByteBpe._byte_characters()
        vocabulary: dict[str, int] = stated["model"]["vocab"]
        added = {t["content"]: t["id"] for t in stated.get("added_tokens", [])}
        self.added = {content: np.array([i], "<u4").tobytes() for content, i in added.items()}
        self.added_split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        size = 1 + max([*vocabulary.values(), *added.values()])
        self.body = [b""] * size
        for token, i in vocabulary.items():
            self.body[i] = bytes(alphabet[c] for c in token)
        for content, i in added.items():
            self.body[i] = content.encode()
        self.first_part = [0] * 256
        for character, byte in alphabet.items():
            self.first_part[byte] = vocabulary[character]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for a, b in stated["model"]["merges"]:
            self.rank[vocabulary[a], vocabulary[b]] = len(self.made)
            self.made.append(vocabulary[a + b])
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.cutter = Tokenizer.from_file(path).pre_tokenizer
        self.first = UnitCache(self._unit, 50_000)
        self.later = UnitCache(lambda rest: self._unit(" " + rest))

    def merged(self, word: bytes) -> list[int]:
        """Parts of a short word after all joins."""
        parts = [self.first_part[b] for b in word]
        rank_of = self.rank.get
        ranks = [rank_of(pair, NO_RANK) for pair in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) != NO_RANK:
            at = ranks.index(low)
            parts[at] = self.made[low]
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank_of((parts[at], parts[at + 1]), NO_RANK)
            if at:
                ranks[at - 1] = rank_of((parts[at - 1], parts[at]), NO_RANK)
        return parts

    def merged_long(self, word: bytes) -> list[int]:
        """The same for a word of any length: the leftmost of the smallest ranks comes from a heap."""
        parts = [self.first_part[b] for b in word]
        n = len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        waiting = [(r, k) for k, pair in enumerate(zip(parts, parts[1:])) if (r := self.rank.get(pair)) is not None]
        heapq.heapify(waiting)
        while waiting:
            rank, at = heapq.heappop(waiting)
            after = right[at]
            if parts[at] < 0 or after >= n or self.rank.get((parts[at], parts[after])) != rank:
                continue  # one of its two parts has been joined since
            parts[at], parts[after] = self.made[rank], -1
            right[at] = beyond = right[after]
            if beyond < n:
                left[beyond] = at
                if (r := self.rank.get((parts[at], parts[beyond]))) is not None:
                    heapq.heappush(waiting, (r, at))
            if (before := left[at]) >= 0 and (r := self.rank.get((parts[before], parts[at]))) is not None:
                heapq.heappush(waiting, (r, before))
        return [p for p in parts if p >= 0]

    def _words(self, unit: str) -> Iterable[bytes]:
        if not BEYOND_LATIN.search(unit):
            return (w.encode() for w in self.pattern.findall(unit))
        return (unit[a:b].encode() for _, (a, b) in self.cutter.pre_tokenize_str(unit))

    def _unit(self, unit: str) -> bytes:
        out: list[int] = []
        for word in self._words(unit):
            out += self.merged(word) if len(word) <= SHORT else self.merged_long(word)
        return np.array(out, "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        """Ids of a text without added tokens. A blank after a visible character starts a word, so units can be kept."""
        if not text:
            return b""
        if SPACE_AFTER_SPACE.search(text):
            head, *rest = UNIT_START.split(text)
            return self.first[head] + b"".join([self.later[u[1:]] for u in rest])
        head, *rest = text.split(" ")
        return (self.first[head] if head else b"") + b"".join(map(self.later.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids. Added tokens that stand in the text are found first, each as its own id."""
        if self.added_split is None or not any(content in text for content in self.added):
            return self._plain(text)
        return b"".join(self.added[p] if p in self.added else self._plain(p) for p in self.added_split.split(text))

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of ids; ids without a token are left out and broken characters are replaced."""
        body, size = self.body, len(self.body)
        each = np.frombuffer(ids, "<u4")
        if len(each) and int(each.max()) >= size:
            each = each[each < size]
        raw = b"".join(map(body.__getitem__, each.tolist()))
        return raw.decode("utf-8", "replace").encode()


_coders: dict[str | None, RankArray] = {}


def coder(path: str | None) -> RankArray:
    """One coder per worker process and vocabulary file."""
    if path not in _coders:
        _coders[path] = RankArray(path)
    return _coders[path]


def _flushed(rows: Iterable[tuple], kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if size >= FLUSH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


def encode(docs: DataFrame, tokenizer_path: str | None = None, decoded: bool = False) -> DataFrame:
    """``doc_id, ids`` per row: ids as little-endian unsigned 32-bit numbers; with ``decoded`` also the text that the ids
    decode to, made from the ids alone.

    Null and empty texts have no ids. Bytes that aren't UTF-8 count as replacement characters. Repeated rows come back
    repeated, ids of any type and null ids are kept, an empty table gives no rows, other columns are ignored. Rows go one by
    one, so a long text costs its own size.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(tokenizer_path)
        for batch in batches:
            def rows() -> Iterator[tuple]:
                for doc, text in zip(batch.column(0), batch.column(1)):
                    ids = own.encode((text.as_py() or b"").decode("utf-8", "replace"))
                    yield (doc.as_py(), ids, own.decode(ids)) if decoded else (doc.as_py(), ids)

            names = ["doc_id", "ids", "decoded"][: 3 if decoded else 2]
            yield from _flushed(rows(), [batch.column(0).type, pa.binary(), pa.binary()], names)

    texts = columns_of(docs, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, ids binary" + (", decoded binary" if decoded else ""))


def decode(encoded: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, ids``, the inverse of :func:`encode`; null ids give an empty text."""
    ship(encoded.sparkSession)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(tokenizer_path)
        for batch in batches:
            rows = ((doc.as_py(), own.decode(ids.as_py() or b"")) for doc, ids in zip(batch.column(0), batch.column(1)))
            yield from _flushed(rows, [batch.column(0).type, pa.binary()], ["doc_id", "text"])

    raw = columns_of(encoded, "doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text binary")
    return raw.select("doc_id", F.col("text").cast("string").alias("text"))


def digest(coded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of ``encode(…, decoded=True)``."""
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
