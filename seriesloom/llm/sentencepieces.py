"""SentencePiece encoding and decoding with the tokenizers library as its backend.

The model file is a protobuf message; it is read here field by field and rebuilt as a tokenizers pipeline: normaliser,
metaspace marker, unigram scores or ranked merges, byte fallback. If no piece holds a marker after another character, no
piece can reach over the start of a word, so texts are cut there and the ids of each word are kept.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seriesloom.llm.common import columns_of, ship

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
KEEP = 400_000
UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message; fixed and variable numbers as integers, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        size = varint() if size is None else size
        body = message[at : at + size]
        at += size
        yield tag >> 3, body if kind == 2 else int.from_bytes(body, "little")


@dataclass(frozen=True)
class Model:
    pieces: list[str]
    scores: list[float]
    types: list[int]
    kind: int
    charsmap: bytes
    dummy_prefix: bool
    remove_extra: bool
    escape: bool
    byte_fallback: bool

    @property
    def unk_id(self) -> int:
        return self.types.index(UNKNOWN)


def read_model(path: str) -> Model:
    pieces, scores, types = [], [], []
    trainer, normaliser = {}, {}
    with open(path, "rb") as f:
        message = f.read()
    for number, value in fields(message):
        if number == 1:
            own = dict(fields(value))
            pieces.append(own.get(1, b"").decode())
            scores.append(struct.unpack("<f", own.get(2, 0).to_bytes(4, "little"))[0])
            types.append(own.get(3, NORMAL))
        elif number == 2:
            trainer = dict(fields(value))
        elif number == 3:
            normaliser = dict(fields(value))
    return Model(
        pieces, scores, types, trainer.get(3, UNIGRAM), normaliser.get(2, b""), bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)),
        bool(normaliser.get(5, 1)), bool(trainer.get(35, 0)) or BYTE in types,
    )


def _merges(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best score first."""
    known = {p: k for k, (p, t) in enumerate(zip(model.pieces, model.types)) if t in (NORMAL, USER)}
    out = []
    for piece, k in known.items():
        halves = [(known[piece[:i]], known[piece[i:]]) for i in range(1, len(piece)) if piece[:i] in known and piece[i:] in known]
        out += [(-model.scores[k], k, a, b) for a, b in halves]
    return [(model.pieces[a], model.pieces[b]) for _, _, a, b in sorted(out)]


def build(model: Model, normalise: bool = True):
    """The tokenizers pipeline; without ``normalise`` for units that carry their markers already."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    unk = model.pieces[model.unk_id]
    if model.kind == UNIGRAM:
        core = models.Unigram(list(zip(model.pieces, model.scores)), model.unk_id, model.byte_fallback)
    elif model.kind == BPE:
        vocabulary = {p: k for k, p in enumerate(model.pieces)}
        core = models.BPE(vocabulary, _merges(model), unk_token=unk, fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} has no counterpart in the tokenizers library")
    out = Tokenizer(core)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.remove_extra:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if steps and normalise:
        out.normalizer = normalizers.Sequence(steps)
    last = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *last])
    return out


class Codec:
    """Encodes and decodes texts of one model file within a worker process."""

    def __init__(self, path: str | None = None, threads: int = 2, verify: bool = True):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        self.model = read_model(path)
        self.whole, self.plain = build(self.model), build(self.model, normalise=False)
        words = [p for p, t in zip(self.model.pieces, self.model.types) if t in (NORMAL, USER)]
        self.by_unit = self.model.escape and not any(MARK in p.lstrip(MARK) for p in words)
        self.unit_parity = self.by_unit and self.model.dummy_prefix and not self.model.remove_extra and not self.model.charsmap
        self.bytes = [
            bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else b" \xe2\x81\x87 " if t == UNKNOWN else p.replace(MARK, " ").encode()
            for p, t in zip(self.model.pieces, self.model.types)
        ]
        self.library = None
        if verify:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known: dict[str, bytes] = {}
        self.unequal: set[str] = set()
        self.lossy: set[str] = set()

    def units(self, text: str) -> list[str]:
        """The normalised text in pieces that are encoded each by itself; its words without their marker if it is plain."""
        if not text:
            return []
        normal = self.whole.normalizer.normalize_str(text) if self.whole.normalizer else text
        return UNIT.findall(normal) if self.by_unit else [normal]

    def _plain(self, text: str) -> bool:
        """Whether blanks are single and inside, and the model changes nothing else: the usual case, cut without a search."""
        m = self.model
        return self.by_unit and m.dummy_prefix and not m.charsmap and "  " not in text and MARK not in text and text[:1] != " " and text[-1:] != " "

    def learn(self, units: set[str]) -> None:
        new = sorted(units)
        encoded = [e.ids for e in self.plain.encode_batch(new, add_special_tokens=False)]
        if self.library is not None:
            starts = [k for k, u in enumerate(new) if u.startswith(MARK) and MARK not in u[1:] and len(u) > 1] if self.by_unit and self.model.dummy_prefix else []
            for k, ids in zip(starts, self.library.encode([new[k][1:] for k in starts], num_threads=1)):
                if ids != encoded[k]:
                    self.unequal.add(new[k])
            behind = [k for k in sorted(set(range(len(new))) - set(starts)) if new[k].startswith(MARK)] if self.unit_parity else []
            ahead = self.plain.encode(MARK + "a", add_special_tokens=False).ids if behind else []
            for k, ids in zip(behind, self.library.encode(["a" + new[k].replace(MARK, " ") for k in behind], num_threads=1)):
                if ids != ahead + encoded[k]:  # bare and several markers are compared behind a letter
                    self.unequal.add(new[k])
        if len(self.known) + len(new) > KEEP:
            self.known = {}
        for unit, ids in zip(new, encoded):
            if b"".join([self.bytes[i] for i in ids]) != unit.replace(MARK, " ").encode():
                self.lossy.add(unit)
            self.known[unit] = np.array(ids, dtype="<u4").tobytes()

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[bytes, bool, bool | None]]:
        """Ids as little-endian 32-bit words, whether they decode to the normalised text, whether the library agrees: word by word
        where every unit was compared; as a whole under models that change blanks or characters. Null without the library."""
        cut, plain = [], []
        for text in texts:
            plain.append(not text or self.unit_parity or self._plain(text))
            if text and self._plain(text):
                cut.append((MARK + text.replace(" ", f" {MARK}")).split(" "))
            else:
                cut.append(self.units(text))
        for a in range(0, len(cut), 64):
            part = cut[a : a + 64]
            need = set().union(*map(set, part))
            new = need.difference(self.known)
            if new:
                self.learn(new)
                if not need <= self.known.keys():  # the store was emptied
                    self.learn(need.difference(self.known))
            for units, text, words_only in zip(part, texts[a : a + 64], plain[a : a + 64]):
                ids = b"".join(map(self.known.__getitem__, units))
                if words_only:
                    whole, equal = not self.lossy or self.lossy.isdisjoint(units), not self.unequal or self.unequal.isdisjoint(units)
                else:
                    whole = self.decode(ids) == self._spoken("".join(units))
                    equal = self.library is None or np.array(self.library.encode(text, num_threads=1), dtype="<u4").tobytes() == ids
                yield ids, whole, equal if self.library is not None else None

    def _spoken(self, normal: str) -> str:
        """A normalised text as decoding gives it: blanks for markers, without the one put before it."""
        out = normal.replace(MARK, " ")
        return out[1:] if self.model.dummy_prefix and out.startswith(" ") else out

    def decode(self, ids: bytes) -> str:
        out = b"".join([self.bytes[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode(errors="replace")
        return out[1:] if self.model.dummy_prefix and out.startswith(" ") else out


_codecs: dict[tuple, Codec] = {}


def codec(path: str | None, threads: int) -> Codec:
    if (path, threads) not in _codecs:
        _codecs[path, threads] = Codec(path, threads)
    return _codecs[path, threads]


def encode(docs: DataFrame, model_path: str | None = None, threads: int = 2, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, round_trip, parity`` per row, and the ids (binary) if asked for.

    ``round_trip``: the ids decode to the normalised text. ``parity``: the sentencepiece library gives the same ids, to every
    unit of the text, or to the text as a whole under models that change blanks or characters. Null and empty texts have no ids. Repeated rows come back repeated.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path, threads)
        for batch in batches:
            got = list(own.encode_batch([t or "" for t in batch.column(1).to_pylist()]))
            columns = [
                batch.column(0), pa.array([len(i) // 4 for i, _, _ in got], pa.int64()), pa.array([zlib.crc32(i) for i, _, _ in got], pa.int64()),
                pa.array([r for _, r, _ in got], pa.bool_()), pa.array([p for _, _, p in got], pa.bool_()),
            ]
            names = ["doc_id", "n_tokens", "ids_crc32", "round_trip", "parity"]
            if with_ids:
                columns, names = [*columns, pa.array([i for i, _, _ in got], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return columns_of(docs, "doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str | None = None, threads: int = 2) -> DataFrame:
    """``doc_id, text`` from rows ``doc_id, ids``; null ids give an empty text."""
    ship(encoded.sparkSession)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path, threads)
        for batch in batches:
            texts = [own.decode(i or b"") for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return columns_of(encoded, "doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
