"""Language identification of mixed texts: scripts narrow the candidates, Viterbi over per-word scores labels spans.

Every letter votes with its trigram (the letter and its neighbours in the word), hashed into a table of fixed size. A word's
score for a language is the sum over its letters; a change of language between words costs a penalty.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import columns_of, mix64, ship

TABLE_BITS = 15
PENALTY = 12.0
SCRIPT_SHARE = 0.01
"""a language is a candidate for words of scripts that make up at least this share of its letters"""
UNKNOWN = "und"
WORDS_AT_ONCE = 1_000_000
CHARS_AT_ONCE = 1 << 20
# First code points of ranges of scripts; a range reaches to the next one.
SCRIPTS = [
    (0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "devanagari"),
    (0x980, "bengali"), (0xA00, "other indic"), (0xE00, "thai"), (0xE80, "other south-east"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and its script."""
    letters = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    starts = np.array([s for s, _ in SCRIPTS])
    names = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS], np.uint8)
    return letters, names[np.searchsorted(starts, np.arange(sys.maxunicode + 1), side="right") - 1]


class Letters:
    """Letters of some texts one after the other: their buckets, scripts, and where texts and words begin."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts).lower() if texts else ""
        lengths = [len(t.lower()) for t in texts]
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter, script = _tables()
        letter = is_letter[code]
        at = np.flatnonzero(letter)
        padded = np.concatenate([[0], np.where(letter, code, 0), [0]]).astype(np.uint64)
        left, mid, right = padded[at], padded[at + 1], padded[at + 2]
        key = left << np.uint64(42) | mid << np.uint64(21) | right
        self.bucket = (mix64(key) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        self.script = script[code[at]]
        ends = np.cumsum(np.array(lengths, np.int64) + 1) if texts else np.zeros(0, np.int64)
        self.text_first = np.searchsorted(at, np.concatenate([[0], ends]))
        fresh = left == 0
        self.word_first = np.flatnonzero(fresh)
        self.words_before = np.searchsorted(self.word_first, self.text_first)


def _sub_batches(texts: list[str], order: np.ndarray, chars: int = CHARS_AT_ONCE) -> Iterator[np.ndarray]:
    held, n = [], 0
    for k in order.tolist():
        held.append(k)
        n += len(texts[k])
        if n >= chars:
            yield np.array(held)
            held, n = [], 0
    if held:
        yield np.array(held)


@dataclass(frozen=True)
class LanguageModel:
    names: list[str]
    weights: np.ndarray
    """log probability of each bucket (rows) for each language (columns)"""
    scripts: np.ndarray
    """whether a language is a candidate in a script (rows)"""


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def learn(training: DataFrame) -> LanguageModel:
    """Model from all rows ``text, lang``; null texts or languages teach nothing. Counts of letters are summed where the rows lie."""
    ship(training.sparkSession)
    size = 1 << TABLE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs) if x == lang]
                table = tables.setdefault(lang, np.zeros(size + len(SCRIPT_NAMES), np.int64))
                for part in _sub_batches(own, np.arange(len(own))):
                    letters = Letters([own[k] for k in part])
                    table[:size] += np.bincount(letters.bucket, minlength=size)
                    table[size:] += np.bincount(letters.script, minlength=len(SCRIPT_NAMES))
        for lang, table in tables.items():
            hit = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit), pa.string()), pa.array(hit, pa.int32()), pa.array(table[hit])], ["lang", "bucket", "n"])

    rows = training.where("text is not null and lang is not null").select("text", "lang")
    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counts.column("lang").to_pylist()))
    table = np.zeros((size + len(SCRIPT_NAMES), len(names)))
    columns = np.array([names.index(x) for x in counts.column("lang").to_pylist()], np.int64)
    table[counts.column("bucket").to_numpy(), columns] = counts.column("n").to_numpy()
    letters, scripts = table[:size], table[size:]
    weights = np.log((letters + 0.5) / (letters.sum(axis=0) + 0.5 * size)).astype(np.float32)
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    return LanguageModel(names, weights, share >= SCRIPT_SHARE)


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word. ``first``: where each sequence begins in ``scores``, and the end; longest sequences first.

    All sequences go forward together, one word at a time, and back the same way.
    """
    lengths = np.diff(first)
    kinds = scores.shape[1]
    stay = np.ones(scores.shape, bool)
    jump = np.zeros(len(scores), np.int16)
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # sequences longer than t
    best = np.zeros((len(lengths), kinds), np.float64)
    for t in range(steps):
        k = active[t]
        at = first[:k] + t
        if t:
            own = best[:k]
            top = own.argmax(axis=1)
            moved = own[np.arange(k), top] - penalty
            keep = own >= moved[:, None]
            stay[at], jump[at] = keep, top
            best[:k] = np.where(keep, own, moved[:, None]) + scores[at]
        else:
            best[:k] = scores[at]
    out = np.zeros(len(scores), np.int64)
    state = best.argmax(axis=1) if kinds else np.zeros(len(lengths), np.int64)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        out[at] = state[:k]
        state[:k] = np.where(stay[at, state[:k]], state[:k], jump[at])
    return out


def word_scores(letters: Letters, model: LanguageModel) -> np.ndarray:
    """Score of each word for each language; languages that don't use the script of its first letter are out, if any does."""
    if not len(letters.word_first):
        return np.zeros((0, len(model.names)))
    out = np.add.reduceat(model.weights[letters.bucket], letters.word_first, axis=0).astype(np.float64)
    allowed = model.scripts[letters.script[letters.word_first]]
    allowed |= ~allowed.any(axis=1, keepdims=True)
    out[~allowed] = -1e9
    return out


def predict(docs: DataFrame, model: LanguageModel, penalty: float = PENALTY, with_spans: bool = False) -> DataFrame:
    """``doc_id, lang_pred, score, n_spans`` per row: the language of most letters and its share of them.

    ``with_spans`` adds the spans as ``(first word, last word + 1, lang)``, words being runs of letters. A text that is null
    or has no letter is ``und`` with score 0 and no span, and so is every text if nothing was learned. Ties go to the
    first language by name.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang_pred string, score double, n_spans long"
    span = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])
    if with_spans:
        schema += ", spans array<struct<first:bigint,end:bigint,lang:string>>"
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_once = max(1, WORDS_AT_ONCE * 4 // max(4, len(model.names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = len(texts)
            labels, shares, counts, spans = [UNKNOWN] * n, np.zeros(n), np.zeros(n, np.int64), [[] for _ in range(n)]
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
            words = 0

            def settle() -> None:
                order = np.concatenate([h[0] for h in held])
                scores = np.concatenate([h[1] for h in held])
                sizes = np.concatenate([h[2] for h in held])
                weights = np.concatenate([h[3] for h in held])
                starts = np.concatenate([[0], np.cumsum(sizes)])
                by_length = np.argsort(-sizes, kind="stable")
                take = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in by_length]) if len(scores) else np.zeros(0, np.int64)
                first = np.concatenate([[0], np.cumsum(sizes[by_length])])
                path = viterbi(scores[take], first, penalty)
                weight = weights[take]
                doc = np.repeat(np.arange(len(by_length)), sizes[by_length])
                tally = np.zeros((len(by_length), len(own.names)))
                np.add.at(tally, (doc, path), weight)
                for row, k in enumerate(by_length.tolist()):
                    if not sizes[k]:
                        continue
                    at, mine = int(order[k]), path[first[row] : first[row + 1]]
                    top = int(tally[row].argmax())
                    labels[at], shares[at] = own.names[top], tally[row, top] / tally[row].sum()
                    cuts = np.flatnonzero(np.diff(mine)) + 1
                    counts[at] = len(cuts) + 1
                    if with_spans:
                        edges = [0, *cuts.tolist(), len(mine)]
                        spans[at] = [{"first": a, "end": b, "lang": own.names[int(mine[a])]} for a, b in zip(edges, edges[1:])]
                held.clear()

            if own.names:
                for part in _sub_batches(texts, np.argsort([-len(t) for t in texts], kind="stable")):
                    letters = Letters([texts[k] for k in part])
                    sizes = np.diff(letters.words_before)
                    weights = np.diff(np.append(letters.word_first, len(letters.bucket)))
                    held.append((part, word_scores(letters, own), sizes, weights))
                    words += len(weights)
                    if words >= at_once:
                        settle()
                        words = 0
                if held:
                    settle()
            columns = [batch.column(0), pa.array(labels, pa.string()), pa.array(shares), pa.array(counts)]
            names = ["doc_id", "lang_pred", "score", "n_spans"]
            if with_spans:
                columns, names = [*columns, pa.array(spans, pa.list_(span))], [*names, "spans"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return columns_of(docs, "doc_id", "text").mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that aren't held out, predict all."""
    docs = columns_of(docs, "doc_id", "text", "lang")
    model = learn(docs.where(~F.coalesce(held_out(), F.lit(False))))
    return predict(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "n_spans")
