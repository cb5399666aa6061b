"""Block anchors and suffix dedup against brute force."""

import hashlib
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from seriesloom.llm import blocks, exchange, jaccard, suffixes
from tests.llm.corpus import SCHEMA, corpus

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def covered(sequences, width):
    seen = Counter(tuple(s[i : i + width]) for s in sequences for i in range(len(s) - width + 1))
    for s in sequences:
        gone = np.zeros(len(s), bool)
        for i in range(len(s) - width + 1):
            if seen[tuple(s[i : i + width])] > 1:
                gone[i : i + width] = True
        yield gone


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


@pytest.mark.parametrize(("window", "chunk_bytes"), [(35, 1 << 20), (35, 3000), (6, 2000)])
def test_words_of_repeated_windows_go(spark, window, chunk_bytes):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    words = [WORD.findall(r[1] or "") for r in rows]
    want = Counter(
        (r[0], len(w), int(g.sum()), sha(" ".join(x for x, out in zip(w, g) if not out).encode())) for r, w, g in zip(rows, words, covered(words, window))
    )
    got = blocks.digest(blocks.repeated_words(docs, window, chunk_bytes)).collect()
    assert Counter(map(tuple, got)) == want


def mirrored(n: int, letters: str) -> list[str]:
    """The Thue-Morse order of two letters."""
    return [letters[bin(k).count("1") % 2] for k in range(n)]


@pytest.mark.parametrize(("window", "of_words"), [(35, False), (2048, True)])
def test_mirrored_orders_are_no_repeats(spark, window, of_words):
    """Long words, or windows, of two letters in an order that sums of powers modulo 2**64 can't tell from its mirror."""
    around = [f"w{k}" for k in range(40)]
    if of_words:
        texts = [" ".join(mirrored(window, letters)) for letters in ("ab", "ba")]
    else:
        texts = [" ".join([*around, "".join(mirrored(1024, letters)), *around[::-1]]) for letters in ("ab", "ba")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in blocks.digest(blocks.repeated_words(docs, window)).collect()}
    words = [t.split() for t in texts]
    want = {}
    for k, (own, gone) in enumerate(zip(words, covered(words, window))):
        want[k] = (len(own), int(gone.sum()), sha(" ".join(w for w, out in zip(own, gone) if not out).encode()))
    assert got == want


@pytest.mark.parametrize(("threshold", "chunk_bytes"), [(200, 1 << 20), (200, 5000), (31, 4000)])
def test_bytes_of_long_repeats_go(spark, threshold, chunk_bytes):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    texts = [(r[1] or "").encode() for r in rows]
    want = Counter()
    for r, t, g in zip(rows, texts, covered(texts, threshold)):
        edges = int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum())
        want[r[0], len(t), int(g.sum()), edges, sha(np.frombuffer(t, np.uint8)[~g].tobytes())] += 1
    got = suffixes.digest(suffixes.repeated_bytes(docs, threshold, chunk_bytes)).collect()
    assert Counter(map(tuple, got)) == want


def test_texts_without_repeats_stay_whole_characters(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    out = suffixes.without_repeats(docs)
    assert out.columns == docs.columns
    texts = [(r[1] or "").encode() for r in rows]
    gone = dict(zip([r[0] for r in rows], covered(texts, 200)))
    got = out.collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in rows}
    for r in got:
        if r.doc_id is None:
            continue
        old = by_id[r.doc_id]
        if old[1] is None:
            assert r.text is None
        elif not gone[r.doc_id].any():
            assert tuple(r) == old
        else:
            assert r.n_chars == len(r.text) < len(old[1])


@pytest.mark.parametrize(("key_bytes", "bits"), [(3, 6), (3, 14), (4, 6), (8, 6)])
def test_so_many_bytes_of_a_hash_are_sent(key_bytes, bits):
    hashes = np.random.default_rng(8).integers(0, 2**64, 5000, dtype=np.uint64)
    hashes = np.concatenate([hashes, hashes[:50], np.array([0, 2**64 - 1], np.uint64)])
    for ask in (exchange.Round(1, bits, key_bytes), jaccard.FrequencyRound(1, bits, key_bytes)):
        sent = pa.Table.from_batches([ask.question(0, hashes)])
        keys = np.unique(ask.reduced(hashes))
        assert sum(map(len, sent.column("keys").to_pylist())) == key_bytes * len(keys)
        assert np.concatenate([ask.unpacked(k) for k in sent.column("keys").to_pylist()]).tolist() == (keys & np.uint64((1 << 8 * key_bytes) - 1)).tolist()
        answered = pa.concat_tables([ask.resolve()(sent.filter(pc.equal(sent["bucket"], b))) for b in sent["bucket"].to_pylist()])
        met = ask.answers(hashes, None, answered) if type(ask) is exchange.Round else ask.classes(hashes, answered) > 0
        assert np.flatnonzero(met).tolist() == [*range(50), *range(5000, 5050)]


def test_words_of_a_chunk_need_little_memory():
    """Workers stay as large as their largest step was, and later steps find them so."""

    class Texts:
        bytes = np.frombuffer(b"some words " * (1 << 17), np.uint8)
        offsets = np.array([0, 500_000, len(bytes)])

    exchange._powers.cache_clear()
    tracemalloc.start()
    try:
        blocks.Words(Texts).windows(4)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 30 * len(Texts.bytes)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert blocks.repeated_words(docs).count() == 0
    assert suffixes.repeated_bytes(docs).count() == 0
