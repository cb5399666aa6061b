"""Token counts, sentence pieces and packing against the libraries and exact round trips."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models

from seriesloom.llm import packing, sentencepieces, wordpieces
from tests.llm.corpus import SCHEMA, corpus


@pytest.fixture(scope="module")
def bpe():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


ODD = ["", " ", "  a  b ", "\n\n x", "a b   c", "don't we'll  x", "<|endoftext|> end", "a <|endoftext|>", "x<|endoftext|><|endoftext|>  y", "Привет мир 你好 😀", "x́ é", " \t\n", "tab\t tab \n  two", "123 4567 ...!!"]


def test_ids_equal_the_tokenizers_library(bpe):
    own = packing.ByteBpe()
    for text in ODD + [r[1] for r in corpus() if r[1]]:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == bpe.encode(text, add_special_tokens=False).ids, text[:50]


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing_is_gapless_and_whole(spark, bpe, capacity):
    rows = corpus()
    got = packing.best_two_fit(spark.createDataFrame(rows, SCHEMA), capacity).collect()
    want = Counter()
    for r in rows:
        ids = [*bpe.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k, (start, n) in enumerate(packing.cut(len(ids), capacity)):
            want[r[0], k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in got)
    assert len(bins) <= 1.05 * total / capacity + 1


def test_two_pieces_take_the_place_of_the_smallest():
    # greedy gives 60 + 30; two unpacked pieces of 20 fit its gap of 10 with the place of 30 exactly
    slots = packing.plan_bins({60: 1, 30: 1, 20: 2}, 100)
    first = [s for s in slots if s[4] == 0]
    assert sum(s[0] * s[3] for s in first) == 100


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = {int(k): int(rng.integers(1, 500)) for k in rng.choice(np.arange(1, 257), 40, replace=False)}
    slots = packing.plan_bins(counts, 256)
    by = defaultdict(list)
    load = Counter()
    for length, first, end, each, bin_, offset in slots:
        by[length].append((first, end))
        for k in range(first, end):
            load[bin_ + (k - first) // each] += length
    assert {k: sum(b - a for a, b in v) for k, v in by.items()} == counts
    assert all(sorted(v)[0][0] == 0 and all(x[1] == y[0] for x, y in zip(sorted(v), sorted(v)[1:])) for v in by.values())
    assert max(load.values()) <= 256
    halves = sum(n for k, n in counts.items() if k > 128)  # no two of these share a bin
    assert len(load) <= 1.1 * max(halves, sum(k * n for k, n in counts.items()) / 256) + 1


def test_counts_equal_the_greedy_library_model(spark):
    vocabulary = wordpieces.byte_bpe_vocabulary()
    ids = {p: k for k, p in enumerate(dict.fromkeys([*vocabulary, "[UNK]"]))}
    model = models.WordPiece(ids, unk_token="[UNK]", max_input_chars_per_word=10**9)
    rows = corpus()
    got = wordpieces.token_counts(spark.createDataFrame(rows, SCHEMA)).collect()
    want = Counter()
    for r in rows:
        pieces = [model.tokenize(w.decode()) for w in (r[1] or "").encode().split()]
        lost = sum(p[0].value == "[UNK]" for p in pieces)
        want[r[0], len(pieces), sum(map(len, pieces)), lost] += 1
    assert Counter(map(tuple, got)) == want


def test_failure_links_on_a_vocabulary_that_needs_them():
    vocabulary = ["a", "abcdx", "##b", "##c", "##cdy", "##dz", "##d"]
    own = wordpieces.LongestMatch(vocabulary)
    for word, count in {"a": 1, "abcdz": 4, "abcdx": 1, "abcdy": 3, "abcd": 4, "abx": -1, "b": -1, "": 0}.items():
        assert own.count(word.encode()) == (count if word else -1 if own.link[0] == -1 else 0), word


def test_sentence_pieces_equal_the_library_and_come_back(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = corpus() + [(900 + k, t, None, None, None, None, None, None) for k, t in enumerate([*ODD, "▁mark ▁▁", " lead"])]
    docs = spark.createDataFrame(rows, SCHEMA)
    encoded = sentencepieces.encode(docs, with_ids=True)
    got = encoded.collect()
    want = Counter((r[0], zlib.crc32(np.array(library.encode(r[1] or ""), "<u4").tobytes())) for r in rows)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want
    assert all(r.parity and r.round_trip for r in got)
    texts = Counter((r[0], library.decode(library.encode(r[1] or ""))) for r in rows)
    assert Counter(map(tuple, sentencepieces.decode(encoded).collect())) == texts


def test_whole_pipeline_of_the_backend_agrees():
    own = sentencepieces.Codec()
    for text in ["Hello  wide world", "naïve ▁ 日本", "tail "]:
        assert own.whole.encode(text, add_special_tokens=False).ids == own.library.encode(text)
        assert own.whole.decode(own.library.encode(text)) == own.library.decode(own.library.encode(text))


def test_parity_is_told_only_where_it_was_compared():
    """A backend that errs on bare markers, or on words behind several of them, is noticed; without the library nothing is claimed."""
    texts = ["plain words", "two  blanks", " lead", "tail ", "▁ mark", "", "   "]
    own = sentencepieces.Codec()
    assert [(r, p) for _, r, p in own.encode_batch(texts)] == [(True, True)] * len(texts)
    wrong = sentencepieces.Codec()
    right = wrong.plain

    class Erring:
        encode = right.encode

        def encode_batch(self, units, **options):
            return [right.encode("▁wrong" if u.startswith("▁▁") or u == "▁" else u, **options) for u in units]

    wrong.plain = Erring()
    assert [p for _, _, p in wrong.encode_batch(texts)] == [True, False, False, False, False, True, False]
    assert [r for _, r, _ in wrong.encode_batch(texts)] == [True, False, False, False, False, True, False]
    assert {p for _, _, p in sentencepieces.Codec(verify=False).encode_batch(texts)} == {None}


def test_unigram_models_are_rebuilt(tmp_path):
    """A unigram model written field by field: scores and byte fallback reach the backend."""
    import struct

    def field(number, kind, body):
        size = b"" if kind in (0, 5) else bytes([len(body)])
        return bytes([number << 3 | kind]) + size + body

    def piece(text, score, kind):
        own = field(1, 2, text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind]))
        return field(1, 2, own)

    message = piece("<unk>", 0, 2) + b"".join(piece(f"<0x{b:02X}>", -9, 6) for b in range(256))
    message += b"".join(piece(p, s, 1) for p, s in [("▁", -4), ("▁ab", -2), ("c", -3), ("bc", -1), ("▁a", -2.5), ("▁abc", -6)])
    message += field(2, 2, field(3, 0, b"\x01"))
    path = tmp_path / "m.model"
    path.write_bytes(message)
    own = sentencepieces.Codec(str(path), verify=False)
    ids = np.frombuffer(next(own.encode_batch(["abc é"]))[0], "<u4").tolist()
    pieces = [own.model.pieces[k] for k in ids]
    assert pieces == ["▁a", "bc", "▁", "<0xC3>", "<0xA9>"]
    assert own.decode(np.array(ids, "<u4").tobytes()) == "abc é"


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert packing.best_two_fit(docs).count() == 0
    assert wordpieces.token_counts(docs).count() == 0
    assert sentencepieces.encode(docs).count() == 0
