"""Token counts: greedy word pieces counted by a linear longest-match automaton, without building the pieces.

The vocabulary is a trie over UTF-8 bytes with one root for the start of a word and one for its continuation. Each node knows
where matching goes on when no child fits (its failure link) and how many pieces are settled by going there, so a word costs
one step per byte, whatever its pieces.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from seriesloom.llm.common import UnitCache, columns_of, ship

PREFIX = "##"
START, CONTINUED = 0, 1
NOWHERE = -1


class LongestMatch:
    """``count(word)``: pieces of the greedy longest match from the left, or -1 where the vocabulary has no match."""

    def __init__(self, vocabulary: Iterable[str]):
        self.step: dict[int, int] = {}
        final: set[int] = set()
        nodes = 2
        for piece in vocabulary:
            node, body = (CONTINUED, piece[len(PREFIX) :]) if piece.startswith(PREFIX) and piece != PREFIX else (START, piece)
            if not body:
                continue
            for byte in body.encode():
                nxt = self.step.get(node << 8 | byte)
                if nxt is None:
                    nxt = self.step[node << 8 | byte] = nodes
                    nodes += 1
                node = nxt
            final.add(node)
        children: list[list[tuple[int, int]]] = [[] for _ in range(nodes)]
        for key, child in self.step.items():
            children[key >> 8].append((key & 255, child))
        self.link, self.popped = [NOWHERE] * nodes, [0] * nodes
        queue = deque([START, CONTINUED])
        while queue:
            u = queue.popleft()
            for byte, v in children[u]:
                if v in final:
                    self.link[v], self.popped[v] = CONTINUED, 1
                else:
                    z, pops = self.link[u], self.popped[u]
                    while z != NOWHERE and (z << 8 | byte) not in self.step:
                        pops += self.popped[z]
                        z = self.link[z]
                    if z != NOWHERE:
                        self.link[v], self.popped[v] = self.step[z << 8 | byte], pops
                queue.append(v)

    def count(self, word: bytes) -> int:
        step, link, popped = self.step, self.link, self.popped
        node, pieces = START, 0
        for byte in word:
            while (nxt := step.get(node << 8 | byte)) is None:
                pieces += popped[node]
                node = link[node]
                if node == NOWHERE:
                    return -1
            node = nxt
        while node != CONTINUED:
            pieces += popped[node]
            node = link[node]
            if node == NOWHERE:
                return -1
        return pieces


def byte_bpe_vocabulary(path: str | None = None) -> list[str]:
    """Word pieces from a byte-level vocabulary file: tokens that begin with a blank start words, the others continue them."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    from seriesloom.llm.packing import ByteBpe

    printable = ByteBpe._byte_characters()
    with open(path, encoding="utf-8") as f:
        stated = json.load(f)
    special = {t["content"] for t in stated.get("added_tokens", [])}
    out = []
    for token in stated["model"]["vocab"]:
        if token in special:
            continue
        try:
            piece = bytes(printable[c] for c in token).decode()
        except UnicodeDecodeError:
            continue  # part of a character
        word = piece[1:] if piece.startswith(" ") else piece
        if word and not any(c in " \t\n\x0b\x0c\r" for c in word):
            out.append(word if piece.startswith(" ") else PREFIX + word)
    return out


_automata: dict[str | None, UnitCache] = {}


def _counter(path: str | None) -> UnitCache:
    if path not in _automata:
        _automata[path] = UnitCache(LongestMatch(byte_bpe_vocabulary(path)).count, 1_000_000)
    return _automata[path]


def token_counts(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` per row. Words are what stands between ASCII white space.

    A word without a match counts as one unknown token. Null and empty texts have no tokens; repeated rows come back
    repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary_path)
        for batch in batches:
            words, tokens, unknown = [], [], []
            for text in batch.column(1).cast(pa.large_binary()).to_pylist():
                counts = list(map(counter.__getitem__, (text or b"").split()))
                lost = counts.count(-1)
                words.append(len(counts))
                tokens.append(sum(counts) + 2 * lost)
                unknown.append(lost)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.int64()) for x in (words, tokens, unknown)]], ["doc_id", "n_words", "n_tokens", "n_unknown"]
            )

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return columns_of(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")
