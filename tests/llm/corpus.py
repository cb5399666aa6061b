"""A small corpus with every odd case: nulls, empty and long texts, ties, repeated rows, shared passages, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, chunk string, _row string"
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def prose(rng: random.Random, words: int) -> list[str]:
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(words)]


def corpus(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    passage, base = prose(rng, 60), prose(rng, 150)
    texts: list[str | None] = [" ".join(prose(rng, rng.randint(1, 200))) for _ in range(30)]
    for k in range(25):  # near copies, some at the edge of the threshold
        own = list(base)
        for _ in range(k % 7):
            own[rng.randrange(len(own))] = "changed" + str(rng.randrange(40))
        texts.append(" ".join(own))
    texts += [" ".join(base)] * 6
    for _ in range(8):
        texts.append(" ".join(prose(rng, rng.randint(0, 40)) + passage + prose(rng, rng.randint(0, 40))))
    texts += [" ".join(prose(rng, 9000)), "a " * 3000, "é" * 700, "x", "", "  \n\t ", None, None, "one two three", "ONE two Three"]
    texts += ["line one here\n\nline one here\nother  words\x0b\ttabs " + " ".join(passage[:36]), "日本語の文章 テスト " * 40, "﻿öäü ß ẞ 😀 " * 30]
    rows = [(k, t, "en", "s", None if t is None else len(t), 1, "c", "r") for k, t in enumerate(texts)]
    rows += [rows[0], rows[30], (None, " ".join(base), "en", None, 1, 1, None, None), (None, None, None, None, None, None, None, None)]
    return rows
