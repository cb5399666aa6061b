"""Filter interaction and source divergence against brute force, on odd rows, with small blocks and with nothing broadcast."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from seriesloom.llm import divergence, filteraudit
from tests.llm.corpus import SCHEMA, corpus, prose

LABELS = "doc_id long, quality int, toxic int, part string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of_parts(seed: int = 5) -> list[tuple]:
    """The odd corpus dealt over sources (one of them holds a third), with capitals, signs and copies."""
    rng = random.Random(seed)
    out = []
    for k, (doc, text, *rest) in enumerate(corpus()):
        if text and k % 4 == 1:
            text = text.upper() + " #1"
        if text and k % 5 == 2:
            text = (text + " ") * 3 + "word " * 300
        source = rng.choice(["web", "web", "books", "", None, "日本"])
        out.append((doc, text, rng.choice(["en", "de", None]), source, *rest[2:]))
    return out + [(500 + k, out[k][1], "en", "web", *out[k][4:]) for k in range(20)] + [out[3], out[3]]


def fails_of(rows: list[tuple]) -> list[str]:
    first: dict[str, int] = {}
    for doc, text, *_ in rows:
        if doc is not None:
            first[text or ""] = min(first.get(text or "", doc), doc)
    out = []
    for doc, text, *_ in rows:
        text = text or ""
        words = WORD.findall(text)
        own = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        own += "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        out.append(own + "E" * (doc is not None and first[text] < doc))
    return out


def brute_audit(rows: list[tuple], labels: list[tuple]) -> dict:
    good, toxic = {r[0] for r in labels if r[1] == 1}, {r[0] for r in labels if r[2] == 1}
    by_part = defaultdict(list)
    for row, fails in zip(rows, fails_of(rows)):
        by_part[row[3] or ""].append((row[0], fails))
    out = {}
    for part, own in by_part.items():
        totals = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                totals[f] += len(gone)
                failing = sum(f in r[1] for r in own)
                alone = sum(r[1] == f for r in own)
                lost = [sum(r[0] in known for r in gone if r[0] is not None) for known in (good, toxic)]
                out[part, order, step] = [len(left), len(gone), failing - len(gone), alone, *lost]
        for (p, order, step), value in out.items():
            if p == part:
                value.append(totals[order[step - 1]])
    return out


@pytest.mark.parametrize("small", [False, True])
def test_filter_audit(spark, tight, monkeypatch, small):
    rows = rows_of_parts()
    labels = [(k, k % 2, int(k % 7 == 0), "x") for k in range(0, 80, 3)] + [(3, 0, 1, "x"), (None, 1, 1, "x")]
    if small:
        monkeypatch.setattr(filteraudit, "RANGE_BITS", 3)
    own = [tight] if small else []
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = filteraudit.audit(docs, spark.createDataFrame(labels, LABELS), *own).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in got} == brute_audit(rows, labels)
    assert len(got) == len({r.part for r in got}) * 600


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert filteraudit.audit(docs, labels).count() == 0
    assert divergence.audit(docs).count() == 0
    one = spark.createDataFrame([(None, None, None, None, None, None, None, None)], SCHEMA)
    assert {(r.kept, r.removed) for r in filteraudit.audit(one, labels).collect()} == {(1, 0), (0, 1), (0, 0)}
    assert divergence.audit(one).count() == 0


def test_lists(rng=np.random.default_rng(0)):
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(2))
        assert filteraudit.union(a, b).tolist() == np.union1d(a, b).tolist()
        assert filteraudit.difference(a, b).tolist() == np.setdiff1d(a, b).tolist()


def brute_divergence(rows: list[tuple], least: int, top: int) -> set:
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, docs = defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        found = term.findall((r[1] or "").translate(lower))
        n[r[2] or "", r[3] or ""].update(found)
        docs[r[2] or ""].update(set(found))
    out = set()
    for lang in docs:
        kept = [t for t, k in docs[lang].items() if k >= least]
        sources = [s for own, s in n if own == lang]
        whole = sum((n[lang, s] for s in sources), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(n[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            over = sorted((q[t] - p[s][t], t.encode()) for t in kept if n[lang, s][t] and p[s][t] > q[t])[:top]
            for part, own in (("pair", pairs), ("term", over)):
                out |= {(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(own, 1)}
    return out


def spoken(seed: int = 9) -> list[tuple]:
    """Many sources of one language, a language with one source, one without kept terms, and the odd rows."""
    rng = random.Random(seed)
    common = [*prose(rng, 40), "été", "日本語", "ẞtraße", "A", "Ab"]
    out = rows_of_parts()
    for k in range(240):
        source = "s0" if k % 3 == 0 else f"s{k % 11}"
        out.append((1000 + k, " ".join(rng.choices(common, k=rng.randint(0, 60))) + " x1y|Z", "en", source, 1, 1, "c", "r"))
    return out + [(2000, "only one here", "fr", "solo", 1, 1, "c", "r"), (2001, None, "it", "a", 1, 1, "c", "r"), (2002, "", "it", "b", 1, 1, "c", "r")]


@pytest.mark.parametrize("blocks", [(64, 2048), (2, 5)])
def test_divergence(spark, tight, blocks):
    rows = spoken()
    own = {} if blocks[0] == 64 else {"limits": tight}
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = divergence.audit(docs, 12, 7, per_group=blocks[0], per_term=blocks[1], **own).collect()
    want = brute_divergence(rows, 12, 7)
    assert {(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in got} == want
    assert len(got) == len(want)


def test_shares_are_whole_numbers_at_any_size(spark):
    big = 900_000_000_000_000
    row = spark.createDataFrame([(big, 3 * big, 1000)], "n long, total long, V long").select(divergence.share("n", "total").alias("p")).first()
    assert row.p == 1 + 10**9 * (big + 5) // (3 * big + 5000)
