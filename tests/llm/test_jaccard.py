"""Jaccard groups and embedding groups against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from seriesloom.llm import jaccard
from seriesloom.llm.common import components
from seriesloom.llm.epsilon import near_duplicates
from seriesloom.operators.skew import DEFAULT_LIMITS
from tests.llm.corpus import SCHEMA, corpus, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def smallest(n, links, ids):
    root = list(range(n))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        root[find(a)] = find(b)
    low = defaultdict(lambda: math.inf)
    for k in range(n):
        low[find(k)] = min(low[find(k)], ids[k])
    return [low[find(k)] for k in range(n)]


def shingles(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


@pytest.mark.parametrize(("width", "percent", "part", "chunk_bytes"), [(4, 85, 2048, 1 << 20), (4, 85, 3, 3000), (5, 80, 2, 5000)])
def test_groups(spark, width, percent, part, chunk_bytes):
    rows = [r for r in corpus() if r[0] is not None]
    sets = [shingles(r[1], width) for r in rows]
    links = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    want = Counter(zip([r[0] for r in rows], map(len, sets), smallest(len(rows), links, [r[0] for r in rows])))
    got = jaccard.groups(spark.createDataFrame(rows, SCHEMA), width, percent, chunk_bytes, part).collect()
    assert Counter(map(tuple, got)) == want
    assert len({r.component_id for r in got}) < len(want)


@pytest.mark.parametrize(("width", "percent", "part", "chunk_bytes"), [(4, 85, 2048, 1 << 20), (5, 80, 2, 5000)])
def test_every_link_is_found(spark, tight, width, percent, part, chunk_bytes):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    held = [(r[0], shingles(r[1], width)) for r in rows]
    near = lambda x, y: x and y and 100 * len(x & y) >= percent * len(x | y)
    rep = {}
    for k, s in sorted((h for h in held if h[0] is not None), key=lambda h: h[0]):
        rep.setdefault(s, k)
    want = {(min(a, b), max(a, b)) for x, a in rep.items() for y, b in rep.items() if a != b and near(x, y)}
    pairs, members = jaccard.linked_pairs(docs, width, percent, chunk_bytes, part)
    got = [tuple(r) for r in pairs.collect()]
    assert len(want) > 10 and len(got) == len(set(got)) and set(got) == want
    assert all(r.rep == (None if r.doc_id is None else rep[s] if s else r.doc_id) for r, s in
               zip(sorted(members.where("doc_id is not null").collect(), key=lambda r: r.doc_id), [s for k, s in sorted((h for h in held if h[0] is not None), key=lambda h: h[0])]))
    known = [(k, s) for k, s in held if k is not None]
    degree = Counter((k, len(s), sum(bool(near(s, y)) for j, (_, y) in enumerate(known) if j != i)) for i, (k, s) in enumerate(known))
    degree.update((None, len(s), None) for k, s in held if k is None)
    for limits in (DEFAULT_LIMITS, tight):
        told = jaccard.groups_with_links(docs, width, percent, chunk_bytes, part, limits).collect()
        assert Counter((r.doc_id, r.n_shingles, r.n_links) for r in told) == degree
    plain = jaccard.groups(docs, width, percent, chunk_bytes, part).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in told) == Counter(map(tuple, plain))
    assert jaccard.groups_with_links(docs.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = jaccard.one_of_each(docs, 4, 85)
    assert kept.columns == docs.columns
    groups = jaccard.groups(spark.createDataFrame([r for r in rows if r[0] is not None], SCHEMA), 4, 85).collect()
    want = sorted({r.component_id for r in groups})
    got = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == want
    assert got.count(None) == 2


def test_one_of_each_with_hot_ids_and_clashing_names(spark, tight):
    rows = [(k % 3 if k < 30 else k, "same words in all of these rows" if k < 60 else f"own words number {k} here", k % 2) for k in range(90)] + [(None, None, 1)] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string, _n int")
    once = sorted(map(tuple, jaccard.one_of_each(docs, 4, 85).select("doc_id", "text").collect()), key=repr)
    want = sorted([(0, rows[0][1]), *[(k, rows[k][1]) for k in range(60, 90)], *[(None, None)] * 9], key=repr)
    assert once == want
    assert sorted(map(tuple, jaccard.one_of_each(docs, 4, 85, tight).select("doc_id", "text").collect()), key=repr) == want


@pytest.mark.parametrize("ids", [(None, 7, 3), (None, 3, 7), (7, None, 3), (None, None, 3)])
def test_a_row_without_id_before_its_equals(spark, ids):
    text = " ".join(prose(random.Random(4), 60))
    docs = spark.createDataFrame([(k, text, "en", "s", 1, 1, "c", "r") for k in ids], SCHEMA).coalesce(1)
    want = Counter((k, 57, None if k is None else 3) for k in ids)
    assert Counter(map(tuple, jaccard.groups(docs).collect())) == want
    assert Counter(r.doc_id for r in jaccard.one_of_each(docs).collect()) == Counter([3, *(k for k in ids if k is None)])


def test_no_documents(spark):
    assert jaccard.groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(21)} | {k: 100 for k in range(100, 140)}


def _vectors(dimension=8):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, dimension))
    rows = []
    for k in range(300):
        v = centres[k % 6] + rng.normal(size=dimension) * (0.15 if k % 3 else 1.0)
        rows.append((k, [float(np.float32(x)) for x in v * (1 + k % 4)], 1, "x"))
    rows += [(300 + k, rows[7][1], 0, None) for k in range(30)]  # equal vectors
    rows += [
        (400, None, 0, None), (401, [], 0, None), (402, [0.0] * dimension, 0, None), (403, [None] + [1.0] * (dimension - 1), 0, None),
        (404, [math.nan] * dimension, 0, None), (405, [math.inf] * dimension, 0, None), (406, [1.0, 2.0, 3.0], 0, None), (407, [2.0, 4.0, 6.0], 0, None),
    ]
    return rows


@pytest.mark.parametrize(("cosine", "block"), [(0.9, 4096), (0.9, 16), (0.99, 5)])
def test_embedding_groups(spark, cosine, block):
    rows = _vectors()
    usable = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, _, _ in rows]
    units = [np.array(r[1]) / np.linalg.norm(r[1]) if ok else None for r, ok in zip(rows, usable)]
    links = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if usable[i] and usable[j] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine
    ]
    degree = Counter(k for pair in links for k in pair)
    ids = [r[0] for r in rows]
    low = smallest(len(rows), links, ids)
    want = {(i, degree[k], c, i == c) for k, (i, c) in enumerate(zip(ids, low))}
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, cell string")
    assert {tuple(r) for r in near_duplicates(docs, cosine, block=block).collect()} == want


def test_no_vectors(spark):
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
