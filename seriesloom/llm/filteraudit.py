"""How filters interact: what each of five filters removes in every order, from sorted posting lists.

Rows get a number when they are first read; 65,536 numbers in a row are an id range. A task owns an id range. For every part
(source) in it, it holds one sorted list of failing row numbers per filter. Unions of lists grow over the 32 sets of filters,
each by galloping the ids of the shorter list through the longer one; what a filter removes after a set of others is the
difference of its list and their union. Only sizes leave the task. Sums over the id ranges answer all 120 orders, since
what a step removes depends on the set of filters before it and not on their order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import columns_of, ship
from seriesloom.operators.skew import DEFAULT_LIMITS, Limits, attach, key_table
from seriesloom.sources.artifacts import settle

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 2
CAPITALS, SIGNS = bytes(range(65, 91)), b"#$%&*|"
CONTINUED = bytes(range(128, 192))
"""bytes that go on with a character of UTF-8"""
RANGE_BITS = 16
UNION = 5 * 32
"""code of the size of a union: this and the set; of a difference: 32 times the filter and the set before it"""
MARKS = "row long, doc_id {id}, part string, fails int, body binary"
SIZES = "part string, code int, size long, good long, toxic long"


def text_fails(text: bytes) -> int:
    """Bits of those of the filters A to D that a text fails."""
    words = text.split()
    n = len(text)
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
        | (100 * (n - len(text.translate(None, CAPITALS))) > MAX_CAPITAL_PERCENT * len(text.translate(None, CONTINUED))) << 2
        | (len(text.translate(None, SIGNS)) < n) << 3
    )


def marked(docs: DataFrame) -> DataFrame:
    """A settled row per document: its number, id, part, the filters A to D that it fails, and SHA-256 of its text."""
    from hashlib import sha256

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fails, bodies = [], []
            for text in batch.column(3):
                body = text.as_py() or b""
                fails.append(text_fails(body))
                bodies.append(sha256(body).digest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(fails, pa.int32()), pa.array(bodies, pa.binary())], ["row", "doc_id", "part", "fails", "body"]
            )

    own = columns_of(docs, "doc_id", "source", "text")
    rows = own.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("source", F.lit("")).alias("part"), F.col("text").cast("binary"))
    return settle(rows.mapInArrow(run, MARKS.format(id=kind)), "marks")[0]


def with_copies(marks: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Set the bit of E where a row with a smaller id has the same text. Rows without an id neither fail nor cause it."""
    same = marks.where("doc_id is not null").groupBy("body").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    found = attach(marks, key_table(same.where("_n > 1"), "_n", "copies"), ["body"], "left", "_n", limits)
    later = F.coalesce(F.col("_first") < F.col("doc_id"), F.lit(False))
    return found.select("row", "doc_id", "part", F.when(later, F.col("fails") + 16).otherwise(F.col("fails")).alias("fails"))


def with_labels(marks: DataFrame, labels: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Add ``good`` and ``toxic``: whether any label of the id says so. Ids without a label, and null ids, are neither."""
    own = columns_of(labels, "doc_id", "quality", "toxic").where("doc_id is not null")
    known = own.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    found = attach(marks, known.where("good or toxic"), ["doc_id"], "left", limits=limits)
    return found.select("row", "part", "fails", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def gallop(ids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each of the sorted ``ids`` among sorted others, and whether it is one of them.

    Only the stretch between the first and the last id is looked at. The search of sorted ids starts each from where
    the one before it ended.
    """
    if not len(ids) or not len(among):
        return np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    low, high = np.searchsorted(among, [ids[0], ids[-1]])
    near = among[low : high + 1]
    place = np.searchsorted(near, ids)
    return low + place, near[np.minimum(place, len(near) - 1)] == ids if len(near) else np.zeros(len(ids), bool)


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    place, there = gallop(short, long)
    return np.insert(long, place[~there], short[~there])


def difference(ids: np.ndarray, gone: np.ndarray) -> np.ndarray:
    return ids[~gallop(ids, gone)[1]]


def sizes_of(rows: np.ndarray, fails: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(code, size, good, toxic) of every union, and of every difference that isn't empty, for one part and id range."""
    postings = [rows[fails >> k & 1 == 1] for k in range(len(FILTERS))]
    goods, toxics = rows[good], rows[toxic]
    unions = [rows[:0]]
    out = [(UNION, len(rows), 0, 0)]
    for chosen in range(1, 1 << len(FILTERS)):
        lowest = (chosen & -chosen).bit_length() - 1
        unions.append(union(unions[chosen & chosen - 1], postings[lowest]))
        if len(unions[-1]):
            out.append((UNION + chosen, len(unions[-1]), 0, 0))
    for k, posting in enumerate(postings):
        for before, gone in enumerate(unions):
            if before >> k & 1 or not len(posting):
                continue
            rest = difference(posting, gone)
            if len(rest):
                out.append((32 * k + before, len(rest), int(gallop(rest, goods)[1].sum()), int(gallop(rest, toxics)[1].sum())))
    return out


def range_sizes(rows: pa.Table) -> pa.Table:
    """Sizes of all lists of an id range, part by part."""
    rows = rows.combine_chunks()
    kinds = rows.column("part").chunk(0).dictionary_encode()
    code = kinds.indices.to_numpy()
    number, fails, good, toxic = (rows.column(c).to_numpy() for c in ("row", "fails", "good", "toxic"))
    order = np.lexsort((number, code))
    out: list[list] = [[], [], [], [], []]
    for own in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
        part = kinds.dictionary[int(code[own[0]])].as_py()
        for found in sizes_of(number[own], fails[own], good[own], toxic[own]):
            for column, value in zip(out, (part, *found)):
                column.append(value)
    return pa.table([pa.array(c, k) for c, k in zip(out, [pa.string(), pa.int32(), *[pa.int64()] * 3])], ["part", "code", "size", "good", "toxic"])


def steps() -> list[dict]:
    """The steps of all orders, with the codes of the sizes that tell what happens there."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order, 1):
            out.append(
                {"filter_order": "".join(FILTERS[f] for f in order), "step": step, "k": k, "here": 32 * k + before,
                 "whole": 32 * k, "alone": 32 * k + (31 ^ 1 << k), "after": UNION + (before | 1 << k)}
            )
            before |= 1 << k
    return out


def audit(docs: DataFrame, labels: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """A row per part, order and step: ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    A document is a row: repeated rows count as often as they come. Null texts are empty, null sources are the part ''. Ids
    may be null (see :func:`with_copies`). An empty table gives no rows; other columns are ignored.
    """
    marks = with_labels(with_copies(marked(docs), limits), labels, limits)
    ranges = marks.groupBy(F.shiftright("row", RANGE_BITS).alias("ids"))
    sizes = ranges.applyInArrow(range_sizes, SIZES).groupBy("part", "code").agg(*[F.sum(c).alias(c) for c in ("size", "good", "toxic")])
    # orders in which this set comes first and the filter next: |set|! (4 - |set|)!
    weight = F.get(F.array(*[F.lit(w) for w in (24, 6, 4, 6, 24)]), F.bit_count(F.col("code") % 32).cast("int"))
    is_step = F.col("code") < UNION
    shares = [F.sum(F.when(is_step & (F.floor(F.col("code") / 32) == k), weight * F.col("size"))) for k in range(len(FILTERS))]
    cells = F.map_from_entries(F.collect_list(F.struct("code", F.struct("size", "good", "toxic"))))  # 192 entries at most
    parts = sizes.groupBy("part").agg(cells.alias("cells"), F.array(*[F.coalesce(s, F.lit(0)) for s in shares]).alias("shapley"))
    plan = steps()
    kind = "array<struct<" + ",".join(f"{name}:{'string' if name == 'filter_order' else 'int'}" for name in plan[0]) + ">>"
    every = parts.withColumn("s", F.explode(F.from_json(F.lit(json.dumps(plan)), kind)))
    cell = lambda at, field: F.coalesce(F.try_element_at("cells", F.col(f"s.{at}"))[field], F.lit(0).cast("long"))
    removed = cell("here", "size")
    return every.select(
        "part",
        F.col("s.filter_order").alias("filter_order"),
        F.col("s.step").alias("step"),
        (F.element_at("cells", F.lit(UNION))["size"] - cell("after", "size")).alias("kept"),
        removed.alias("removed"),
        (cell("whole", "size") - removed).alias("redundant"),
        cell("alone", "size").alias("unique_fails"),
        cell("here", "good").alias("good_lost"),
        cell("here", "toxic").alias("toxic_lost"),
        F.get("shapley", F.col("s.k")).alias("shapley"),
    )
