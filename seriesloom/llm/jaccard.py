"""N-gram Jaccard join in metric space: pivots, regions, windows from the triangle inequality, exact links.

The Jaccard distance is a metric, but most documents are at distance 1 from any pivot, so regions start from content:

1. Shingles are put in one order for all documents, rare ones first. Linked sets share a shingle among the first
   ``n - ceil(0.85 n) + 1`` of each, so a document whose first ones occur nowhere else is alone, which settles most.
2. Of the documents that share such a shingle the most central one becomes a pivot. A document belongs to the region
   of each pivot that it meets this way (regions overlap at their boundary), with its exact distance to it.
3. Whatever is within 0.15 of the pivot is linked to it. Two of those need no further look. Documents beyond are
   compared with those whose distance to the pivot differs by no more than 0.15 (triangle inequality): rings of that width
   are joined with themselves and the next ring, large rings in parts.
4. A ring pair is joined by local pivots in turn, until all of it is connected or every document outside the largest
   part has been a pivot.

Equal sets are joined once. Links come back as a forest that spans them; ``components`` makes the groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.blocks import Words
from seriesloom.llm.common import columns_of, components, mix64
from seriesloom.llm.exchange import SENT, Chunk, Round, bucket_bits, in_chunks
from seriesloom.operators.skew import DEFAULT_LIMITS, Limits, attach, key_table
from seriesloom.sources.artifacts import settle

SHINGLE = 4
PERCENT = 85
CHUNK_BYTES = 2 << 20
PART = 512
"""documents of a ring that are joined at once"""
FOUND = "doc_id long, n_shingles long, f1 long, f2 long, score double, hashes binary, rare binary"


def linked(common, a, b, percent: int):
    return 100 * common >= percent * (a + b - common)


class Shingles:
    """Distinct shingle hashes per document of a chunk, in order of document and hash."""

    def __init__(self, chunk: Chunk, width: int):
        low = (chunk.bytes >= 65) & (chunk.bytes <= 90)
        chunk.bytes = np.where(low, chunk.bytes | 32, chunk.bytes)
        words = Words(chunk)
        at, hashes = words.windows(width)
        doc = words.doc[at]
        sizes = np.diff(words.first)
        short = np.flatnonzero((sizes > 0) & (sizes < width))
        whole = words.runs.at(words.first[short], sizes[short])
        doc, hashes = np.concatenate([doc, short]), np.concatenate([hashes, whole])
        order = np.lexsort((hashes, doc))
        doc, hashes = doc[order], hashes[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])]) if len(doc) else np.zeros(0, bool)
        self.doc, self.hashes = doc[new], hashes[new]
        self.first = np.searchsorted(self.doc, np.arange(len(sizes) + 1))


class FrequencyRound(Round):
    """Buckets tell how common a hash is: the binary logarithm of the chunks that hold it, one more for each with several."""

    def resolve(self):
        number, unpacked = self.number, self.unpacked

        def run(rows: pa.Table) -> pa.Table:
            keys = [unpacked(k) for k in rows.column("keys").to_pylist()]
            again = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(rows.column("again").to_pylist(), keys)]
            _, where = np.unique(np.concatenate(keys), return_inverse=True)
            counts = np.bincount(where, weights=1 + np.concatenate(again))
            classes = np.floor(np.log2(counts)).astype(np.uint8)[where]
            ends = np.cumsum([len(k) for k in keys])
            bits = [classes[e - len(k) : e].tobytes() for e, k in zip(ends.tolist(), keys)]
            n = rows.num_rows
            return pa.table({"chunk": rows.column("chunk"), "round": pa.array([number] * n, pa.int32()), "bucket": rows.column("bucket"), "bits": pa.array(bits, pa.binary())})

        return run

    def classes(self, hashes: np.ndarray, reply: pa.Table) -> np.ndarray:
        reduced = self.reduced(hashes)
        keys = np.unique(reduced)
        if not len(keys):
            return np.zeros(0, np.uint8)
        bucket = self._bucket(keys)
        cuts = (np.flatnonzero(np.diff(bucket)) + 1).tolist()
        own = {r["bucket"]: r["bits"] for r in reply.to_pylist()}
        out = np.concatenate([np.frombuffer(own[int(bucket[a])], np.uint8) for a in [0, *cuts]])
        return out[np.searchsorted(keys, reduced)]


def _sets(docs: DataFrame, width: int, percent: int, chunk_bytes: int) -> DataFrame:
    """A row per document with the size of its set; those that may be linked also have a fingerprint of the set, and the
    row with the smallest id of each set in a chunk carries the set, its commonness and the rare shingles that it may share."""
    dealt, total = in_chunks(docs, chunk_bytes)
    ask = FrequencyRound(1, bucket_bits(total / 6, 4), 3)  # of 2**24 keys a bucket gets half a million: a few false hits

    def question(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches([ask.question(key[0].as_py(), Shingles(Chunk(rows), width).hashes)])

    def finish(rows: pa.Table, reply: pa.Table) -> pa.Table:
        chunk = Chunk(rows)
        own = Shingles(chunk, width)
        kind = ask.classes(own.hashes, reply)
        sizes = np.diff(own.first)
        n = len(sizes)
        alone = np.bincount(own.doc[kind == 0], minlength=n)
        prefix = sizes - -(-sizes * percent // 100) + 1
        open_ = (sizes > 0) & (alone < prefix)
        ids = chunk.doc_ids.to_pylist()
        f1, f2, score, held, rare = [None] * n, [None] * n, [None] * n, [None] * n, [None] * n
        seen: dict[tuple[int, int], int] = {}
        for k in np.flatnonzero(open_).tolist():
            mine, classes = own.hashes[own.first[k] : own.first[k + 1]], kind[own.first[k] : own.first[k + 1]]
            mixed = mix64(mine)
            f1[k], f2[k] = int(mixed.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix64(mixed + np.uint64(1))).view(np.int64))
            first = seen.setdefault((f1[k], f2[k]), k)
            if first != k and ids[k] is not None and (ids[first] is None or ids[k] < ids[first]):
                for column in (score, held, rare):
                    column[k], column[first] = column[first], None
                seen[f1[k], f2[k]] = k
            elif first == k:
                order = np.lexsort((mine, classes))[: int(prefix[k])]
                score[k], held[k] = float(classes.mean()), mine.tobytes()
                rare[k] = mine[order][classes[order] > 0].tobytes()
        ints = lambda x: pa.array(x, pa.int64())
        return pa.table(
            {"doc_id": chunk.doc_ids, "n_shingles": ints(sizes), "f1": ints(f1), "f2": ints(f2), "score": pa.array(score, pa.float64()), "hashes": pa.array(held, pa.binary()), "rare": pa.array(rare, pa.binary())}
        )

    told = ask.ask(dealt.groupBy("chunk").applyInArrow(question, SENT))
    return dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(finish, FOUND)


def _rare_rows(sets: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            rare = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
            at = np.repeat(np.arange(len(rare)), [len(x) for x in rare])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([*rare, np.zeros(0, np.int64)])), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], ["shingle", "rep", "score"]
            )

    return sets.select("rep", "score", "rare").mapInArrow(run, "shingle long, rep long, score double")


def _measured(pairs: DataFrame) -> DataFrame:
    """``pivot, rep, common, n, pivot_n`` from rows with both sets."""

    def run(batches):
        for batch in batches:
            a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(k).to_pylist()] for k in (2, 3))
            common = [np.intersect1d(x, y, assume_unique=True).size for x, y in zip(a, b)]
            ints = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), ints(common), ints([x.size for x in b]), ints([x.size for x in a])], ["pivot", "rep", "common", "n", "pivot_n"]
            )

    return pairs.select("pivot", "rep", "pivot_hashes", "hashes").mapInArrow(run, "pivot long, rep long, common long, n long, pivot_n long")


def join_rings(reps: np.ndarray, sets: list[np.ndarray], inner: np.ndarray, distance: np.ndarray, percent: int) -> np.ndarray:
    """Index of the root of each document: links among them, those that are ``inner`` being connected already.

    Local pivots: a document outside the largest part is compared with all others by counting, over the postings of its
    shingles, what it has in common with each; that is its exact distance to all.
    """
    n = len(reps)
    root = np.arange(n)
    if inner.any():
        root[inner] = np.flatnonzero(inner)[0]
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    _, ids = np.unique(flat, return_inverse=True)
    order = np.argsort(ids, kind="stable")
    posting = owner[order]
    starts = np.concatenate([[0], np.cumsum(np.bincount(ids))])
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    reach = 1 - percent / 100 + 1e-9
    done = np.zeros(n, bool)
    while True:
        counts = np.bincount(root, minlength=n)
        todo = np.flatnonzero(~done & (root != counts.argmax()))
        if not len(todo):
            return root
        z = int(todo[0])
        done[z] = True
        own = ids[firsts[z] : firsts[z + 1]]
        met = np.concatenate([posting[starts[i] : starts[i + 1]] for i in own])
        common = np.bincount(met, minlength=n)
        hit = linked(common, sizes, sizes[z], percent) & (np.abs(distance - distance[z]) <= reach)
        low = root[hit].min()
        root[np.isin(root, root[hit])] = low


def pairs_within(reps: np.ndarray, sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All linked pairs of one of ``first`` and one of ``second``, smaller representative first; what two sets have in common is
    counted over the postings of their shingles."""
    sizes = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(reps)), sizes)
    posting = owner[np.argsort(ids, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(ids))])
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    a, b = [], []
    for z in np.flatnonzero(first).tolist():
        met = np.concatenate([posting[starts[i] : starts[i + 1]] for i in ids[firsts[z] : firsts[z + 1]]])
        hit = linked(np.bincount(met, minlength=len(reps)), sizes, sizes[z], percent) & second & (reps != reps[z])
        a.append(np.minimum(reps[hit], reps[z]))
        b.append(np.maximum(reps[hit], reps[z]))
    return np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)])


def _represented(docs: DataFrame, width: int, percent: int, chunk_bytes: int) -> tuple[DataFrame, DataFrame]:
    """A row per document, and a row per distinct set that may be linked, under the smallest id that has it."""
    found, _ = settle(_sets(columns_of(docs, "doc_id", "text"), width, percent, chunk_bytes), "shingles")
    carriers = found.where("hashes is not null and doc_id is not null")
    sets = carriers.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.max("score").alias("score"), F.min("hashes").alias("hashes"), F.min("rare").alias("rare"))
    return found, settle(sets, "sets")[0]


def _near_pivots(sets: DataFrame, percent: int) -> DataFrame:
    """Every set of a region with its exact distance to the pivot."""
    rare, _ = settle(_rare_rows(sets), "rare")
    pivots = rare.groupBy("shingle").agg(F.max(F.struct("score", (-F.col("rep")).alias("rep"))).alias("top"), F.count(F.lit(1)).alias("k"))
    pivots, _ = settle(pivots.where("k > 1").select("shingle", (-F.col("top.rep")).alias("pivot")), "pivots")
    regions = rare.join(pivots, "shingle").where("pivot != rep").select("pivot", "rep").distinct()
    regions, _ = settle(regions, "regions")
    bodies = sets.select("rep", "hashes")
    pairs = regions.join(bodies, "rep").join(bodies.select(F.col("rep").alias("pivot"), F.col("hashes").alias("pivot_hashes")), "pivot")
    near, _ = settle(_measured(pairs), "near")
    near = near.withColumn("inner", linked(F.col("common"), F.col("n"), F.col("pivot_n"), percent))
    return near.withColumn("distance", 1 - F.col("common") / (F.col("n") + F.col("pivot_n") - F.col("common")))


def _ring(percent: int) -> Column:
    reach = 1 - percent / 100
    return F.when(F.col("inner"), 0).otherwise(1 + F.floor((F.col("distance") - reach) / (reach + 1e-9)).cast("int")).alias("ring")


def _tiles(rings: DataFrame, bodies: DataFrame, part: int, which: Column) -> DataFrame:
    """Pairs of parts of the same or neighbouring rings, with the sets of both; ``which`` tells ``ring, other`` that are wanted."""
    sizes = rings.groupBy("pivot", "ring").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    sizes, _ = settle(sizes, "ring_sizes")
    mine = rings.join(sizes, ["pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    others = sizes.select("pivot", F.col("ring").alias("other"), F.col("parts").alias("other_parts"))
    around = mine.join(others, "pivot").where((F.col("other") - F.col("ring")).between(-1, 1) & which)
    to_parts = F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1))
    tiles = around.select("pivot", "rep", "distance", "ring", "part", "other", to_parts.alias("other_part"))
    here, there = F.struct("ring", "part"), F.struct(F.col("other").alias("ring"), F.col("other_part").alias("part"))
    low, high = F.least(here, there), F.greatest(here, there)
    tiles = tiles.select(
        "pivot", low.alias("low"), high.alias("high"), "rep", "distance", (F.col("ring") == 0).alias("inner"), (here == low).alias("in_low"), (here == high).alias("in_high")
    )
    return tiles.join(bodies, "rep")


def linked_pairs(
    docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, chunk_bytes: int = CHUNK_BYTES, part: int = PART
) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets, as ``a, b`` (a < b) of their representatives; and ``doc_id, n_shingles, rep`` per row.

    The representative of a set is the smallest id that has it; rows without an id have none and are linked with nothing.
    Linked sets share a rare shingle, so they lie in the region of its pivot, in the same ring or in neighbouring ones: there all
    pairs of parts are joined. Copies stay one set, however many there are.
    """
    found, sets = _represented(docs, width, percent, chunk_bytes)
    near = _near_pivots(sets, percent)
    pivot_links = near.where("inner").select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b"))
    rings, _ = settle(near.select("pivot", "rep", "distance", "inner").select("pivot", "rep", "distance", _ring(percent)), "rings")
    tiles = _tiles(rings, sets.select("rep", "hashes"), part, F.lit(True))

    def join_tile(rows: pa.Table) -> pa.Table:
        held = [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]
        low, high = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("in_low", "in_high"))
        a, b = pairs_within(rows.column("rep").to_numpy(), held, low, high, percent)
        return pa.table({"a": a, "b": b})

    inside = tiles.groupBy("pivot", "low", "high").applyInArrow(join_tile, "a long, b long")
    links, _ = settle(pivot_links.unionByName(inside).distinct(), "all_links")
    known = sets.select("f1", "f2", "rep")
    members = found.join(known, ["f1", "f2"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"))
    return links, members


def groups_with_links(
    docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, chunk_bytes: int = CHUNK_BYTES, part: int = PART, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` per row: ``groups`` with the number of other rows that a row is linked with,
    equal ones included. Rows without an id count for no one and have null numbers; empty sets have 0 links.
    """
    links, members = linked_pairs(docs, width, percent, chunk_bytes, part)
    members, _ = settle(members, "members")
    weights = members.where("rep is not null and n_shingles > 0").groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    weights = key_table(weights, "copies", "copies")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumnRenamed("b", "rep")
    others = attach(both, weights, ["rep"], limits=limits, count_rows=True).groupBy("a").agg(F.sum("copies").alias("others"))
    parts = components(links)
    told = (
        weights.frame.join(others.withColumnRenamed("a", "rep"), "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        .select("rep", "copies", F.coalesce("component_id", "rep").alias("component_id"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    )
    return attach(members, told, ["rep"], "left", "copies", limits).select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).alias("n_links"),
    )


def groups(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, chunk_bytes: int = CHUNK_BYTES, part: int = PART) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row.

    Null and empty texts have an empty set and are linked with nothing; a text of fewer words than a shingle has is one
    shingle. Repeated rows have the same set. A row without an id is a group of its own, without a number. Shingles are
    compared by 64-bit hashes.
    """
    found, sets = _represented(docs, width, percent, chunk_bytes)
    near = _near_pivots(sets, percent)
    edges = near.where("inner").select(F.col("pivot").alias("a"), F.col("rep").alias("b"))

    reach = 1 - percent / 100
    outside = near.where("not inner").groupBy("pivot").agg(F.min("distance").alias("nearest"))
    outside, _ = settle(outside, "outside")
    rings = near.join(outside, "pivot").where(~F.col("inner") | (F.col("distance") >= F.col("nearest") - reach - 1e-9))
    rings, _ = settle(rings.select("pivot", "rep", "distance", _ring(percent)), "rings")
    tiles = _tiles(rings, sets.select("rep", "hashes"), part, F.col("ring") + F.col("other") > 0).drop("in_low", "in_high")

    def join_tile(rows: pa.Table) -> pa.Table:
        reps = rows.column("rep").to_numpy()
        held = [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]
        root = join_rings(reps, held, rows.column("inner").to_numpy(zero_copy_only=False), rows.column("distance").to_numpy(), percent)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": reps[moved], "b": reps[root[moved]]})

    edges = edges.unionByName(tiles.groupBy("pivot", "low", "high").applyInArrow(join_tile, "a long, b long"))
    parts = components(edges)
    known = sets.select("f1", "f2", "rep").join(parts.select(F.col("node").alias("rep"), "component_id"), "rep", "left")
    known, _ = settle(known.select("f1", "f2", F.coalesce("component_id", "rep").alias("component_id")), "known")
    settled = found.where("f1 is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    open_ = found.where("f1 is not null and doc_id is not null").join(known, ["f1", "f2"]).select("doc_id", "n_shingles", "component_id")
    return settled.unionByName(open_)


def one_of_each(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their group; of repeated rows one, and all rows without an id.

    Only ids that go or that come more than once are brought to the documents, so texts stay where they lie as long as
    that list is small; beyond, the join splits hot ids. Texts are compared for repeated ids alone.
    """
    again, rows = (name + "_" * len("".join(docs.columns)) for name in ("again", "rows"))  # longer than any column's name
    found, _ = settle(groups(docs, width, percent).where("doc_id is not null"), "grouped")
    ids = found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias(again), F.count(F.lit(1)).alias(rows))
    told = key_table(ids.where(~F.col(again) | (F.col(rows) > 1)), rows, "told")
    known = docs.where("doc_id is not null")
    marked = attach(known, told, ["doc_id"], "left", rows, limits)
    repeated = told.narrowed(told.frame.where(again).select("doc_id", rows))
    several = attach(known, repeated, ["doc_id"], "left_semi", rows, limits).dropDuplicates(["doc_id", "text"])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = marked.where(F.col(again).isNull()).select(*columns)
    return out.unionByName(several.select(*columns)).unionByName(docs.where("doc_id is null"))
