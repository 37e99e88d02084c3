"""N-gram Jaccard join with set-relation skipping.

Documents are sets of word shingles; two link when
``100 * |A & B| >= percent * |A | B|``. The result is exact up to 64-bit hashes.

* Equal sets are one set from the start, with a multiplicity.
* Index lists: shingles are ordered rarest first by a fixed-size count sketch of the
  whole corpus (any common order is right; this one keeps lists short), and only a
  prefix of each set is listed. Lists are cut in blocks of about ``BLOCK`` sets of
  similar size. Two blocks of a list are skipped when their sizes can't reach the
  similarity, or when all its positions are too deep in both (a link of two sets has
  its first common shingle in the shorter prefix of the smaller set).
* In the remaining pairs of blocks, sets whose counts over 256 ranges of hashes already
  differ too much are skipped: the differences are a lower bound of what the sets don't
  share. Only the other sets' texts are fetched.
* Each remaining pair of blocks is worked on once, whatever number of lists has it.
  Within it, a set's overlaps with all sets of the other block are derived from those
  of the set before it: only the shingles in which the two differ are looked up.
* Links leave a block pair as a forest and as counts, never as all pairs of a group.

Defined cases: null or blank texts are empty sets, linked with nothing; texts with
fewer words than a shingle are one shingle; repeated rows and null ids count as
documents of their own; equal sets tie and share a class; texts of any length are read
whole; ids are longs or text that reads as one; other columns, whatever their names, are
left alone; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelspark.llm.components import connected_components
from funnelspark.llm.counts import SCHEMA, as_rows, gathered
from funnelspark.llm.vectext import LOWER, U64, RangeHash, mix, shingle_hashes, signed, slices, text_bytes, words
from funnelspark.llm.workspace import Workspace

#: Words of a shingle and similarity in percent where a contract names no others.
WORDS, PERCENT = 5, 80
#: Slots of the count sketch: its size doesn't grow with the corpus.
SLOTS = 1 << 18
#: Sets of a block, on average at most.
BLOCK = 128


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    if not len(data):
        yield from (np.zeros(0, U64) for _ in range(len(offs) - 1))
        return
    low = LOWER[data]
    start, end, first = words(low, offs)
    word = RangeHash(low)(start, end) if len(start) else np.zeros(0, U64)
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        if b - a >= n:
            h = np.sort(shingle_hashes(word[a:b], n))
            keep = np.ones(len(h), bool)
            keep[1:] = h[1:] != h[:-1]
            yield h[keep]
        elif b > a:
            yield shingle_hashes(word[a:b], b - a) ^ U64(b - a)
        else:
            yield np.zeros(0, U64)


def _sketch(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, size = np.zeros(SLOTS, np.int64), [], 0
        for batch in batches:
            for part in slices(batch, "_text"):
                for s in shingle_sets(*text_bytes(part.column(0)), n):
                    waiting.append((s & U64(SLOTS - 1)).astype(np.int32))
                    size += len(s)
                if size > 4 * SLOTS:
                    total += np.bincount(np.concatenate(waiting), minlength=SLOTS)
                    waiting, size = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=SLOTS)
        if total.any():
            yield as_rows(total)

    return run


def frequency_levels(texts: DataFrame, n: int) -> np.ndarray:
    """A byte for each slot that grows with the log of the slot's count over all texts."""
    total = gathered(texts.select("_text").mapInArrow(_sketch(n), SCHEMA), SLOTS)
    return np.minimum(np.log2(total + 1) * 6, 255).astype(np.uint8)


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


def _described(n: int, percent: int, level: np.ndarray):
    """rid, sid (hash of the set), n, prefix (rarest first), of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                sid, size, prefix, ranges = [], [], [], []
                for s in shingle_sets(*text_bytes(part.column(2)), n):
                    m = len(s)
                    size.append(m)
                    ranges.append(np.minimum(np.bincount((s >> U64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes())
                    if not m:
                        sid.append(None)
                        prefix.append(None)
                        continue
                    sid.append(int((mix(s).sum() ^ U64(m)).view(np.int64)))
                    rank = (level[s & U64(SLOTS - 1)].astype(U64) << U64(55)) | (s >> U64(9))
                    k = m - _ceil(percent * m, 100) + 1
                    prefix.append(np.sort(np.partition(rank, k - 1)[:k] if k < m else rank).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sid, pa.int64()), pa.array(size, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(ranges, pa.binary())], ["id", "rid", "sid", "n", "prefix", "ranges"]
                )

    return run


def _possible(percent: int):
    """b1, b2, side, sid, n, ranges -> b1, b2, side, sid of the sets that may link with one of the other side."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        return groupby(rows, lambda r: r[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, group in groups(batches):
            sides: list[list[tuple]] = [[], []]
            for r in group:
                sides[r[2]].append(r)
            own = key[0] == key[1]
            left, right = sides[0], sides[0] if own else sides[1]
            x, y = (np.frombuffer(b"".join(r[5] for r in side), np.uint8).reshape(-1, 256).astype(np.int16) for side in (left, right))
            nx, ny = (np.array([r[4] for r in side]) for side in (left, right))
            hit_y = np.zeros(len(right), bool)
            for i, r in enumerate(left):
                both = (nx[i] + ny - np.abs(x[i] - y).sum(axis=1)) // 2
                ok = 100 * both >= percent * (nx[i] + ny - both)
                if own:
                    ok[i] = False
                hit_y |= ok
                if ok.any() and not own:
                    out.append(r[:4])
            out += [r[:4] for r, hit in zip(right, hit_y.tolist(), strict=True) if hit]
            if len(out) > 10_000:
                yield _member_rows(out)
                out = []
        if out:
            yield _member_rows(out)

    return run


def _member_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["b1", "b2", "side", "sid"])


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each left set its overlaps with all right sets, derived from the left set before it."""
    tokens = np.concatenate(right)
    owner = np.repeat(np.arange(len(right)), [len(s) for s in right])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]

    def found(s: np.ndarray) -> np.ndarray:
        a, b = np.searchsorted(tokens, s, "left"), np.searchsorted(tokens, s, "right")
        hit = np.flatnonzero(b > a)
        if not len(hit):
            return np.zeros(len(right), np.int64)
        return np.bincount(np.concatenate([owner[p:q] for p, q in zip(a[hit].tolist(), b[hit].tolist(), strict=True)]), minlength=len(right))

    before, counts = np.zeros(0, U64), np.zeros(len(right), np.int64)
    for s in left:
        less, more = np.setdiff1d(before, s, assume_unique=True), np.setdiff1d(s, before, assume_unique=True)
        counts = counts - found(less) + found(more) if len(less) + len(more) < len(s) else found(s)
        before = s
        yield counts


def _links(rows: list[tuple], percent: int) -> list[tuple[int, int, int]]:
    """(sid, root, number of linked documents) of the linked sets of one pair of blocks."""
    sides: list[dict[int, tuple]] = [{}, {}]
    for side, sid, mult, shingles in rows:
        sides[side][sid] = (shingles, mult, sid)
    near = lambda x: (int(x[0][0]), len(x[0]), x[2])  # noqa: E731  sets with the same smallest hash are likely similar
    left = sorted(sides[0].values(), key=near)
    right = sorted(sides[1].values(), key=near) if sides[1] else left
    own = not sides[1]
    if not left or own and len(left) < 2:
        return []
    size, mult = np.array([len(x[0]) for x in right]), np.array([x[1] for x in right])
    root: dict[int, int] = {}
    links: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for i, (x, both) in enumerate(zip(left, _overlaps([x[0] for x in left], [x[0] for x in right]), strict=True)):
        ok = 100 * both >= percent * (len(x[0]) + size - both)
        if own:
            ok[i] = False
        for j in np.flatnonzero(ok).tolist():
            links[x[2]] = links.get(x[2], 0) + int(mult[j])
            if not own:
                links[right[j][2]] = links.get(right[j][2], 0) + x[1]
            a, b = find(x[2]), find(right[j][2])
            root[max(a, b)] = min(a, b)
    return [(s, find(s), k) for s, k in links.items()]


def _verify(n: int, percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for part in slices(batch, "_text"):
                yield from zip(*(part.column(i).to_pylist() for i in range(5)), shingle_sets(*text_bytes(part.column(5)), n), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for _, group in groupby(rows(batches), lambda r: r[:2]):
            out += _links([r[2:] for r in group], percent)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["sid", "root", "links"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["sid", "root", "links"])

    return run


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: id (long), n_shingles, component_id (smallest id reachable by links), n_links (documents linked directly)."""
    spark = docs.sparkSession
    work = Workspace(spark, "sets")
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col), text).alias("rid"), text.alias("_text"))
    level = frequency_levels(texts, n)
    rows = work.write(texts.mapInArrow(_described(n, percent, level), "id long, rid long, sid long, n long, prefix array<long>, ranges binary"), "documents")
    sets = work.write(
        rows.filter("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.count("*").alias("mult"), F.min("id").alias("low"), F.min("rid").alias("rid"), F.first("prefix").alias("prefix"), F.first("ranges").alias("ranges")), "sets"
    )
    slim = work.write(rows.select("id", "sid", "n"), "ids")
    work.drop(rows)
    rows = slim
    listed = sets.select("sid", "n", F.posexplode("prefix").alias("pos", "tok"))
    lists = listed.groupBy("tok").agg(F.count("*").alias("c")).filter("c > 1")
    # a position of the shorter prefix, n - ceil(2 * percent * n / (100 + percent)) + 1 long
    early = F.col("pos") <= F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent))
    listed = work.write(listed.join(lists, "tok").select("tok", "sid", "c", early.alias("early"), F.floor(F.log(F.col("n")) / np.log(100 / percent)).cast("int").alias("band")), "lists")
    slim = work.write(sets.drop("prefix"), "sets")
    work.drop(sets)
    sets = slim
    work.settle()
    home = listed.groupBy("sid").agg(F.max(F.struct("c", "tok")).alias("h"), F.first("band").alias("band"))
    salt = F.pmod(F.xxhash64("sid"), F.ceil(F.col("h.c") / BLOCK))
    home = work.write(home.select("sid", "band", F.xxhash64("h.tok", "band", salt).alias("block")), "blocks")
    per_list = listed.join(home.select("sid", "block"), "sid").groupBy("tok", "block").agg(F.max("early").alias("early"), F.first("band").alias("band"))
    x, y = per_list.alias("x"), per_list.alias("y")
    pairs = x.join(y, (F.col("x.tok") == F.col("y.tok")) & (F.col("x.block") < F.col("y.block")) & (F.abs(F.col("x.band") - F.col("y.band")) <= 1) & (F.col("x.early") | F.col("y.early")))
    pairs = pairs.select(F.col("x.block").alias("b1"), F.col("y.block").alias("b2")).distinct()
    # a block of one set has no pair within it
    within = home.groupBy("block").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("block").alias("b1"), F.col("block").alias("b2"))
    pairs = work.write(within.union(pairs), "pairs")
    work.drop(listed)
    work.settle()
    facts = home.join(sets.select("sid", "n", "ranges"), "sid").select("block", "sid", "n", "ranges")
    one = pairs.join(facts, pairs["b1"] == facts["block"]).select("b1", "b2", F.lit(0).alias("side"), "sid", "n", "ranges")
    two = pairs.filter("b1 <> b2").join(facts, F.col("b2") == facts["block"]).select("b1", "b2", F.lit(1).alias("side"), "sid", "n", "ranges")
    near = one.union(two).repartition("b1", "b2").sortWithinPartitions("b1", "b2").mapInArrow(_possible(percent), "b1 long, b2 long, side int, sid long")
    near = work.write(near, "near")
    work.settle()
    used = near.select("sid").distinct().join(sets.select("sid", "mult", F.col("rid").alias("witness")), "sid")
    filled = work.write(texts.join(used, texts["rid"] == used["witness"]).select("sid", "mult", "_text"), "members")  # texts are smaller than their sets
    work.settle()
    dealt = near.join(filled, "sid").select("b1", "b2", "side", "sid", "mult", "_text").repartition("b1", "b2").sortWithinPartitions("b1", "b2")
    found = work.write(dealt.mapInArrow(_verify(n, percent), "sid long, root long, links long"), "links")
    work.drop(filled)
    work.settle()
    comp = connected_components(found.select(F.col("sid").alias("a"), F.col("root").alias("b")), work)
    links = found.groupBy("sid").agg(F.sum("links").alias("links"))
    lows = comp.join(sets.select(F.col("sid").alias("node"), "low"), "node")
    lows = lows.groupBy("comp").agg(F.min("low").alias("component_id"))
    classes = comp.join(lows, "comp").select(F.col("node").alias("sid"), "component_id")
    known = sets.select("sid", "low", "mult").join(classes, "sid", "left").join(links, "sid", "left")
    known = known.select("sid", F.coalesce("component_id", "low").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    some = rows.filter("n > 0").select("id", "sid", "n").join(known, "sid").select("id", "n", "component_id", "n_links")
    none = rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return some.union(none).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "n_links")
