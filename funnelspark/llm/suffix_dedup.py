"""Suffix-array dedup with a logarithmic family of indexes.

Every byte covered by a ``length``-byte string that also starts anywhere else
(another document or the same one) is removed, first occurrence included.

* A suffix array here is sparse: of each run of ``length``-byte windows that have
  the same smallest ``anchor``-byte substring (a minimiser), one suffix is kept.
  Equal windows have equal minimisers, so no repeated window is lost, and an array
  holds about one suffix for 70 bytes. Its order is by fingerprints: of the suffix's
  first ``anchor`` bytes (``key``), then of all bytes of its windows (``x``);
  suffixes with a long common prefix are neighbours as in an order by bytes.
* A new batch gets its array and is merge-scanned against the arrays of all levels.
  Where ``x`` is found twice, all windows of both suffixes repeat. The level keeps
  one entry for each ``(key, x)``, so copies don't pile up.
* Levels with equally many batches merge, so that n batches leave log n levels.
* At the end, suffixes that share their first ``anchor`` bytes but not all their
  windows are settled window by window, by a hash of key and window.

Defined cases: null text is empty text; texts under ``length`` bytes lose nothing;
rows repeated as a whole repeat each other; null ids are ids; an empty table gives
an empty result; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelspark.llm.vectext import U64, RangeHash, mix, ragged, signed, slices, text_bytes
from funnelspark.llm.workspace import Workspace

#: A repeat is this many bytes at least; at most 255 + ANCHOR_BYTES.
LENGTH = 200
#: Length of the substrings that anchor suffixes.
ANCHOR_BYTES = 64
#: Windows that are first compared together where suffixes differ.
CELL = 32
#: Batches into which one whole table is dealt.
BATCHES = 4

_RID, _TEXT = "_rid", "_text"


def _sliding(h: np.ndarray, w: int, op, pad) -> np.ndarray:
    """op over each w values in a row."""
    m = -(-len(h) // w) * w
    full = np.full(m, pad, h.dtype)
    full[: len(h)] = h
    blocks = full.reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).ravel()
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(h) - w + 1
    return op(behind[:n], ahead[w - 1 : w - 1 + n])


def sparse_suffixes(data: np.ndarray, offs: np.ndarray, length: int, k: int):
    """(text index, key, x, loc) of the anchored suffixes; loc packs first window << 16 | anchor - first << 8 | windows - 1."""
    n, w = len(data), length - k + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none.view(U64), none.view(U64), none
    ranges = RangeHash(data)
    h = ranges.fixed(k)
    least = _sliding(h, w, np.minimum, ~U64(0))
    padded = np.zeros(len(least) + 2 * (w - 1), U64)
    padded[w - 1 : w - 1 + len(least)] = least
    anchor = h == _sliding(padded, w, np.maximum, U64(0))
    at = np.flatnonzero(anchor)
    good = np.ones(len(least), bool)
    a = np.maximum(offs[:-1], offs[1:] - length + 1)
    b = np.minimum(offs[1:], len(least))
    good[ragged(np.minimum(a, b), np.maximum(b - a, 0))] = False
    s = np.flatnonzero(good)
    if not len(s):
        return none, none.view(U64), none.view(U64), none
    i = np.cumsum(anchor)[s + w - 1] - 1
    low = least[s]
    bad = np.flatnonzero(h[at[i]] != low)
    while len(bad):  # the last anchor in a window that has its least value
        i[bad] -= 1
        bad = bad[h[at[i[bad]]] != low[bad]]
    own = at[i]
    text = np.searchsorted(offs, s, "right") - 1
    cut = np.flatnonzero((own[1:] != own[:-1]) | (text[1:] != text[:-1])) + 1
    head = np.concatenate([[0], cut])
    tail = np.concatenate([cut - 1, [len(s) - 1]])
    lo, hi, own, text = s[head], s[tail], own[head], text[head]
    x = mix(ranges(lo, hi + length) + (own - lo).astype(U64))
    return text, h[own], x, ((lo - offs[text]) << 16) | ((own - lo) << 8) | (hi - lo)


def _suffixes(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, _TEXT):
                text, key, x, loc = sparse_suffixes(*text_bytes(part.column(1)), length, k)
                rid = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(signed(x)), pa.array(rid[text]), pa.array(loc)], ["key", "x", "rid", "loc"])

    return run


def _both(key: np.ndarray, other: np.ndarray) -> np.ndarray:
    """One value for a suffix's key and a fingerprint of bytes around it."""
    return mix(mix(key.view(U64)) + other)


def _contexts(length: int):
    """The bytes of all windows of the listed suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, _TEXT):
                data, offs = text_bytes(part.column(1))
                raw, lists = data.tobytes(), part.column(2)
                text = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten()
                loc = flat.field(1).to_numpy(zero_copy_only=False)
                a = offs[text] + (loc >> 16)
                b = a + (loc & 255) + length
                own = pa.array([raw[p:q] for p, q in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())
                rid = part.column(0).to_numpy(zero_copy_only=False)[text]
                yield pa.RecordBatch.from_arrays([flat.field(0), pa.array(rid), flat.field(1), flat.field(2), own], ["key", "rid", "loc", "sat", "own"])

    return run


def _cells(length: int):
    """For each cell of CELL windows (by place from the anchor) that a suffix has: the fingerprint of the bytes that all windows of the cell share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "own"):
                data, offs = text_bytes(part.column(4))
                ranges, loc = RangeHash(data), part.column(2).to_numpy(zero_copy_only=False)
                off, n = (loc >> 8) & 255, (loc & 255) + 1
                low, high = (off - n + 1) // CELL, off // CELL  # a window's place is its distance from the anchor
                each = high - low + 1
                row = np.repeat(np.arange(len(loc)), each)
                cell = ragged(low, each)
                start = offs[row] + off[row] - cell * CELL
                core = mix(ranges(start, start + length - CELL + 1) + cell.astype(U64))
                key, rid, sat = (part.column(i).to_numpy(zero_copy_only=False)[row] for i in (0, 1, 3))
                yield pa.RecordBatch.from_arrays([pa.array(signed(_both(key, core))), pa.array(rid), pa.array(loc[row]), pa.array(cell.astype(np.int8)), pa.array(sat)], ["core", "rid", "loc", "cell", "sat"])

    return run


def _windows(length: int):
    """Each window of the suffixes' listed cells: key, its fingerprint with its place, start in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "own"):
                data, offs = text_bytes(part.column(4))
                ranges, loc = RangeHash(data), part.column(2).to_numpy(zero_copy_only=False)
                off, n = (loc >> 8) & 255, (loc & 255) + 1
                lists = part.column(5)
                row = np.repeat(np.arange(len(loc)), np.diff(lists.offsets.to_numpy()))
                cell = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                first = np.maximum(cell * CELL, (off - n + 1)[row])
                each = np.minimum(cell * CELL + CELL - 1, off[row]) - first + 1
                row, place = np.repeat(row, each), ragged(first, each)
                at = off[row] - place
                start = offs[row] + at
                finger = mix(ranges(start, start + length) + place.astype(U64))
                key, rid, sat = (part.column(i).to_numpy(zero_copy_only=False)[row] for i in (0, 1, 3))
                yield pa.RecordBatch.from_arrays([pa.array(signed(_both(key, finger))), pa.array(rid), pa.array(((loc >> 16)[row] + at).astype(np.int32)), pa.array(sat)], ["finger", "rid", "at", "sat"])

    return run


class SuffixLevels:
    """The family of indexes. ``add`` takes a batch of (_rid long, _text string); ``spans`` gives all repeats found so far."""

    def __init__(self, spark: SparkSession, length: int = LENGTH, anchor: int = ANCHOR_BYTES):
        if not 0 < length - anchor < 255:
            raise ValueError("length must exceed anchor by 1 to 254 bytes")
        self.length, self.anchor = length, anchor
        self.work = Workspace(spark, "suffix")
        self.levels: list[tuple[int, DataFrame]] = []  # (batches, table), larger first
        self.marks: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        self.work.settle()
        fresh = self.work.write(batch.select(_RID, _TEXT).mapInArrow(_suffixes(self.length, self.anchor), "key long, x long, rid long, loc long"), "suffixes")
        # first() takes rid and loc from one row; either is null on the other side's rows
        new, old = F.col("new"), ~F.col("new")
        own = fresh.groupBy("key", "x").agg(F.first("rid").alias("rid"), F.first("loc").alias("loc"), (F.count("*") > 1).alias("sat"))
        parts = [own.withColumn("new", F.lit(True)), *(t.withColumn("new", F.lit(False)) for _, t in self.levels)]
        pick = lambda c, cond: F.max(F.when(cond, F.col(c)))  # noqa: E731  at most one row of each side has it
        scan = reduce(DataFrame.union, parts).groupBy("key", "x").agg(
            pick("rid", new).alias("rid"), pick("loc", new).alias("loc"), ((F.count("*") > 1) | F.max("sat")).alias("sat"), pick("rid", old & ~F.col("sat")).alias("old_rid"), pick("loc", old & ~F.col("sat")).alias("old_loc")
        )
        level = self.work.write(scan.filter("rid is not null").sortWithinPartitions("key", "x"), "level")
        repeated = fresh.join(level.filter("sat").select("key", "x"), ["key", "x"], "left_semi").select("rid", "loc")
        self.marks.append(self.work.write(repeated.union(level.filter("old_rid is not null").select("old_rid", "old_loc")), "marks"))
        self.work.drop(fresh)
        size, level = 1, self._bare(level)
        while self.levels and self.levels[-1][0] == size:
            n, below = self.levels.pop()
            level = self._merge([below, level])
            size += n
        self.levels.append((size, level))

    @staticmethod
    def _bare(level: DataFrame) -> DataFrame:
        out = level.select("key", "x", "rid", "loc", "sat")
        out._at = level._at
        return out

    def _merge(self, tables: list[DataFrame]) -> DataFrame:
        both = reduce(DataFrame.union, tables)
        merged = both.groupBy("key", "x").agg(F.first("rid").alias("rid"), F.first("loc").alias("loc"), ((F.count("*") > 1) | F.max("sat")).alias("sat"))
        out = self.work.write(merged.sortWithinPartitions("key", "x"), "merged")
        self.work.drop(*tables)
        return out

    def spans(self, docs: DataFrame, last: bool = False) -> DataFrame:
        """rid, spans: array of (from, to) in bytes, unsorted; ``docs`` are all texts added, as (_rid, _text). ``last``: no batch follows, the index may go."""
        if not self.levels:
            return docs.select(F.col(_RID).alias("rid"), F.array().cast("array<struct<a:long,b:long>>").alias("spans")).limit(0)
        self.work.settle()
        whole = self.levels[0][1] if len(self.levels) == 1 else self._merge([t for _, t in self.levels])
        open_keys = whole.groupBy("key").agg(F.count("*").alias("n"), F.min("sat").alias("all")).filter("n > 1 and not all").select("key")
        boundary = whole.join(open_keys, "key", "left_semi").select("rid", F.struct("key", "loc", "sat").alias("s"))
        lists = boundary.groupBy("rid").agg(F.collect_list("s").alias("s"))
        own = docs.join(lists, docs[_RID] == lists["rid"]).select(_RID, _TEXT, "s").mapInArrow(_contexts(self.length), "key long, rid long, loc long, sat boolean, own binary")
        own = self.work.write(own, "contexts")
        if last:
            self.work.drop(whole)
            self.levels = []
        self.work.settle()
        cells = self.work.write(own.mapInArrow(_cells(self.length), "core long, rid long, loc long, cell byte, sat boolean"), "cells")
        shared = cells.groupBy("core").agg(F.count("*").alias("n"), F.min("sat").alias("all")).filter("n > 1 and not all").select("core")
        some = cells.join(shared, "core", "left_semi").groupBy("rid", "loc").agg(F.collect_list("cell").alias("cells"))
        windows = own.join(some, ["rid", "loc"]).select("key", "rid", "loc", "sat", "own", "cells").mapInArrow(_windows(self.length), "finger long, rid long, at int, sat boolean")
        windows = self.work.write(windows, "windows")
        self.work.drop(own, cells)
        self.work.settle()
        twice = windows.groupBy("finger").agg(F.count("*").alias("n"), F.min("sat").alias("all")).filter("n > 1 and not all").select("finger")
        found = windows.filter("not sat").join(twice, "finger", "left_semi")
        single = found.select("rid", F.col("at").cast("long").alias("a"), (F.col("at") + self.length).cast("long").alias("b"))
        lo, n = F.shiftright("loc", 16), F.col("loc").bitwiseAND(255)
        runs = reduce(DataFrame.union, self.marks).select("rid", lo.alias("a"), (lo + n + self.length).alias("b"))
        return runs.union(single).groupBy("rid").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last two columns: text, spans; gives the columns before, then those of the result."""
    for batch in batches:
        for part in slices(batch, _TEXT, 1 << 23):
            data, offs = text_bytes(part.column(part.num_columns - 2))
            lists = part.column(part.num_columns - 1)
            n_removed, n_spans, digest, kept = [], [], [], []
            raw = data.tobytes()
            for i, spans in enumerate(lists):
                text = raw[offs[i] : offs[i + 1]]
                gone = runs = 0
                if spans.is_valid and len(spans.values):
                    a, b = (spans.values.field(j).to_numpy() for j in (0, 1))
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    head = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
                    first, last = a[head], b[np.concatenate([head[1:] - 1, [len(a) - 1]])]
                    gone, runs = int((last - first).sum()), len(head)
                    text = b"".join(text[p:q] for p, q in zip([0, *last.tolist()], [*first.tolist(), len(text)], strict=True))
                n_removed.append(gone)
                n_spans.append(runs)
                digest.append(hashlib.sha256(text).hexdigest())
                kept.append(text)
            new = [pa.array(np.diff(offs)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary()), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())]
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], *new], [*part.schema.names[:-2], "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes", "kept_text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, batches: int = BATCHES, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id_col, the columns ``keep``, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes (the remaining bytes), kept_text (without characters that a cut splits)."""
    text = F.col(text_col).cast("string")
    named = docs.select(F.xxhash64(F.col(id_col), text).alias(_RID), text.alias(_TEXT))
    family = SuffixLevels(docs.sparkSession, length)
    for i in range(batches):
        family.add(named.filter(F.pmod(F.xxhash64(F.lit(17), _RID), F.lit(batches)) == i))
    spans = family.spans(named, last=True)
    extra = [F.col(c) for c in dict.fromkeys((id_col, *keep))]
    rows = docs.select(F.xxhash64(F.col(id_col), text).alias(_RID), *extra, text.alias(_TEXT))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in dict.fromkeys((id_col, *keep)))
    joined = rows.join(spans, rows[_RID] == spans["rid"], "left").select(*dict.fromkeys((id_col, *keep)), _TEXT, "spans")
    return joined.mapInArrow(_cut, schema + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary, kept_text string")
