"""Quality rules: an n-gram log-likelihood ratio over plain counts of a text.

A text's score is the mean, over its words and pairs of words hashed to bins, of
log(p_target / p_raw). Both multinomials are smoothed; the raw one counts every document
of the corpus, the target one every document labelled good. There are 64 bins or more
for each distinct n-gram (by a sketch of fixed size), so their number grows with the
corpus, and the counts stay distributed: texts are taken in bundles, each bundle sends
its bins, with document and count, compressed to the blocks of bins, and a block returns
what it adds to the sum of each document. Texts are read twice in the same order for it,
and a run fails if they come in another. Sums are in fixed point, so that the same rows
always give the same verdicts. The threshold comes from the scores of all labelled
documents, good ones scored as if they were not in the target: the middle of the gap
between bad and good ones, and never more than the score below which ``SPARED`` of the
good ones lie.

Defined cases: null text has no words; texts that fail the base rules are not kept;
without labelled rows of both kinds nothing but the base rules rejects; a document
labelled twice has its lower label; an empty table gives an empty result; input
columns that clash with the new ones are replaced.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelspark.llm.vectext import U64, RangeHash, mix, shingle_hashes, slices, text_bytes, words
from funnelspark.llm.workspace import Workspace

#: Bins of a corpus, at least, and for each distinct n-gram.
LEAST_BINS, BINS_EACH = 1 << 16, 64
#: Registers (a power of two) of the sketch that counts distinct n-grams.
REGISTERS = 1 << 14
#: Bytes and texts of a bundle, about.
BUNDLE, BUNDLE_TEXTS = 8 << 20, 50_000
#: Bytes of sums that a task holds before it hands them on.
HELD = 64 << 20
#: Fixed point of the sums, and bins of the labelled scores' histogram for each unit.
FIXED, FINE = float(1 << 30), 10_000.0
#: Weight of the raw multinomial in the target's smoothing, in n-grams.
PRIOR = 20_000.0
#: Share of good labelled documents that may fall under the threshold.
SPARED = 0.001
#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, REPEAT_PERCENT = 50, 50
NEW = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


class Features:
    """Words and n-gram bins of several texts."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs = data, offs
        self.start, self.end, self.first = words(data, offs)
        self.ranges = RangeHash(data)
        self.word = self.ranges(self.start, self.end) if len(self.start) else np.zeros(0, U64)
        self.n = np.diff(self.first)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text of each n-gram."""
        text = np.repeat(np.arange(len(self.n)), self.n)
        pair = shingle_hashes(self.word, 2)
        same = text[1:] == text[:-1]
        both = np.concatenate([mix(self.word + U64(1)), pair[same]])
        return both, np.concatenate([text, text[1:][same]])

    def _each(self, per_byte: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(per_byte)])
        return total[self.offs[1:]] - total[self.offs[:-1]]

    def word_chars(self) -> np.ndarray:
        lead = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        each = np.concatenate([[0], np.cumsum(lead[self.end] - lead[self.start])]) if len(self.start) else np.zeros(1, np.int64)
        return each[self.first[1:]] - each[self.first[:-1]]

    def symbols(self) -> np.ndarray:
        return self._each(_IS_SYMBOL[self.data])

    def dup_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of the text."""
        ends = np.flatnonzero(self.data == 10)
        start = np.unique(np.concatenate([self.offs[:-1], ends + 1]))
        start = start[start < len(self.data)]
        if not len(start):
            return np.zeros(len(self.n), np.int64)
        stop = np.concatenate([start[1:], [len(self.data)]])
        stop = stop - ((self.data[stop - 1] == 10) & (stop > start))
        used = np.searchsorted(self.start, stop) > np.searchsorted(self.start, start)
        start, stop = start[used], stop[used]
        text = np.searchsorted(self.offs, start, "right") - 1
        key = mix(self.ranges(start, stop) + mix(text.astype(U64) + U64(1)))
        _, once = np.unique(key, return_index=True)
        return np.bincount(text, minlength=len(self.n)) - np.bincount(text[once], minlength=len(self.n))

    def repeat_words(self) -> np.ndarray:
        """Words in windows of three words that the text has twice or more."""
        out = np.zeros(len(self.n), np.int64)
        for i, (a, b) in enumerate(zip(self.first.tolist(), self.first[1:].tolist(), strict=False)):
            if b - a < 4:
                continue
            g = shingle_hashes(self.word[a:b], 3)
            order = np.argsort(g, kind="stable")
            same = g[order][1:] == g[order][:-1]
            if same.any():
                again = np.zeros(b - a, bool)
                at = np.concatenate([order[1:][same], order[:-1][same]])
                again[at] = again[at + 1] = again[at + 2] = True
                out[i] = again.sum()
        return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> n-grams and the HyperLogLog registers of a task."""
    n, top = 0, np.zeros(REGISTERS, np.uint8)
    for batch in batches:
        for part in slices(batch, "_text"):
            g, _ = Features(*text_bytes(part.column(0))).grams()
            g = mix(g)
            n += len(g)
            low = ((g >> U64(14)) & U64((1 << 50) - 1)).astype(float)  # under 2^50: exact
            rank = np.where(low > 0, 51 - np.frexp(low)[1], 51).astype(np.uint8)
            np.maximum.at(top, (g & U64(REGISTERS - 1)).astype(np.int64), rank)
    at = np.flatnonzero(top)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([n, *top[at].tolist()], pa.int64())], ["i", "v"])


def _sizes(texts: DataFrame) -> tuple[int, int]:
    """N-grams of the corpus, and about how many distinct ones."""
    found = texts.mapInArrow(_sketch, "i int, v long").groupBy("i").agg(F.sum("v").alias("n"), F.max("v").alias("v")).collect()  # REGISTERS + 1 rows at most
    n = sum(r.n for r in found if r.i < 0)
    top = np.zeros(REGISTERS)
    for r in found:
        if r.i >= 0:
            top[r.i] = r.v
    zeros = int((top == 0).sum())
    guess = 0.7213 / (1 + 1.079 / REGISTERS) * REGISTERS**2 / np.exp2(-top).sum()
    if zeros and guess <= 2.5 * REGISTERS:
        guess = REGISTERS * np.log(REGISTERS / zeros)
    return n, max(1, round(float(guess)))


def _bits(x: np.ndarray, k: int) -> bytes:
    """The low k bits of each value, one after the other."""
    return np.packbits((x[:, None] >> np.arange(k)).astype(np.uint8) & 1).tobytes()


def _unbits(raw: memoryview, n: int, k: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n * k).reshape(n, k).astype(np.int64) @ (1 << np.arange(k))


def _planes(x: np.ndarray) -> bytes:
    """Values byte by byte, as many bytes as the largest one needs."""
    size = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([size]) + np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _packed(bin_: np.ndarray, doc: np.ndarray, times: np.ndarray) -> bytes:
    """Entries by bin and text: what is evenly spread as bits, the rest (gaps' high bits, texts of a bin, gaps between them, counts) compressed."""
    new = np.diff(bin_, prepend=-1) != 0
    first = np.flatnonzero(new)
    gap, own = np.diff(bin_[first], prepend=0), doc[first]
    k, kd = int(gap.mean() + 1).bit_length() - 1, int(own.max()).bit_length()
    small = b"".join(map(_planes, (gap >> k, np.diff(first, append=len(bin_)) - 1, np.diff(doc, prepend=0)[~new] - 1, times - 1)))
    return struct.pack("<IIBB", len(first), len(small), k, kd) + _bits(gap, k) + _bits(own, kd) + pa.compress(small, "zstd", asbytes=True)


def _unpacked(blob: bytes, rows: int) -> list[np.ndarray]:
    """bin, text and count of each entry."""
    n, size, k, kd = struct.unpack_from("<IIBB", blob)
    raw = memoryview(blob)
    a = struct.calcsize("<IIBB")
    b = a + (n * k + 7) // 8
    c = b + (n * kd + 7) // 8
    small, at, columns = np.frombuffer(pa.decompress(raw[c:], size, "zstd"), np.uint8), 0, []
    for m in (n, n, rows - n, rows):
        wide = int(small[at])
        each = small[at + 1 : at + 1 + m * wide].reshape(wide, m).astype(np.int64)
        columns.append((each << (8 * np.arange(wide))[:, None]).sum(axis=0))
        at += 1 + m * wide
    high, more, ahead, times = columns
    first = np.cumsum(more + 1) - more - 1
    bin_ = np.repeat(np.cumsum((high << k) + _unbits(raw[a:b], n, k)), more + 1)
    step = np.zeros(rows, np.int64)
    later = np.ones(rows, bool)
    later[first] = False
    step[later] = ahead + 1
    total = np.cumsum(step)
    return [bin_, np.repeat(_unbits(raw[b:c], n, kd) - total[first], more + 1) + total, times + 1]


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Number and rows of each bundle; the number depends on the rows (column 1), so that another scan can't take it for others."""
    at, held, size, texts = TaskContext.get().partitionId() << 32, [], 0, 0

    def out() -> tuple[int, pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key = rows.column(1).to_numpy(zero_copy_only=False).astype("<i8").view(U64)
        told = mix(key + np.arange(len(key), dtype=U64)).sum(dtype=U64) + mix(np.array([at], U64))[0]
        return int(told.view(np.int64)), rows

    for batch in batches:
        for part in slices(batch, "_text"):
            held.append(part)
            size += part.column(part.num_columns - 1).nbytes
            texts += part.num_rows
            if size >= BUNDLE or texts >= BUNDLE_TEXTS:
                yield out()
                at, held, size, texts = at + 1, [], 0, 0
    if texts:
        yield out()


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, key, hash, text -> id, hash, bundle, number in it."""
    for bundle, rows in _bundles(batches):
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(np.full(rows.num_rows, bundle)), pa.array(np.arange(rows.num_rows))], ["_doc", "h", "bundle", "i"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bundle, hashes, qualities -> the same compressed."""
    for batch in batches:
        packed = [[pa.compress(np.array(x, k).tobytes(), "zstd", asbytes=True) for x in batch.column(c).to_pylist()] for c, k in ((1, "<i8"), (2, "i1"))]
        n = [len(x) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), *(pa.array(x, pa.binary()) for x in packed)], ["bundle", "n", "hashes", "qualities"])


def _sums_blob(sums: np.ndarray) -> bytes:
    """n-grams, sum and (as its difference) sum without the own counts of each text, compressed byte by byte."""
    x = np.concatenate([sums[:2], sums[2:] - sums[1:2]]).astype("<i8")
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(3, -1, 8).transpose(0, 2, 1)).tobytes(), "zstd", asbytes=True)


_SENT = "part int, block long, bundle long, n int, blob binary"


def _sent(bins: int, blocks: int, parts: int):
    """id, key, hash, text -> for each bundle and block: bin, number of the text and count."""
    width = bins // blocks

    def of(bundle: int, rows: pa.RecordBatch) -> pa.RecordBatch:
        keys, at, n = [], 0, np.zeros((3, rows.num_rows), np.int64)
        for part in slices(rows, "_text"):  # hashing takes many times the room of its bytes
            gram, doc = Features(*text_bytes(part.column(3))).grams()
            keys.append((gram & U64(bins - 1)) << U64(17) | (doc + at).astype(U64))  # a bundle has fewer texts than 2^17
            n[0, at : at + part.num_rows] = np.bincount(doc, minlength=part.num_rows)
            at += part.num_rows
        key, times = np.unique(np.concatenate(keys), return_counts=True)
        del keys, gram, doc
        bin_, doc = (key >> U64(17)).astype(np.int64), (key & U64((1 << 17) - 1)).astype(np.int64)
        block = bin_ // width
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]]).tolist() if len(block) else [0]
        blobs = [_packed(bin_[a:b] - block[a] * width, doc[a:b], times[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        first = np.concatenate([[-2], block[cuts[:-1]]])  # block -2: the texts' numbers of n-grams
        part = np.concatenate([[bundle % parts], first[1:] % parts])
        sizes = pa.array([rows.num_rows, *np.diff(cuts).tolist()], pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(first, pa.int64()), pa.array(np.full(len(first), bundle)), sizes, pa.array([_sums_blob(n), *blobs], pa.binary())], ["part", "block", "bundle", "n", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bundle, rows in _bundles(batches):
            yield of(bundle, rows)

    return run


def _grouped(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[list[tuple]]:
    """Rows with the same first ``keys`` values; such rows come together."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _added(grams: int, distinct: int):
    """part, block, bundle, n, blob by part and block -> what blocks add to each text of a bundle: n-grams, sum, sum as if it were not in the target.

    The first rows of a part are numbers of n-grams, which go on as they are (block -2), and the labels of all bundles (block -1).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels: dict[int, np.ndarray] = {}
        sums: dict[int, np.ndarray] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            blobs = [_sums_blob(x) for x in sums.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.shape[1] for x in sums.values()], pa.int32()), pa.array(blobs, pa.binary())], ["bundle", "n", "blob"])

        for rows in _grouped(batches, 2):
            if rows[0][1] == -2:
                yield pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int32()), pa.array([r[4] for r in rows], pa.binary())], ["bundle", "n", "blob"])
                continue
            if rows[0][1] < 0:
                labels = {r[2]: np.frombuffer(pa.decompress(r[4], r[3], "zstd"), "i1") for r in rows}
                continue
            if not all(r[2] in labels for r in rows):
                raise RuntimeError("the documents came in another order when they were read again; write them to a table first")
            each = [_unpacked(r[4], r[3]) for r in rows]
            at = np.unique(np.concatenate([p[0] for p in each]), return_inverse=True)[1]
            times = np.concatenate([p[2] for p in each])
            own = times * np.concatenate([labels[r[2]][p[1]] == 1 for r, p in zip(rows, each, strict=True)])
            raw = ((np.bincount(at, weights=times) + 1) / (grams + distinct))[at]
            target = np.bincount(at, weights=own)[at]
            whole = np.rint(times * np.log(target / raw + PRIOR) * FIXED)
            without = np.rint(times * np.log((target - own) / raw + PRIOR) * FIXED)
            a = 0
            for r, p in zip(rows, each, strict=True):
                b, n = a + r[3], len(labels[r[2]])
                if r[2] not in sums:
                    sums[r[2]] = np.zeros((3, n), "<i8")
                    size += sums[r[2]].nbytes
                for i, x in ((1, whole), (2, without)):
                    np.add.at(sums[r[2]][i], p[1], x[a:b].astype(np.int64))
                a = b
            if size > HELD:
                yield flush()
                sums, size = {}, 0
        if sums:
            yield flush()

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bundle, n, hashes, qualities, blobs -> hash, quality (2 without), n-grams and sums of each text."""
    for batch in batches:
        for _, n, hashes, qualities, blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            total = np.zeros((3, n), "<i8")
            for blob in blobs or []:
                each = np.frombuffer(pa.decompress(blob, n * 24, "zstd"), np.uint8).reshape(3, 8, n).transpose(0, 2, 1)
                total += np.ascontiguousarray(each).view("<i8").reshape(3, n)
            total[2] += total[1]
            h = np.frombuffer(pa.decompress(hashes, n * 8, "zstd"), "<i8")
            q = np.frombuffer(pa.decompress(qualities, n, "zstd"), "i1")
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(q.astype(np.int64)), pa.array(total[0]), pa.array(total[1] / FIXED), pa.array(total[2] / FIXED)], ["h", "quality", "n", "whole", "without"])


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "_text"):
            f = Features(*text_bytes(part.column(part.num_columns - 1)))
            repeated = f.repeat_words()
            failed = (f.n < LEAST_WORDS) | (100 * repeated > REPEAT_PERCENT * f.n)
            new = [f.n, f.word_chars(), f.symbols(), f.dup_lines(), repeated, failed]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, new)], [*part.schema.names[:-1], *NEW[:-2]])


def _edge(hist: dict[int, int], share: float) -> int:
    """The histogram's bin that holds the value below which ``share`` of all lie."""
    left = int(share * sum(hist.values()))
    for b in sorted(hist):
        left -= hist[b]
        if left < 0:
            return b
    return max(hist)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame | None, float]:
    """(h hash of text, score) and the threshold; (None, -inf) without labels of both kinds."""
    work = Workspace(docs.sparkSession, "quality")
    text = F.col(text_col).cast("string")
    known = labels.groupBy(F.col(id_col).alias("_id")).agg(F.min("quality").cast("int").alias("_quality")).filter("_id is not null and _quality in (0, 1)")
    grams, distinct = _sizes(docs.select(text.alias("_text")))
    bins = max(LEAST_BINS, 1 << (BINS_EACH * distinct - 1).bit_length())
    blocks = 1 << max(4, bins.bit_length() // 2 - 4)  # rows of blobs are bundles x blocks: both grow with less than the bins
    parts = blocks // 16  # each gets all labels, a byte a text before compression
    rows = docs.select(F.col(id_col).alias("_doc"), F.xxhash64(F.col(id_col), text).alias("_key"), F.xxhash64(text).alias("h"), text.alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    placed = rows.mapInArrow(_rows_of, f"_doc {kind}, h long, bundle long, i long")
    placed = placed.join(known, placed["_doc"] == known["_id"], "left").select("bundle", F.struct("i", "h", F.coalesce("_quality", F.lit(2)).alias("q")).alias("x"))
    lists = placed.groupBy("bundle").agg(F.array_sort(F.collect_list("x")).alias("x")).select("bundle", "x.h", "x.q")  # at most BUNDLE_TEXTS and one slice
    lists = work.write(lists.mapInArrow(_listed, "bundle long, n int, hashes binary, qualities binary"), "lists")
    each = lists.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(-1).cast("long").alias("block"), "bundle", "n", F.col("qualities").alias("blob"))
    sent = rows.mapInArrow(_sent(bins, blocks, parts), _SENT).union(each).repartition("part").sortWithinPartitions("part", "block", "bundle")
    added = sent.mapInArrow(_added(grams, distinct), "bundle long, n int, blob binary").groupBy("bundle").agg(F.collect_list("blob").alias("blobs"))
    joined = lists.join(added, "bundle", "left").select("bundle", "n", "hashes", "qualities", "blobs")
    sums = work.write(joined.mapInArrow(_summed, "h long, quality long, n long, whole double, without double"), "sums")
    work.settle()
    seen = sums.agg(F.sum(F.when(F.col("quality") == 1, F.col("n"))).alias("t"), F.count(F.when(F.col("quality") == 0, 1)).alias("bad")).first()
    if not seen.t or not seen.bad:
        return None, -np.inf
    n = F.greatest(F.col("n"), F.lit(1))
    score = F.when(F.col("n") == 0, 0.0).otherwise(F.col("whole") / n - F.log(F.lit(seen.t + PRIOR)))
    own = F.when(F.col("n") == 0, 0.0).otherwise(F.col("without") / n - F.log(F.lit(seen.t + PRIOR) - F.col("n")))
    at = F.floor(F.when(F.col("quality") == 1, own).otherwise(score) * FINE).alias("at")
    good, bad = {}, {}
    for r in sums.filter("quality in (0, 1)").groupBy("quality", at).count().collect():  # bins of a bounded range
        (good if r.quality == 1 else bad)[r["at"]] = r["count"]
    low, high = _edge(good, SPARED) / FINE, (_edge(bad, 0.95) + 1) / FINE
    return sums.groupBy("h").agg(F.max(score).alias("score")), (low + high) / 2 if high < low else low


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Columns ``keep`` (all) of ``docs`` with the base figures, base_failed, score and kept, for every row."""
    scores, threshold = fit(docs, labels, id_col, text_col)
    cols = [c for c in (docs.columns if keep is None else keep) if c not in NEW]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = "".join(f"`{c}` {kinds[c]}, " for c in cols) + "_h long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
    text = F.col(text_col).cast("string")
    out = docs.select(*cols, F.xxhash64(text).alias("_h"), text.alias("_text")).mapInArrow(_figures, schema)
    if scores is None:
        return out.drop("_h").withColumns({"score": F.lit(0.0), "kept": ~F.col("base_failed")})
    out = out.join(scores, out["_h"] == scores["h"], "left").drop("_h", "h")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
