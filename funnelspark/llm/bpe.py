"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are dealt into chunks of about ``CHUNK_BYTES``. A chunk is split into pre-tokens;
each of its distinct words goes once to the task that a hash of the word names, where
each word of the whole corpus is encoded once. Ids go back to the chunks, which place
them by the positions of their pre-tokens. Words and ids travel in blobs, one for each
chunk and part, in an order that both sides can rebuild (by bytes), so a word costs
its bytes and ids and no row. Decoding looks ids up in the token-byte table, whose
size is the vocabulary's.

Defined cases: null text is empty and has no ids; repeated rows are encoded alike; a
text of any length is encoded whole; ids are longs or text that reads as one; other
columns, whatever their names, are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelspark.llm.vectext import U64, RangeHash, ragged, slices, text_bytes

CHUNK_BYTES = 8 << 20
#: Fixed value: the pattern by which texts are split; no other is taken.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of Unicode, and the contractions that the pattern names.
SPACES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
OTHER, LETTER, NUMBER, SPACE = range(4)


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    out[0xD800:0xE000] = OTHER
    out[list(SPACES)] = SPACE
    return out


def pretokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where pre-tokens start (with a last bound), and each text's first one (with a last bound).

    Splits as the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^\\sLN]+|\\s+(?!\\S)|\\s+`` does.
    """
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(len(offs), np.int64)
    point = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # byte offset of each code point
    n = len(point)
    edge = np.searchsorted(lead, offs[:-1])
    edge = edge[edge < n]
    new_text = np.zeros(n + 1, bool)
    new_text[edge] = True
    new_text[n] = True
    kind = _classes()[point]
    space = kind == SPACE
    run = new_text[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    blank = np.zeros(n, bool)  # a 0x20 of the same text comes before
    blank[1:] = (point[:-1] == 32) & ~new_text[1:n]
    start = run & (space | ~blank)
    last_space = space.copy()  # white space with something else after it in the text
    last_space[:-1] &= ~space[1:]
    last_space &= ~new_text[1:]
    start |= last_space
    quote = np.flatnonzero(start & (point == 39) & ~new_text[1:])
    if len(quote):
        ahead = np.concatenate([point, np.zeros(3, "<u4")])
        far = np.concatenate([new_text, np.ones(3, bool)])
        for c in CONTRACTIONS:
            q = quote[ahead[quote + 1] == ord(c[0])]
            if len(c) == 2:
                q = q[(ahead[q + 2] == ord(c[1])) & ~far[q + 2]]
            after = q + 1 + len(c)
            start[q + 1] = False
            inside = after[(after < n)]
            start[inside[~new_text[inside] & (kind[inside] == LETTER)]] = True
    at = np.flatnonzero(start)
    where = np.concatenate([lead[at], [len(data)]])
    return where, np.searchsorted(where[:-1], offs)


def _as_words(data: np.ndarray, where: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(where) - 1, [None, pa.py_buffer(np.ascontiguousarray(where, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def _squeezed(blob: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(blob)


def _loosened(blob: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob)


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chunk, id, text -> one row for each chunk of a batch: ids, sizes and all texts, compressed together."""
    for batch in batches:
        if not batch.num_rows:
            continue
        chunk = batch.column(0).to_numpy(zero_copy_only=False)
        batch = batch.take(pa.array(np.argsort(chunk, kind="stable")))
        chunk = np.sort(chunk)
        heads = np.concatenate([[0], np.flatnonzero(np.diff(chunk)) + 1, [len(chunk)]])
        data, offs = text_bytes(batch.column(2))
        raw, ids = data.tobytes(), batch.column(1).to_pylist()
        ends = list(zip(heads.tolist(), heads[1:].tolist(), strict=False))
        sizes = [np.diff(offs[a : b + 1]).astype("<i8").tobytes() for a, b in ends]
        texts = [_squeezed(raw[offs[a] : offs[b]]) for a, b in ends]
        yield pa.RecordBatch.from_arrays([pa.array(chunk[heads[:-1]], pa.int32()), pa.array([ids[a:b] for a, b in ends], pa.list_(pa.int64())), pa.array(sizes, pa.binary()), pa.array(texts, pa.binary())], ["chunk", "ids", "sizes", "texts"])


def _pieces(table: pa.Table) -> Iterator[tuple]:
    """(ids, bytes, offsets, pre-token offsets, first pre-tokens) of parts of a chunk's rows."""
    for ids, sizes, texts in zip(*(table.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
        offs = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<i8"))])
        column = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(offs), pa.py_buffer(_loosened(texts))])
        for part in slices(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), column], ["id", "_text"]), "_text"):
            data, offs = text_bytes(part.column(1))
            yield part.column(0), data, offs, *pretokens(data, offs)


def _distinct(table: pa.Table) -> pa.Array:
    """The chunk's distinct words, by bytes."""
    found = [_as_words(data, where).unique() for _, data, _, where, _ in _pieces(table)]
    words = pa.concat_arrays(found).unique() if found else pa.array([], pa.large_binary())
    return words.take(pc.sort_indices(words)) if len(words) else words


def _parts_of(words: pa.Array, parts: int) -> np.ndarray:
    data, offs = text_bytes(words)
    return (RangeHash(data)(offs[:-1], offs[1:]) % U64(parts)).astype(np.int64) if len(words) else np.zeros(0, np.int64)


_WORDS = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("sizes", pa.binary()), ("words", pa.binary())])
_IDS = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("counts", pa.binary()), ("ids", pa.binary())])


def _send(parts: int):
    def run(table: pa.Table) -> pa.Table:
        words = _distinct(table)
        part = _parts_of(words, parts)
        chunk, rows = table.column(0)[0].as_py(), []
        for p in np.unique(part).tolist():
            data, offs = text_bytes(words.filter(pa.array(part == p)))
            rows.append({"part": p, "chunk": chunk, "sizes": _squeezed(np.diff(offs).astype("<u4").tobytes()), "words": _squeezed(data.tobytes())})
        return pa.Table.from_pylist(rows, _WORDS)

    return run


class Vocabulary:
    """The ranks of a tiktoken file."""

    def __init__(self, path: str, pattern: str):
        if pattern != PATTERN:
            raise ValueError(f"texts are split by {PATTERN!r} only")
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = pattern

    @functools.cached_property
    def encoding(self):
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})

    @functools.cached_property
    def token_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """The token-byte table: all tokens' bytes, and each id's start (with a last bound)."""
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            tokens[i] = token
        return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and how many each has."""
        data, start = self.token_bytes
        size = start[ids + 1] - start[ids]
        return data[ragged(start[ids], size)], size


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def _encode(path: str, pattern: str):
    """Rows come by part; each distinct word of a part is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = vocabulary(path, pattern).encoding._core_bpe.encode_single_piece
        now, known = None, {}
        for batch in batches:
            out = []
            for part, chunk, sizes, words in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if part != now:
                    now, known = part, {}
                sizes, words = _loosened(sizes), _loosened(words)
                ends, a, ids = np.cumsum(np.frombuffer(sizes, "<u4")).tolist(), 0, []
                for b in ends:
                    word = words[a:b]
                    a = b
                    if (got := known.get(word)) is None:
                        got = known[word] = single(word)
                    ids.append(got)
                flat = np.array([i for x in ids for i in x], "<u4")
                out.append({"part": part, "chunk": chunk, "counts": _squeezed(np.array([len(x) for x in ids], "<u4").tobytes()), "ids": _squeezed(flat.tobytes())})
            yield pa.RecordBatch.from_pylist(out, _IDS)

    return run


def _assemble(path: str, pattern: str, parts: int, with_ids: bool):
    def run(texts: pa.Table, coded: pa.Table) -> pa.Table:
        vocab = vocabulary(path, pattern)
        words = _distinct(texts)
        by_part = np.argsort(_parts_of(words, parts), kind="stable")
        blobs = sorted(zip(coded.column("part").to_pylist(), coded.column("counts").to_pylist(), coded.column("ids").to_pylist(), strict=True))
        counts = np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(_loosened(c), "<u4") for _, c, _ in blobs)]).astype(np.int64)
        ids = np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(_loosened(x), "<u4") for _, _, x in blobs)])
        if len(counts) != len(words):
            raise ValueError("a chunk's words and their ids differ in number")
        first, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        size[by_part] = counts
        first[by_part] = np.cumsum(counts) - counts
        out = []
        for own_ids, data, _, where, heads in _pieces(texts):
            coded_words = _as_words(data, where).dictionary_encode()
            known = pc.index_in(coded_words.dictionary, value_set=words).to_numpy(zero_copy_only=False)
            at = known[coded_words.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.int64)
            own = ids[ragged(first[at], size[at])]
            bounds = np.concatenate([[0], np.cumsum(size[at])])[heads]
            raw, each = vocab.decode(own.astype(np.int64))
            cuts = np.concatenate([[0], np.cumsum(each)])[bounds]
            le, raw = own.astype("<u4"), raw.tobytes()
            pairs = list(zip(bounds.tolist(), bounds[1:].tolist(), strict=False))
            cols = [own_ids, pa.array(np.diff(bounds).astype(np.int64)), pa.array([hashlib.sha256(le[a:b]).hexdigest() for a, b in pairs], pa.string())]
            cols.append(pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)], pa.string()))
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(own.astype(np.int32))))
            out.append(pa.RecordBatch.from_arrays(cols, ["id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]))
        fields = [("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32()))] * with_ids
        return pa.Table.from_batches(out, pa.schema(fields)) if out else pa.schema(fields).empty_table()

    return run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per document: id (long), n_tokens, ids_sha256, decoded_sha256 (of the decoded ids), ids array<int> if ``with_ids``."""
    vocabulary(path, pattern)  # rejects other patterns
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    total = docs.select(F.sum(F.octet_length(text)).alias("n")).first().n or 0
    chunks = max(1, total // CHUNK_BYTES)
    parts = min(4096, max(16, chunks // 8))
    dealt = docs.select(F.pmod(F.xxhash64(F.col(id_col), text), F.lit(chunks)).cast("int").alias("chunk"), F.col(id_col).cast("long").alias("id"), text.alias("_text"))
    dealt = dealt.mapInArrow(_bundle, "chunk int, ids array<long>, sizes binary, texts binary").repartition(max(1, chunks // 2), "chunk")
    words = dealt.groupBy("chunk").applyInArrow(_send(parts), "part int, chunk int, sizes binary, words binary")
    coded = words.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_encode(path, pattern), "part int, chunk int, counts binary, ids binary")
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    out = dealt.groupBy("chunk").cogroup(coded.groupBy("chunk")).applyInArrow(_assemble(path, pattern, parts, with_ids), schema)
    return out.withColumnRenamed("id", id_col)


def _decode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for batch in batches:
            lists = batch.column(1)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            raw, each = vocab.decode(ids)
            heads = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
            cuts, raw = np.concatenate([[0], np.cumsum(each)])[heads], raw.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)], pa.binary())], ["id", "decoded"])

    return run


def decode(coded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id (long), decoded (binary) of each row's ids; null ids are none."""
    rows = coded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decode(path, pattern), "id long, decoded binary").withColumnRenamed("id", id_col)
