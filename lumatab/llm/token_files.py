"""Token ids in wavelet-matrix shards (operator 3).

A shard holds the ids of a run of documents as a wavelet matrix: one bit plane for each bit of an id,
each plane stably sorting the ids by that bit for the plane below. Planes are cut into blocks, each
compressed by itself, with the number of ones before every block, so that reading one id, counting an id
in a prefix and finding its k-th occurrence touch a few blocks of one file and nothing else.

Layout (little-endian): magic, n_ids u64, n_docs u64, n_planes u32, block_bits u32, length u64 and bytes of
the document table (zstd of: ids as deltas i64, null flags u8, lengths i64); for each plane zeros u64,
n_blocks u64, ones before each block u64, end of each block in the plane's bytes u64, the blocks (zstd).

Ids come from the vocabulary of a byte-level BPE file of the tokenizers library. The merges run in
tiktoken, which gives the same ids from the same vocabulary about four times as fast; tests hold the two
equal, and special tokens in a text become their ids, as they do in the library by default. A text that
tiktoken refuses (it gives up on runs of about a million white-space characters) is encoded by the library.

Defined cases: a null or empty text has only the end id; a null id sorts first; rows with equal ids are
ordered by text; an empty table gives no files and no rows; other columns are not read.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumatab.llm import shared

MAGIC = b"LTWM0001"
BLOCK_BITS = 1 << 16
#: GPT-2's published pre-split pattern, the one that the library's byte-level step uses. Fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def library(path: str):
    """The tokenizers library's own encoder of a file."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def encoder(path: str):
    """A function from a text to its ids (uint32), for a byte-level BPE file of the tokenizers library."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"], spec["model"]
    if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or model.get("ignore_merges"):
        raise ValueError(f"{path}: only plain byte-level BPE files are supported")
    symbols, special = byte_symbols(), {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(symbols[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in merges]
    if made != sorted(made):
        raise ValueError(f"{path}: ids must be in the order of the merges")
    core = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special)

    def ids(text: str) -> np.ndarray:
        try:
            return core.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())
        except ValueError:  # its splitter keeps a stack of bounded size for a run of white space
            return np.array(library(path).encode(text, add_special_tokens=False).ids, np.uint32)

    return ids


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard of the documents' ids, one after the other."""
    n, squeeze = len(ids), zstandard.ZstdCompressor(level=1).compress
    top = max(1, int(ids.max()).bit_length()) if n else 1
    cur = ids.astype(np.uint16 if top <= 16 else np.uint32)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    table = squeeze(np.diff(keys, prepend=np.int64(0)).astype("<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes() + lengths.astype("<i8").tobytes())
    out = [MAGIC, struct.pack("<QQIIQ", n, len(doc_ids), top, BLOCK_BITS, len(table)), table]
    step = BLOCK_BITS // 8
    for plane in range(top - 1, -1, -1):
        bit = (cur & cur.dtype.type(1 << plane)).astype(bool)
        packed = np.packbits(bit, bitorder="little").tobytes()
        blocks = [packed[i : i + step] for i in range(0, len(packed), step)]
        ones = np.array([np.count_nonzero(bit[i : i + BLOCK_BITS]) for i in range(0, n, BLOCK_BITS)], "<u8")
        small = [squeeze(b) for b in blocks]
        out += [struct.pack("<QQ", n - int(ones.sum()), len(small)), (np.cumsum(ones) - ones).astype("<u8").tobytes(), np.cumsum([len(b) for b in small], dtype="<u8").tobytes(), *small]
        if plane:
            cur = np.concatenate([cur[~bit], cur[bit]])
    return b"".join(out)


class Shard:
    """Reads a shard from any buffer: bytes, or a memory map of the file. Only blocks that are asked for are inflated."""

    def __init__(self, data) -> None:
        self.data = memoryview(data)
        if bytes(self.data[:8]) != MAGIC:
            raise ValueError("not a shard")
        self.n, self.n_docs, self.n_planes, self.block_bits, size = struct.unpack_from("<QQIIQ", self.data, 8)
        at = 8 + struct.calcsize("<QQIIQ")
        raw = self._inflate(self.data[at : at + size])
        k, at = self.n_docs, at + size
        nulls = np.frombuffer(raw, np.uint8, k, 8 * k)
        self.doc_ids = [None if z else int(d) for d, z in zip(np.cumsum(np.frombuffer(raw, "<i8", k)), nulls, strict=True)]
        self.lengths = np.frombuffer(raw, "<i8", k, 9 * k)
        self.planes = []
        for _ in range(self.n_planes):
            zeros, m = struct.unpack_from("<QQ", self.data, at)
            before, ends = (np.frombuffer(self.data, "<u8", m, at + 16 + 8 * m * i) for i in (0, 1))
            at += 16 + 16 * m
            self.planes.append((zeros, before, ends, at))
            at += int(ends[-1]) if m else 0
        self._block = lru_cache(256)(self._read)

    def _inflate(self, data) -> bytes:
        return zstandard.ZstdDecompressor().decompress(data)

    def _read(self, plane: int, b: int) -> np.ndarray:
        _, _, ends, at = self.planes[plane]
        raw = self._inflate(self.data[at + (int(ends[b - 1]) if b else 0) : at + int(ends[b])])
        return np.frombuffer(raw, np.uint8)

    def _ones(self, plane: int, i: int) -> int:
        """Ones among a plane's first i bits."""
        b, r = divmod(i, self.block_bits)
        zeros, before, _, _ = self.planes[plane]
        if b == len(before):
            return self.n - zeros
        block = self._block(plane, b)
        full = int(np.bitwise_count(block[: r // 8]).sum())
        return int(before[b]) + full + (int(block[r // 8] & ((1 << r % 8) - 1)).bit_count() if r % 8 else 0)

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.n_planes):
            bit = int(self._block(p, i // self.block_bits)[i % self.block_bits // 8]) >> i % 8 & 1
            ones = self._ones(p, i)
            i = self.planes[p][0] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _span(self, symbol: int, end: int) -> tuple[int, int]:
        """Where the symbol's occurrences before `end` stand below the last plane."""
        lo, hi = 0, end
        for p in range(self.n_planes):
            a, b = self._ones(p, lo), self._ones(p, hi)
            lo, hi = (self.planes[p][0] + a, self.planes[p][0] + b) if symbol >> (self.n_planes - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, symbol: int, end: int | None = None) -> int:
        """Occurrences of an id before place `end`."""
        if symbol < 0 or symbol >> self.n_planes or not self.n:
            return 0
        lo, hi = self._span(symbol, self.n if end is None else min(end, self.n))
        return hi - lo

    count = rank

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        """The place of a plane's k-th (from 0) bit of that value."""
        _, before, _, _ = self.planes[plane]
        starts = before.astype(np.int64)
        if not bit:
            starts = np.arange(len(before), dtype=np.int64) * self.block_bits - starts
        b = int(np.searchsorted(starts, k, side="right")) - 1
        bits = np.unpackbits(self._block(plane, b), bitorder="little")[: self.n - b * self.block_bits]
        return b * self.block_bits + int(np.flatnonzero(bits == bit)[k - int(starts[b])])

    def select(self, symbol: int, k: int) -> int:
        """The place of the id's k-th occurrence (from 0)."""
        if symbol < 0 or symbol >> self.n_planes or not self.n:
            raise IndexError(k)
        lo, hi = self._span(symbol, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for p in range(self.n_planes - 1, -1, -1):
            bit = symbol >> (self.n_planes - 1 - p) & 1
            i = self._select_bit(p, bit, i - self.planes[p][0] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids in order."""
        cur = np.zeros(self.n, np.uint16 if self.n_planes <= 16 else np.uint32)
        for p in range(self.n_planes - 1, -1, -1):
            zeros, before, _, _ = self.planes[p]
            packed = b"".join(self._read(p, b).tobytes() for b in range(len(before)))
            bit = np.unpackbits(np.frombuffer(packed, np.uint8), count=self.n, bitorder="little").view(bool)
            up = np.empty_like(cur)
            up[~bit] = cur[:zeros]
            up[bit] = cur[zeros:] | cur.dtype.type(1 << (self.n_planes - 1 - p))
            cur = up
        return cur


def _store(uri: str, name: str, data: bytes) -> None:
    """Writes a file whole or not at all: a second attempt of a lost task puts the same bytes in its place."""
    files, path = pafs.FileSystem.from_uri(uri)
    task = TaskContext.get()
    part = f"{path}/.{name}.{task.taskAttemptId() if task else 0}"
    with files.open_output_stream(part) as f:
        f.write(data)
    files.move(part, f"{path}/{name}")


def write_shards(docs: DataFrame, uri: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = 1 << 24) -> DataFrame:
    """Encodes every text and writes shards to a folder that all executors see, documents in ascending id order.

    One range shuffle of the texts; a task streams its range and holds one shard's ids at a time. Returns
    (name, n_docs, n_ids, start) of every shard; the order of names is the order of documents.
    """
    spark = docs.sparkSession
    files, path = pafs.FileSystem.from_uri(uri)
    files.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, made = encoder(vocabulary), TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        size, tail = 0, np.array([end_id], np.uint32)

        def flush():
            nonlocal keys, held, size, made
            name = f"part-{part:07d}-{made:05d}.wm"
            _store(uri, name, pack(keys, np.array([len(x) + 1 for x in held[::2]], np.int64), np.concatenate(held)))
            row = pa.RecordBatch.from_pydict({"name": [name], "n_docs": [len(keys)], "n_ids": [size]})
            keys, held, size, made = [], [], 0, made + 1
            return row

        for b in batches:
            for key, text in zip(b.column(0), b.column(1), strict=True):
                ids = encode(text.as_py() or "")
                keys.append(key.as_py())
                held += [ids, tail]
                size += len(ids) + 1
                if size >= shard_ids:
                    yield flush()
        if keys:
            yield flush()

    ordered = (
        docs.select(F.col(id_col).cast("bigint").alias("k"), F.col(text_col).cast("string").alias("t"))
        .withColumn("h", F.xxhash64("t"))
        .repartitionByRange("k", "h")
        .sortWithinPartitions("k", "h", "t")
        .select("k", "t")
    )
    made, _ = shared.written(ordered.mapInArrow(run, "name string, n_docs bigint, n_ids bigint"), "token-manifest")
    # one short row a shard
    return made.withColumn("start", F.coalesce(F.sum("n_ids").over(Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def read_shards(manifest: DataFrame, uri: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of every document, from the files alone; starts come from the manifest."""
    spark = manifest.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                shard = Shard(content.as_buffer())
                ids = shard.decode().astype("<u4")
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * shard.n_docs, pa.string()), pa.array(shard.doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(shard.lengths, pa.int64()),
                        pa.array([zlib.crc32(ids[i:j].data) for i, j in zip(starts, ends, strict=True)], pa.int64()),
                    ],
                    ["name", "doc_id", "inner", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "part-*.wm").load(uri)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(run, "name string, doc_id bigint, inner bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(manifest.select("name", "start"), "name").select("doc_id", (F.col("start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", F.col("name").alias("shard"))
