"""Token-ID output as directly addressable codes.

A block holds the ids of consecutive documents. Each id is split into 8-bit chunks, lowest first.
Level k stores the k-th chunk of the ids that have one, a bitmap that tells which of them go on to
level k + 1, and a rank directory with the number of set bits before each 512-bit stretch. Token i
is read by following its chunks: its place in level k + 1 is the rank of its place in level k. So
any token is read without decoding the block.

A file is blocks one after the other, in ascending order of doc_id and not compressed, then a footer
with where they begin, then where the footer begins; `token_at` reads a token of a table of any size
by a few small reads at known places. Spark writes the bytes as lines of text files, so its commit
protocol makes them safe against lost executors.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import encoder, slices, with_end

MAGIC = b"TWD2"
#: After a file's footer: its length, and how many bytes that takes with the mark and the line feed behind it.
TRAILER, TRAILER_BYTES = "<Q4sc", 13
#: A block in a footer: where it begins, and its tokens and those of the same range of doc_ids before it.
ENTRY, ENTRY_BYTES = "<QQQ", 24
CHUNK_BITS = 8
STRETCH = 512
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack(ids: np.ndarray) -> bytes:
    """Directly addressable codes of the ids (unsigned, 32 bits)."""
    parts, level = [], ids.astype(np.uint32)
    while True:
        chunk = (level & np.uint32((1 << CHUNK_BITS) - 1)).astype(np.uint8)
        rest = level >> np.uint32(CHUNK_BITS)
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        stretches = np.add.reduceat(_ONES[bits].astype(np.uint64), np.arange(0, len(bits), STRETCH // 8)) if len(bits) else np.zeros(0, np.uint64)
        ranks = (np.cumsum(stretches) - stretches).astype("<u4")
        parts.append(struct.pack("<I", len(chunk)) + chunk.tobytes() + bits.tobytes() + ranks.tobytes())
        if not more.any():
            return struct.pack("<I", len(parts)) + b"".join(parts)
        level = rest[more]


def rank_of(i: int, bits: np.ndarray, before: int) -> int:
    """Set bits before place i, of its stretch's bytes up to its own and the number before the stretch."""
    return before + int(_ONES[bits[:-1]].sum()) + bin(int(bits[-1]) & ((1 << i % 8) - 1)).count("1")


class Codes:
    """Reader of packed ids."""

    def __init__(self, data: bytes, at: int = 0):
        (levels,) = struct.unpack_from("<I", data, at)
        at += 4
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<I", data, at)
            n_bits, n_ranks = -(-n // 8), -(-n // STRETCH)
            chunk = np.frombuffer(data, np.uint8, n, at + 4)
            bits = np.frombuffer(data, np.uint8, n_bits, at + 4 + n)
            ranks = np.frombuffer(data, "<u4", n_ranks, at + 4 + n + n_bits)
            self.levels.append((chunk, bits, ranks))
            at += 4 + n + n_bits + 4 * n_ranks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """Token i, by one rank a level."""
        value = shift = 0
        for chunk, bits, ranks in self.levels:
            value |= int(chunk[i]) << shift
            if not bits[i // 8] >> i % 8 & 1:
                break
            i = rank_of(i, bits[i // STRETCH * (STRETCH // 8) : i // 8 + 1], int(ranks[i // STRETCH]))
            shift += CHUNK_BITS
        return value

    def read(self, start: int, end: int) -> np.ndarray:
        """Tokens start .. end, touching only their own stretch of each level."""
        out = np.zeros(end - start, np.uint32)
        live, a, b, shift = np.arange(end - start), start, end, 0
        for chunk, bits, ranks in self.levels:
            if not len(live):
                break
            out[live] |= chunk[a:b].astype(np.uint32) << np.uint32(shift)
            if len(bits) == 0:
                break
            go = np.unpackbits(bits[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            first = a // STRETCH * (STRETCH // 8)
            before = int(ranks[a // STRETCH]) + int(_ONES[bits[first : a // 8]].sum()) + bin(int(bits[a // 8]) & ((1 << a % 8) - 1)).count("1")
            live = live[go]
            a, b = before, before + len(live)
            shift += CHUNK_BITS
        return out


@dataclass
class Block:
    """Documents of a block: their ids (and whether there is one), token offsets and codes."""

    doc_ids: np.ndarray
    known: np.ndarray
    offsets: np.ndarray
    codes: Codes


def write_block(doc_ids: list[int | None], offsets: np.ndarray, ids: np.ndarray) -> bytes:
    n = len(doc_ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    return MAGIC + struct.pack("<I", n) + known.tobytes() + numbers.tobytes() + offsets.astype("<i8").tobytes() + pack(ids)


def read_block(data: bytes) -> Block:
    if data[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    (n,) = struct.unpack_from("<I", data, 4)
    known = np.frombuffer(data, np.uint8, n, 8).astype(bool)
    numbers = np.frombuffer(data, "<i8", n, 8 + n)
    offsets = np.frombuffer(data, "<i8", n + 1, 8 + 9 * n)
    return Block(numbers, known, offsets, Codes(data, 8 + 9 * n + 8 * (n + 1)))


def footer(places: list[tuple[int, int, int]], part: int, part_tokens: int) -> bytes:
    """The end of a file: (begin, tokens, tokens before) of its blocks, its range of doc_ids and the tokens of that up to here."""
    body = struct.pack("<IQI", part, part_tokens, len(places)) + b"".join(struct.pack(ENTRY, *p) for p in places)
    return body + struct.pack(TRAILER, len(body), MAGIC, b"\n")[:-1]


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, partitions: int | None = None, block_tokens: int = 1 << 20, file_blocks: int = 12
) -> None:
    """Encode docs (doc_id, text; other columns are ignored) and write files of codes to `path`.

    A null text counts as empty and gives the end id alone; null doc_ids come first; rows with the
    same doc_id stand one after the other in no set order; an empty table gives no block. A document
    longer than a block is a block of its own: memory follows the longest document. A file holds at
    most `file_blocks` blocks, so that it can be a value of one row when all are read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = partitions or max(common.shuffle_partitions(spark), common.text_bytes(rows) // (256 << 20))
    dealt = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done, at = TaskContext.get().partitionId(), 0, 0
        encode_texts = encoder(tokenizer).encode
        places: list[tuple[int, int, int]] = []

        def rows_of(doc_ids: list, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            """A block, and the footer where it is the file's last: files are cut after so many rows."""
            nonlocal done, at
            ids = np.concatenate([x for x, _ in held])
            offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, o in held]))])
            out = [write_block(doc_ids, offsets, ids)]
            places.append((at, len(ids), done))
            done, at = done + len(ids), at + len(out[0]) + 1
            if len(places) == file_blocks:
                out.append(close())
            return pa.record_batch([pa.array(out, pa.binary())], ["value"])

        def close() -> bytes:
            nonlocal at
            end = footer(places, part, done)
            places.clear()
            at = 0
            return end

        doc_ids: list = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            numbers, k = batch.column("doc_id").to_pylist(), 0
            for texts in slices(batch.column("text"), min(1 << 20, 4 * block_tokens)):
                held.append(with_end(*encode_texts(texts), end_id))
                doc_ids += numbers[k : k + len(texts)]
                k += len(texts)
                if sum(len(x) for x, _ in held) >= block_tokens:
                    yield rows_of(doc_ids, held)
                    doc_ids, held = [], []
        if held:
            yield rows_of(doc_ids, held)
        if places:
            yield pa.record_batch([pa.array([close()], pa.binary())], ["value"])

    written = dealt.mapInArrow(encode, "value binary").select(F.col("value").cast("string").alias("value"))
    written.write.option("maxRecordsPerFile", file_blocks + 1).option("lineSep", "\n").option("compression", "none").text(path)


def read_footer(data: bytes) -> tuple[int, int, list[tuple[int, int, int]]]:
    """Range of doc_ids, its tokens up to the end of the file, and the blocks, of the bytes of a footer."""
    part, tokens, n = struct.unpack_from("<IQI", data)
    return part, tokens, [struct.unpack_from(ENTRY, data, 16 + k * ENTRY_BYTES) for k in range(n)]


class Table:
    """Written files, for reading single tokens. read_at(file, place, n) gives n bytes; places below zero count from the end."""

    def __init__(self, files: list[str], read_at: Callable[[str, int, int], bytes]):
        self.read_at = read_at
        found = []
        for file in files:
            length, magic, _ = struct.unpack(TRAILER, read_at(file, -TRAILER_BYTES, TRAILER_BYTES))
            if magic != MAGIC:
                raise ValueError(f"not a file of token ids: {file}")
            part, tokens, blocks = read_footer(read_at(file, -TRAILER_BYTES - length, length))
            found.append((part, blocks[0][2], tokens, file, blocks))
        self.starts: list[int] = []
        self.blocks: list[tuple[str, int]] = []
        base, last, total = 0, -1, 0
        for part, _, tokens, file, blocks in sorted(found):
            if part != last:
                base, last = base + total, part
            total = tokens
            self.starts += [base + before for _, _, before in blocks]
            self.blocks += [(file, at) for at, _, _ in blocks]
        self.n_tokens = base + total

    def __len__(self) -> int:
        return self.n_tokens

    def token_at(self, i: int) -> int:
        """Token i of all: of each level a byte of codes, a rank and a stretch of bits are read."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        k = int(np.searchsorted(self.starts, i, "right")) - 1
        (file, at), i = self.blocks[k], i - self.starts[k]
        (n,) = struct.unpack("<I", self.read_at(file, at + 4, 4))
        at += 8 + 9 * n + 8 * (n + 1)
        (levels,) = struct.unpack("<I", self.read_at(file, at, 4))
        at, value = at + 4, 0
        for level in range(levels):
            (n,) = struct.unpack("<I", self.read_at(file, at, 4))
            codes, bits, ranks = at + 4, at + 4 + n, at + 4 + n + -(-n // 8)
            value |= self.read_at(file, codes + i, 1)[0] << CHUNK_BITS * level
            first = i // STRETCH * (STRETCH // 8)
            stretch = np.frombuffer(self.read_at(file, bits + first, i // 8 + 1 - first), np.uint8)
            if not stretch[-1] >> i % 8 & 1:
                break
            i = rank_of(i, stretch, struct.unpack("<I", self.read_at(file, ranks + i // STRETCH * 4, 4))[0])
            at = ranks + -(-n // STRETCH) * 4
        return value


def open_table(spark: SparkSession, path: str) -> Table:
    """The written table, read on the driver through the file system that Spark uses; its footers come to memory."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    sizes = {str(s.getPath().toString()): s.getLen() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-") and s.getLen()}

    def read_at(file: str, place: int, n: int) -> bytes:
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(file))
        try:
            stream.seek(place if place >= 0 else sizes[file] + place)
            return bytes(stream.readNBytes(n))
        finally:
            stream.close()

    return Table(list(sizes), read_at)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written files as rows of their bytes, `content`; a file is bounded by the writer's `file_blocks` and its longest document."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.filter("length > 0").select("content")


def token_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, each read by its own addresses.

    Files tell places within their range of doc_ids; the totals of the ranges, a row for each, are
    summed up and broadcast: their number is a parameter of the writer. A row for each document is
    written to the shared folder.
    """
    from pyspark.sql import Window

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_buffer()
                length, _, _ = struct.unpack(TRAILER, data[len(data) - TRAILER_BYTES :].to_pybytes())
                part, _, blocks = read_footer(data[len(data) - TRAILER_BYTES - length :].to_pybytes())
                for k, (at, _, before) in enumerate(blocks):
                    end = blocks[k + 1][0] if k + 1 < len(blocks) else len(data) - TRAILER_BYTES - length
                    block = read_block(data[at:end].to_pybytes())
                    o = block.offsets
                    crcs = [zlib.crc32(block.codes.read(int(a), int(b)).astype("<u4").tobytes()) for a, b in zip(o[:-1], o[1:], strict=True)]
                    yield pa.record_batch(
                        {
                            "part": pa.array([part] * len(crcs), pa.int32()),
                            "doc_id": pa.array(block.doc_ids, pa.int64(), mask=~block.known),
                            "place": pa.array(before + o[:-1], pa.int64()),
                            "n_tokens": pa.array(np.diff(o), pa.int64()),
                            "ids_crc32": pa.array(crcs, pa.int64()),
                        }
                    )

    digests = files.mapInArrow(digest, "part int, doc_id long, place long, n_tokens long, ids_crc32 long")
    with common.setting(files.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", "1"):  # a file at a time
        found = common.materialize(digests, "token-digests")
    totals = found.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return found.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
