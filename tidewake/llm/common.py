"""Shared pieces: the shared folder, Arrow text buffers and vectorised word hashes.

Text kernels work on the UTF-8 bytes of a whole block of documents at once: no Python object is
made per word. Blocks hold a few MB of text, or one document where that is longer, so memory
follows the longest document and not the table.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

BLOCK_BYTES = 1 << 21


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, as in tests, may leave it unset."""
    import tempfile

    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: on a cluster it names the folder that driver and executors share")
    return (found or f"file://{tempfile.gettempdir()}/tidewake-shared").rstrip("/")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made of the given ones that df does not have yet, whatever its own columns are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


_scopes: list[Scope] = []


class Scope:
    """Tables that `materialize` writes within a `with` of it are deleted at its end, but for those kept, which the scope around it takes over."""

    def __enter__(self) -> Scope:
        self.made: list[DataFrame] = []
        _scopes.append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.made = [x for x in self.made if x is not df]
        if self is not _scopes[0]:
            _scopes[_scopes.index(self) - 1].made.append(df)
        return df

    def __exit__(self, *_) -> None:
        _scopes.remove(self)
        for df in self.made:
            discard(df)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back.

    The files survive lost executors, unlike a local checkpoint.
    """
    path = f"{shared_folder(df.sparkSession)}/tidewake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    if _scopes:
        _scopes[-1].made.append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that `materialize` wrote and that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session's setting for what is run within, as before afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def text_bytes(rows: DataFrame, text: str = "text") -> int:
    """How many bytes the texts take, and some for each row: for numbers of partitions only, no result depends on it.

    Measured by a pass over the column: sizes of compressed files say little.
    """
    from pyspark.sql import functions as F

    return rows.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) + 16 * F.count("*")).first()[0]


def join_skewed(rows: DataFrame, aggregate: DataFrame, key: str) -> DataFrame:
    """Inner join of rows to an aggregate of them by a long key that may be very uneven.

    A join that reuses the aggregate's own exchange can't be split at run time. Joining on the
    complement of the key gives the join exchanges of its own, which adaptive execution splits.
    """
    from pyspark.sql import functions as F

    once = aggregate.withColumn("__not", F.bitwise_not(key)).drop(key)
    return rows.join(once, F.bitwise_not(rows[key]) == F.col("__not")).drop("__not")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_null(column.type) or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer row is a range of its own."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, min(end, rows)
        row = min(end, rows)


def text_blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of blocks of a string column."""
    buffer, offsets = utf8(column)
    for a, b in blocks(offsets, most):
        yield a, b, buffer[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def separators(*codes: int) -> np.ndarray:
    """Lookup table of the bytes that end a word."""
    table = np.zeros(256, bool)
    table[list(codes)] = True
    return table


#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
SPACES = separators(0x20, *range(0x09, 0x0E))


def word_bounds(buffer: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in the block, and for each document its first word (one entry more).

    Words never span documents.
    """
    if not len(buffer):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~table[buffer]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    edges = offsets[offsets < len(buffer)]
    before[edges] = False
    after[offsets[offsets > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Bytes by themselves, and with A-Z as a-z.
_SAME = np.arange(256, dtype=np.uint8)
_FOLDED = _SAME.copy()
_FOLDED[0x41:0x5B] += 32
#: Words up to this many bytes are hashed eight bytes at a time for all words at once; longer ones each on its own.
_LANES = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = False, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word; with fold_case A-Z count as a-z. Different seeds give independent hashes.

    Eight bytes after the other are mixed into the hash of those before: no sum that like parts of
    unlike words could cancel in. Longer words go through a keyed cryptographic hash.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    folded = np.zeros(len(buffer) + 8, np.uint8)
    np.take(_FOLDED if fold_case else _SAME, buffer, out=folded[: len(buffer)])
    eight = np.ndarray((len(buffer) + 1,), "<u8", folded.data, strides=(1,))
    lengths = ends - starts
    first = np.uint64((0x243F6A8885A308D3 + seed * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    out = mix(lengths.astype(np.uint64) + first)
    live = np.flatnonzero(lengths <= _LANES)
    for lane in range(0, _LANES, 8):
        live = live[lengths[live] > lane]
        if not len(live):
            break
        rest = np.minimum(lengths[live] - lane, 8).astype(np.uint64)
        part = eight[starts[live] + lane] & (np.uint64((1 << 64) - 1) >> (np.uint64(64) - np.uint64(8) * rest))
        out[live] = mix((out[live] ^ part) + first)
    for k in np.flatnonzero(lengths > _LANES).tolist():
        digest = hashlib.blake2b(folded[starts[k] : ends[k]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest()
        out[k] = np.frombuffer(digest, "<u8")[0]
    return out


def window_hashes(words: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """Hash of each run of `width` words of the block, by its first word (runs may span documents: mask them)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = np.random.default_rng(seed).integers(0, 1 << 63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    total = words[:n] * factors[0]
    for k in range(1, width):
        total += words[k : n + k] * factors[k]
    return mix(total)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated index ranges starts[i] .. starts[i] + lengths[i]."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    firsts = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) - np.repeat(firsts - starts, lengths)
