"""Best-fit packing of token sequences in bulk-synchronous rounds.

A round takes the documents' pieces of a class of lengths (a half of the longest to the longest) and
the gaps of sequences. Both are sorted together by range of size, and a sweep from small to large
matches them as brackets: each gap takes the longest piece before it that is still free, which is
each piece's successor among the gaps with conflicts resolved by rank. A task sweeps its own range;
what stays open there gets the depth of its bracket over all ranges, and pieces and gaps of one
depth meet in an exchange. Then gaps shrink and the next round follows, with the next class once
nine in ten pieces have their place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder, slices, with_end

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, pid long"
SWEPT_SCHEMA = "id long, size long, gap boolean, slot long, sid long, part int, level long"
#: Rows of pieces and gaps that a task of a round sweeps.
TASK_ROWS = 1 << 18
#: Of each class the last pieces, at most one in LATE, go on with the next class.
LATE = 10


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: all full but perhaps the first."""
    first = n - (-(-n // capacity) - 1) * capacity if n > capacity else n
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of all documents, each with a number of its own: that of its task and of the piece there."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId() << 40
        encode_texts = encoder(tokenizer).encode
        for batch in batches:
            numbers, at = batch.column("doc_id").to_pylist(), 0
            for texts in slices(batch.column("text")):
                ids, offsets = with_end(*encode_texts(texts), end_id)
                rows = []
                for doc_id, a, b in zip(numbers[at : at + len(texts)], offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    for k, (start, length) in enumerate(cut(b - a, capacity)):
                        crc = zlib.crc32(ids[a + start : a + start + length].astype("<u4").tobytes())
                        rows.append((doc_id, k, start, length, crc, pid))
                        pid += 1
                at += len(texts)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                names = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(encode, PIECE_SCHEMA)


def brackets(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Match pieces (False, opening) with gaps (True, closing) in order of size.

    Returns for each row the row it is matched with, or -1, and its level: the depth of its bracket.
    """
    depth = np.cumsum(np.where(gap, -1, 1))
    level = np.where(gap, depth + 1, depth)
    order = np.argsort(level, kind="stable")
    a, b = order[:-1], order[1:]
    pairs = (level[a] == level[b]) & ~gap[a] & gap[b]
    mate = np.full(len(gap), -1)
    mate[a[pairs]], mate[b[pairs]] = b[pairs], a[pairs]
    return mate, level


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sweep of a task over its range of sizes: matched pieces, and what stays open with its level within the task."""
    from pyspark import TaskContext

    rows = list(batches)
    if not rows:
        return
    size, gap, ids, slot = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in rows]) for c in ("size", "gap", "id", "slot"))
    mate, level = brackets(gap)
    done, free = np.flatnonzero((mate >= 0) & ~gap), np.flatnonzero(mate < 0)
    part = TaskContext.get().partitionId()
    out = np.concatenate([done, free])
    sid = pa.array(np.concatenate([ids[mate[done]], np.zeros(len(free), np.int64)]), mask=np.arange(len(out)) >= len(done))
    slots = np.concatenate([slot[mate[done]], slot[free]])
    columns = [ids[out], size[out], gap[out], slots, sid, np.full(len(out), part, np.int32), level[out]]
    yield pa.record_batch([pa.array(c) for c in columns], [x.split()[0] for x in SWEPT_SCHEMA.split(", ")])


def tasks_for(rows: int) -> int:
    return -(-rows // TASK_ROWS) or 1


def one_round(pieces: DataFrame, gaps: DataFrame, shortest: int, longest: int, slots: int, rows: int, capacity: int) -> DataFrame:
    """Match pieces (id, size) with gaps (id, size), at most one piece for each slot.

    A gap of twice the longest piece or more offers several slots, at most `slots`, so that each holds
    any piece. Returns a table of pieces left (kind 0), gaps left (1; id, size) and places (2; id of
    the piece, sid, at).
    """
    spark = pieces.sparkSession
    roomy = gaps.filter(F.col("size") >= shortest)
    zero = F.lit(0).cast("long")
    number = F.greatest(F.lit(1), F.least(F.lit(slots), F.floor(F.col("size") / longest))).cast("long")
    offers = roomy.withColumn("n", number).select(F.floor(F.col("size") / F.col("n")).alias("size"), F.lit(True).alias("gap"), "id", F.explode(F.sequence(zero, F.col("n") - 1)).alias("slot"))
    events = pieces.select("size", F.lit(False).alias("gap"), "id", zero.alias("slot")).unionByName(offers)
    by_range = events.repartitionByRange(tasks_for(rows), "size", "gap", "id", "slot").sortWithinPartitions("size", "gap", "id", "slot")
    swept = common.materialize(by_range.mapInArrow(sweep, SWEPT_SCHEMA), "swept")

    # The depth at which each task's range begins: a row for each task, of TASK_ROWS rows each.
    free = swept.filter("sid IS NULL")
    sums = free.groupBy("part").agg(F.sum(F.when(F.col("gap"), -1).otherwise(1)).alias("n")).collect()
    before, depth = [], 0
    for part, n in sorted((r["part"], r["n"]) for r in sums):
        before.append((part, depth))
        depth += n
    if len(before) > 1:
        parts, depths = zip(*before, strict=True)
        depths = spark.createDataFrame(pa.table({"part": pa.array(parts, pa.int32()), "depth": pa.array(depths, pa.int64())}))
        free = free.join(depths, "part").withColumn("level", F.col("level") + F.col("depth"))
    following = F.lead(F.struct("gap", "id", "slot")).over(Window.partitionBy("level").orderBy("part", F.col("gap").desc()))
    met = free.withColumn("next", following).filter(~F.col("gap"))
    met = met.select("id", "size", F.when(F.col("next.gap"), F.col("next.id")).alias("sid"), F.when(F.col("next.gap"), F.col("next.slot")).alias("slot"))

    places = swept.filter("sid IS NOT NULL").select("id", "size", "sid", "slot").unionByName(met.filter("sid IS NOT NULL"))
    none = F.lit(None).cast("long")
    held = roomy.select(none.alias("id"), F.col("size").alias("room"), F.col("id").alias("sid"), F.lit(-1).cast("long").alias("slot"), zero.alias("size"))
    held = held.unionByName(places.withColumn("room", none))
    sequence = Window.partitionBy("sid")
    earlier = F.sum("size").over(sequence.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    held = held.withColumn("earlier", earlier).withColumn("all", F.sum("size").over(sequence)).withColumn("room", F.max("room").over(sequence))
    is_gap = F.col("slot") < 0
    held = held.select(
        F.when(is_gap, 1).otherwise(2).alias("kind"),
        F.when(is_gap, F.col("sid")).otherwise(F.col("id")).alias("id"),
        F.when(is_gap, F.col("room") - F.col("all")).otherwise(F.col("size")).alias("size"),
        "sid",
        (F.lit(capacity) - F.col("room") + F.col("earlier")).alias("at"),
    ).filter("kind = 2 OR size > 0")
    small = gaps.filter(F.col("size") < shortest).select(F.lit(1).alias("kind"), "id", "size", none.alias("sid"), none.alias("at"))
    left = met.filter("sid IS NULL").select(F.lit(0).alias("kind"), "id", "size", none.alias("sid"), none.alias("at"))
    out = common.materialize(held.unionByName(small).unionByName(left).coalesce(tasks_for(rows)), "round")
    common.discard(swept)
    return out


def places_of(pieces: DataFrame, capacity: int) -> DataFrame:
    """The rounds over pieces (pid, length): pid, sequence_id, offset.

    The driver sees counts by length and room alone, at most two for each length up to the capacity.
    """
    spark = pieces.sparkSession
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # No two pieces of more than half of the capacity share a sequence: each begins its own, named by its number.
    large = pieces.filter(2 * F.col("length") > capacity)
    placed = large.select("pid", F.col("pid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    written = []
    gaps = large.filter(F.col("length") < capacity).select(F.col("pid").alias("id"), (F.lit(capacity) - F.col("length")).alias("size"))
    rooms = {capacity - n: k for n, k in lengths.items() if capacity < 2 * n < 2 * capacity}
    left, waiting, opened = None, {}, 0
    longest = capacity // 2
    while longest:
        lowest = longest // 2
        entering = {n: k for n, k in lengths.items() if lowest < n <= longest}
        of_class = pieces.filter((F.col("length") > lowest) & (F.col("length") <= longest)).select(F.col("pid").alias("id"), F.col("length").alias("size"))
        if entering:
            left = of_class if left is None else left.unionByName(of_class)
            waiting = {n: waiting.get(n, 0) + entering.get(n, 0) for n in {*waiting, *entering}}
        late = sum(waiting.values()) // LATE if lowest else 0
        while (n_pieces := sum(waiting.values())) > late:
            unfit = sum(n * k for n, k in waiting.items() if n > max(rooms, default=0))
            if new := -(-unfit // capacity):
                more = spark.range(-opened - new, -opened, numPartitions=tasks_for(new)).select("id", F.lit(capacity).cast("long").alias("size"))
                gaps, opened = gaps.unionByName(more), opened + new
                rooms = {**rooms, capacity: rooms.get(capacity, 0) + new}
            shortest = min(waiting)
            n_gaps = sum(k for room, k in rooms.items() if room >= shortest)
            slots = -(-2 * n_pieces // n_gaps)
            state = one_round(left, gaps, shortest, max(waiting), slots, n_gaps + 3 * n_pieces, capacity)
            seen = state.filter("kind < 2").groupBy("kind", "size").agg(F.count("*").alias("n")).collect()
            waiting, rooms = ({r["size"]: r["n"] for r in seen if r["kind"] == kind} for kind in (0, 1))
            left, gaps = (state.filter(F.col("kind") == kind).select("id", "size") for kind in (0, 1))
            written.append(state)
        longest = lowest
    if not written:
        return placed
    rounds = spark.read.schema(written[0].schema).parquet(*[state._written_to for state in written])
    return placed.unionByName(rounds.filter("kind = 2").select(F.col("id").alias("pid"), F.col("sid").alias("sequence_id"), F.col("at").alias("offset")))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Pack documents (doc_id, text; other columns are ignored) into sequences of at most `capacity` tokens.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only
    documents over the capacity are cut. Null and empty texts are the end id alone; rows that share
    a doc_id, or have none, are packed each on its own; an empty table gives no rows.
    """
    pieces = common.materialize(pieces_of(docs, tokenizer, end_id, capacity), "pieces")
    return pieces.join(places_of(pieces, capacity), "pid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
