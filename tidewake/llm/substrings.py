"""Removal of repeated passages, found by difference-cover anchors.

The residues 0, 1 and 3 modulo 7 are a difference cover: for any two positions there is a shift
below 7 that brings both to a covered residue. So two equal runs of at least `window` words share
an aligned anchor, a run of window - 6 words at a covered position, and only anchors at covered
positions are hashed and exchanged. Where an anchor occurs in more than one document, the windows
around it are extended to their full width and exchanged in turn; the smallest doc_id of each
decides.

Documents are dealt to groups of a few MB. A group sends each distinct hash once, packed by hash
bucket, however often it occurs, so a passage that stands in a third of all documents is a few
entries of its bucket. Answers are bit masks in the order of what was sent.

Anchors only propose: chance matches of their 40 bits cost time and change nothing. Windows are
compared by 96 bits of two independent hashes of their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A period and a difference cover of its residues.
PERIOD, COVER = 7, (0, 1, 3)


class _Group:
    """Word hashes of a group of documents, in the order of the table."""

    def __init__(self, table: pa.Table, window: int):
        self.ids = table.column("doc_id").combine_chunks()
        self.known = np.array(self.ids.is_valid())
        self.doc_ids = self.ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.text = table.column("text").combine_chunks()
        self.window, self.width = window, window - PERIOD + 1
        hashes, counts = [], []
        for _, _, buffer, offsets in common.text_blocks(self.text):
            starts, ends, first = common.word_bounds(buffer, offsets, common.SPACES)
            hashes.append(common.word_hashes(buffer, starts, ends))
            counts.append(np.diff(first))
        self.words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.n_words = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n_words)])
        self.doc = np.repeat(np.arange(len(self.n_words)), self.n_words)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """First words of the anchors, and their hashes."""
        at = np.arange(len(self.words)) - self.first[self.doc]
        residue = np.zeros(PERIOD, bool)
        residue[list(COVER)] = True
        fits = (at + self.width <= self.n_words[self.doc]) & (self.n_words[self.doc] >= self.window) & self.known[self.doc]
        where = np.flatnonzero(residue[at % PERIOD] & fits)
        return where, common.window_hashes(self.words, self.width, seed=7)[where]

    def second_words(self) -> np.ndarray:
        """Hashes of the words that are independent of the first ones."""
        hashes = [np.zeros(0, np.uint64)]
        for _, _, buffer, offsets in common.text_blocks(self.text):
            starts, ends, _ = common.word_bounds(buffer, offsets, common.SPACES)
            hashes.append(common.word_hashes(buffer, starts, ends, seed=1))
        return np.concatenate(hashes)

    def candidates(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words of the windows that hold one of the anchors, and 64 and 32 bits of their hashes."""
        marks = np.zeros(len(self.words) + PERIOD + 1, np.int32)
        marks[anchors + 1] = 1
        before = np.cumsum(marks)
        n = len(self.words)
        near = before[PERIOD : n + PERIOD] > before[:n]
        at = np.arange(n) - self.first[self.doc]
        where = np.flatnonzero(near & (at + self.window <= self.n_words[self.doc]) & self.known[self.doc])
        if not len(where):
            return where, np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        more = common.window_hashes(self.second_words(), self.window, seed=17)[where] >> np.uint64(32)
        return where, common.window_hashes(self.words, self.window, seed=13)[where], more.astype(np.uint32)


def _buckets(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bucket from the upper half of the hash; what is compared within a bucket are other bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


_LOW = np.uint64((1 << 40) - 1)


def _distinct_anchors(group: _Group, n_buckets: int):
    """Distinct (bucket, 40 bits) of the group's anchors in order, the index of each anchor's, the buckets and first words."""
    where, hashes = group.anchors()
    # Buckets keep their own bits: the order of this key is that of (bucket, 40 bits) while there are under 2^24 buckets.
    key = (_buckets(hashes, n_buckets) << np.uint64(40)) | (common.mix(hashes) & _LOW)
    distinct, inverse = np.unique(key, return_inverse=True)
    return where, distinct, inverse


def _distinct_windows(group: _Group, anchors: np.ndarray, n_buckets: int):
    """The group's candidate windows, each once with its smallest doc_id, in order of (bucket, doc_id, hashes)."""
    where, hashes, more = group.candidates(anchors)
    owner = group.doc_ids[group.doc[where]]
    order, new = _firsts(hashes, more, owner)
    entry_of = np.empty(len(order), np.int64)
    entry_of[order] = np.cumsum(new) - 1
    hash_, more, least = hashes[order][new], more[order][new], owner[order][new]
    bucket = _buckets(hash_, n_buckets)
    rank = np.lexsort((more, hash_, least, bucket))
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    return where, owner, place[entry_of] if len(rank) else entry_of, bucket[rank], hash_[rank], more[rank], least[rank]


def _firsts(hashes: np.ndarray, more: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of windows by hashes and owner, and which of them are the first of equal hashes."""
    order = np.lexsort((owner, more, hashes))
    new = np.ones(len(order), bool)
    h, m = hashes[order], more[order]
    new[1:] = (h[1:] != h[:-1]) | (m[1:] != m[:-1])
    return order, new


def _parts(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of the runs of a sorted array."""
    if not len(bucket):
        return []
    cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _rows(g: int, rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"g": pa.array([g] * len(rows), pa.int32()), "bucket": pa.array([r[0] for r in rows], pa.int32()), "payload": pa.array([r[1] for r in rows], pa.binary())})


def _masks(table: pa.Table, kind: int) -> np.ndarray:
    """The answers to a group of one kind, joined in order of their buckets."""
    rows = [r for r in table.select(["kind", "bucket", "n", "payload"]).to_pylist() if r["kind"] == kind]
    rows.sort(key=lambda r: r["bucket"])
    bits = [np.unpackbits(np.frombuffer(r["payload"], np.uint8), count=r["n"]) for r in rows]
    return np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)


_SENT = "g int, bucket int, payload binary"
_ANSWER = "g int, bucket int, kind int, n int, payload binary"


#: What the larger exchange sends for a byte of text, about.
_SENT_SHARE = 0.6


def plan(total: int, at_least: int, group_bytes: int = 4 << 20, bucket_bytes: int = 24 << 20, payload_bytes: int = 512, most_bytes: int = 256 << 20) -> tuple[int, int, int]:
    """Numbers of groups, of buckets and of tasks for so many bytes of text.

    There is a payload for each group and bucket. Groups and buckets keep their sizes, so tables of
    more bytes have more of both, up to where payloads would be smaller than `payload_bytes`; from
    there on both grow alike, until a group takes `most_bytes`.
    """
    grown = (max(1.0, payload_bytes * total / (group_bytes * bucket_bytes))) ** 0.5
    group, bucket = min(most_bytes, int(group_bytes * grown)), min(most_bytes, int(bucket_bytes * grown))
    n_buckets = min(max(at_least, int(total * _SENT_SHARE) // bucket), 1 << 23)
    return max(at_least, 2 * total // group), n_buckets, max(at_least, total // (32 << 20))


def remove_repeats(docs: DataFrame, window: int = 13, **sizes: int) -> DataFrame:
    """Remove every word covered by a window that also starts in a document with a smaller doc_id.

    docs: doc_id, text; other columns are ignored. Words are runs of anything but ASCII white space.
    Returns doc_id, n_words, n_removed and text, the kept words joined by one space. Windows are
    judged on the input. Null and empty texts have no words; a row without doc_id neither loses
    words nor makes others lose them; rows with the same doc_id do not count against each other;
    an empty table gives no rows. `window` is at least 7. Windows with equal hashes count as equal:
    among 10^13 of them any two unlike ones meet with a chance of 1 in 1,000. A group is held in
    memory: its share of the text or its longest document, and a few times that in arrays; a bucket
    as well. `sizes` are those of `plan`.
    """
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_groups, n_buckets, n_tasks = plan(common.text_bytes(rows), common.shuffle_partitions(spark), **sizes)
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_groups)).cast("int"))

    def send_anchors(table: pa.Table) -> pa.Table:
        group = _Group(table, window)
        where, distinct, inverse = _distinct_anchors(group, n_buckets)
        doc = group.doc[where]
        least, most = np.full(len(distinct), len(group.n_words)), np.zeros(len(distinct), np.int64)
        np.minimum.at(least, inverse, doc)
        np.maximum.at(most, inverse, doc)
        several = least < most
        low = distinct & _LOW
        sent = [
            (k, np.packbits(several[a:b]).tobytes() + low[a:b].astype("<u4").tobytes() + (low[a:b] >> np.uint64(32)).astype(np.uint8).tobytes())
            for k, a, b in _parts(distinct >> np.uint64(40))
        ]
        return _rows(table.column("g")[0].as_py(), sent)

    def judge_anchors(table: pa.Table) -> pa.Table:
        keys, several = [], []
        for payload in table.column("payload"):
            data = np.frombuffer(payload.as_buffer(), np.uint8)
            n = len(data) * 8 // 41  # an entry takes 40 bits and one flag
            while -(-n // 8) + 5 * n < len(data):
                n += 1
            bits = -(-n // 8)
            several.append(np.unpackbits(data[:bits], count=n).astype(bool))
            keys.append(np.frombuffer(data[bits : bits + 4 * n].tobytes(), "<u4").astype(np.uint64) | (data[bits + 4 * n :].astype(np.uint64) << np.uint64(32)))
        every = np.concatenate(keys)
        _, inverse, count = np.unique(every, return_inverse=True, return_counts=True)
        shared = count > 1
        shared[inverse[np.concatenate(several)]] = True
        return _answers(table, shared[inverse], [len(k) for k in keys], 0)

    def send_windows(table: pa.Table, masks: pa.Table) -> pa.Table:
        if not len(table):
            return _rows(0, [])
        group = _Group(table, window)
        where, _, inverse = _distinct_anchors(group, n_buckets)
        _, _, _, bucket, hashes, more, least = _distinct_windows(group, where[_masks(masks, 0)[inverse]], n_buckets)
        sent = []
        for k, a, b in _parts(bucket):
            runs = _parts(least[a:b])
            head = np.array([len(runs), b - a], "<u4").tobytes()
            sent.append((k, head + np.array([r[0] for r in runs], "<i8").tobytes() + np.array([r[2] - r[1] for r in runs], "<u4").tobytes() + hashes[a:b].astype("<u8").tobytes() + more[a:b].astype("<u4").tobytes()))
        return _rows(table.column("g")[0].as_py(), sent)

    def judge_windows(table: pa.Table) -> pa.Table:
        hashes, mores, owners = [], [], []
        for payload in table.column("payload"):
            data = payload.as_buffer().to_pybytes()
            n_runs, n = np.frombuffer(data, "<u4", 2)
            ids = np.frombuffer(data, "<i8", n_runs, 8)
            lengths = np.frombuffer(data, "<u4", n_runs, 8 + 8 * int(n_runs))
            owners.append(np.repeat(ids, lengths))
            hashes.append(np.frombuffer(data, "<u8", n, 8 + 12 * int(n_runs)))
            mores.append(np.frombuffer(data, "<u4", n, 8 + 12 * int(n_runs) + 8 * int(n)))
        hash_, owner = np.concatenate(hashes), np.concatenate(owners)
        order, new = _firsts(hash_, np.concatenate(mores), owner)
        least = np.empty(len(order), np.int64)
        least[order] = owner[order][new][np.cumsum(new) - 1]
        return _answers(table, least < owner, [len(h) for h in hashes], 1)

    def _answers(table: pa.Table, bits: np.ndarray, lengths: list[int], kind: int) -> pa.Table:
        ends = np.cumsum(lengths)
        packed = [np.packbits(bits[e - n : e]).tobytes() for n, e in zip(lengths, ends, strict=True)]
        n = len(lengths)
        return pa.table(
            {
                "g": table.column("g"),
                "bucket": table.column("bucket"),
                "kind": pa.array([kind] * n, pa.int32()),
                "n": pa.array(lengths, pa.int32()),
                "payload": pa.array(packed, pa.binary()),
            }
        )

    def remove(table: pa.Table, masks: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
        group = _Group(table, window)
        where, _, inverse = _distinct_anchors(group, n_buckets)
        first, owner, entry, _, _, _, least = _distinct_windows(group, where[_masks(masks, 0)[inverse]], n_buckets)
        earlier = _masks(masks, 1)
        taken = first[earlier[entry] | (owner > least[entry])]
        edges = np.zeros(len(group.words) + 1, np.int32)
        np.add.at(edges, taken, 1)
        np.add.at(edges, taken + window, -1)
        keep = np.cumsum(edges[:-1]) == 0
        gone = np.concatenate([[0], np.cumsum(~keep)])
        texts: list[str] = []
        at = 0
        for _, _, buffer, offsets in common.text_blocks(group.text):
            starts, ends, _ = common.word_bounds(buffer, offsets, common.SPACES)
            mine = keep[at : at + len(starts)]
            at += len(starts)
            texts += _kept_texts(buffer, offsets, starts[mine], ends[mine])
        return pa.table(
            {
                "doc_id": group.ids,
                "n_words": pa.array(group.n_words, pa.int64()),
                "n_removed": pa.array(gone[group.first[1:]] - gone[group.first[:-1]], pa.int64()),
                "text": pa.array(texts, pa.string()),
            }
        )

    # Numbers of tasks follow the bytes: what a task reads stays the same on a larger table.
    def grouped(rows: DataFrame, key: str):
        return rows.repartition(n_tasks, key).groupBy(key)

    by_group = grouped(dealt, "g")
    anchors = grouped(by_group.applyInArrow(send_anchors, _SENT), "bucket").applyInArrow(judge_anchors, _ANSWER)
    windows = grouped(by_group.cogroup(grouped(anchors, "g")).applyInArrow(send_windows, _SENT), "bucket").applyInArrow(judge_windows, _ANSWER)
    return by_group.cogroup(grouped(anchors.unionByName(windows), "g")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, text string")


def _kept_texts(buffer: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The words of each document joined by one space."""
    edges = np.zeros(len(buffer) + 1, np.int8)
    edges[starts] += 1
    np.subtract.at(edges, ends, 1)
    inside = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)
    closes = ends[ends < len(buffer)]
    closes = closes[common.SPACES[buffer[closes]]]
    spaced = np.where(common.SPACES[buffer], np.uint8(0x20), buffer)
    inside[closes] = True
    # Where a word ends a document, the byte after it is the next document's and stays as it is.
    out = spaced[inside].tobytes()
    at = np.concatenate([[0], np.cumsum(inside)])[offsets]
    return [out[a:b].strip(b" ").decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
