"""Benchmark decontamination by pigeonhole edit matching.

A test item may stand in a document with up to k edits, k a share of its length. Cut into k + 1
pieces, at least one piece is then untouched: all pieces of all items are looked for at once, and
each hit is verified by Myers' bit-parallel edit distance on the stretch of text around it. Texts
are compared as lower-cased words (letters, digits and anything beyond ASCII) joined by one space.
Items of a few words are looked for without edits, at the bounds of words.

Pieces are found by their first bytes, up to eight as one number, at every place of a block of
texts at a time. Short pieces stand in very many places, so what hits propose is first ruled out by
counting runs of four bytes: an edit spoils at most four of an item's (more where its characters
have more bytes), and a stretch that lacks more than k edits spoil holds no match. That is certain,
not a guess; only the rest goes to the edit distance.

Items come to the documents in blocks of bounded size, so a test set of any size is matched by as
many passes as it has blocks.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

_SPACED = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
#: Letters of scripts that put no spaces between words: Thai, Lao, Tibetan, Burmese, Khmer, kana and Han.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
Item = tuple[object, str]


def plain_bytes(text: str | None) -> bytes:
    """Lower-cased words joined by one space, as UTF-8."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACED).split()) if text else b""


def plain(text: str | None) -> str:
    """Lower-cased words joined by one space."""
    return plain_bytes(text).decode()


def words_in(text: str) -> int:
    """Number of words of a plain text; each letter of a script without spaces counts as one."""
    return max(text.count(" ") + 1, len(_UNSPACED.findall(text))) if text else 0


def _joined(a: str, b: str) -> bool:
    """Whether two neighbouring characters belong to one word."""
    return all(unicodedata.category(c)[0] in "LMN" and not _UNSPACED.match(c) for c in (a, b))


def at_bounds(text: str, start: int, end: int) -> bool:
    """Whether a stretch of a plain text starts and ends where words do; scripts without spaces have bounds everywhere."""
    return not (start and _joined(text[start - 1], text[start]) or end < len(text) and _joined(text[end - 1], text[end]))


def distance_within(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """Smallest edit distance of the pattern to any stretch of the text, and where the first such stretch ends.

    Myers' algorithm: a column of the distance matrix is two bit vectors, of steps up and down.
    None if every distance is over `most`.
    """
    m = len(pattern)
    if not m:
        return 0, 0
    full, top = (1 << m) - 1, 1 << (m - 1)
    equal: dict[str, int] = {}
    for i, c in enumerate(pattern):
        equal[c] = equal.get(c, 0) | 1 << i
    up, down, score = full, 0, m
    best, end = most + 1, -1
    for j, c in enumerate(text):
        eq = equal.get(c, 0)
        d0 = (((eq & up) + up) ^ up) | eq | down
        hp = down | (full & ~(d0 | up))
        hn = up & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = (hp << 1) & full
        up = ((hn << 1) & full) | (full & ~(d0 | hp))
        down = hp & d0
        if score < best:
            best, end = score, j + 1
            if not best:
                break
    return (best, end) if best <= most else None


def pieces(length: int, errors: int) -> list[tuple[int, int]]:
    """Bounds of errors + 1 pieces of nearly equal length."""
    n = errors + 1
    return [(i * length // n, (i + 1) * length // n) for i in range(n)]


def _eight(data: bytes) -> np.ndarray:
    """The eight bytes from each place on as a number; zeros stand beyond the end."""
    padded = np.frombuffer(data + bytes(8), np.uint8)
    return np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))


def _fours(data: np.ndarray) -> np.ndarray:
    """A number of 15 bits for each four neighbouring bytes."""
    if len(data) < 4:
        return np.zeros(0, np.uint32)
    x = data.astype(np.uint32)
    return ((x[:-3] | x[1:-2] << 8 | x[2:-1] << 16 | x[3:] << 24) * np.uint32(0x9E3779B1)) >> np.uint32(17)


class _Pieces:
    """All pieces of a number of bytes, from eight on all longer ones too; found by a table of hashes and a search.

    Pieces of more bytes are told by their first and last eight.
    """

    def __init__(self, size: int, grams: np.ndarray, lasts: np.ndarray, items: np.ndarray, offsets: np.ndarray, lengths: np.ndarray):
        order = np.argsort(grams, kind="stable")
        self.lasts, self.further = lasts[order], lengths[order] - size
        self.mask = np.uint64((1 << 8 * size) - 1)
        self.grams, first, self.counts = np.unique(grams[order], return_index=True, return_counts=True)
        self.firsts, self.items, self.offsets = first, items[order], offsets[order]
        self.bits = max(12, min(24, int(len(self.grams)).bit_length() + 4))
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self._slot(self.grams)] = True

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def hits(self, eight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the pieces that stand there."""
        grams = eight & self.mask
        at = np.flatnonzero(self.table[self._slot(grams)])
        k = np.searchsorted(self.grams, grams[at])
        k[k == len(self.grams)] = 0
        sound = self.grams[k] == grams[at]
        at, k = at[sound], k[sound]
        at, which = np.repeat(at, self.counts[k]), common.ranges(self.firsts[k], self.counts[k])
        whole = eight[np.minimum(at + self.further[which], len(eight) - 1)] & self.mask == self.lasts[which]
        return at[whole], which[whole]


class Matcher:
    """Finds items in texts; those of fewer than `least_words` words exactly and as whole words."""

    def __init__(self, items: list[Item], share: float, least_words: int):
        self.items = items
        self.short = np.array([words_in(text) < least_words for _, text in items], bool)
        self.errors = [0 if short else int(len(text) * share) for short, (_, text) in zip(self.short, items, strict=True)]
        self.data = [text.encode() for _, text in items]
        self.widest = [max(d) for d in self.data]
        self.fours = [_fours(np.frombuffer(d, np.uint8)) for d in self.data]
        # An edit spoils the fours that hold a byte of the item's character, three more than it has bytes; at worst it takes the widest.
        self.least = [len(x) - sum(sorted((len(c.encode()) + 3 for c in text), reverse=True)[:e]) for x, e, (_, text) in zip(self.fours, self.errors, items, strict=True)]
        self.edges = np.array([(d[0], d[-1]) for d in self.data], np.uint8).reshape(-1, 2)
        self.sizes = np.array([len(d) for d in self.data], np.int64)
        found: dict[int, list[tuple[int, ...]]] = {}
        for k, (_, text) in enumerate(items):
            ends = range(len(text) + 1) if text.isascii() else np.cumsum([0, *(len(c.encode()) for c in text)]).tolist()
            for a, b in pieces(len(text), self.errors[k]):
                piece = self.data[k][ends[a] : ends[b]]
                size = min(8, len(piece))
                found.setdefault(size, []).append((int.from_bytes(piece[:size], "little"), int.from_bytes(piece[-size:], "little"), k, ends[a], len(piece)))
        kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64)
        self.pieces = [_Pieces(size, *(np.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True))) for size, rows in sorted(found.items())]

    def found(self, texts: list[bytes]) -> dict[tuple[int, int], tuple[int, int]]:
        """(text, item) -> (smallest distance, end of that stretch) of plain texts and the items that stand in them."""
        ends = np.cumsum([0, *(len(t) + 1 for t in texts)])
        data = b"\0".join([*texts, b""])
        buffer = np.frombuffer(data, np.uint8)
        eight = _eight(data)[:-1]
        hits = [(p, *p.hits(eight)) for p in self.pieces] if data else []
        if not hits:
            return {}
        item = np.concatenate([p.items[which] for p, _, which in hits])
        start = np.concatenate([at - p.offsets[which] for p, at, which in hits])
        text = np.searchsorted(ends, np.concatenate([at for _, at, _ in hits]), "right") - 1
        # A short item starts and ends where words do: where both bytes at an edge are letters or digits of ASCII it does not.
        letter = (buffer > 0x20) & (buffer < 0x80)
        after = np.minimum(start + self.sizes[item], len(buffer) - 1)
        inside = (start > 0) & letter[np.maximum(start, 1) - 1] & (self.edges[item, 0] < 0x80) | letter[after] & (self.edges[item, 1] < 0x80)
        keep = np.flatnonzero(~(self.short[item] & inside))
        order = keep[np.lexsort((start[keep], item[keep], text[keep]))]
        text, item, start = text[order], item[order], start[order]
        slack = 4 * np.array(self.errors, np.int64)[item]
        # Starts of one item near each other are one stretch.
        new = np.ones(len(item), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > slack[1:])
        firsts = np.flatnonzero(new)
        lasts = np.append(firsts[1:], len(item)) - 1 if len(firsts) else firsts
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for f, l in zip(firsts.tolist(), lasts.tolist(), strict=True):
            d, k = int(text[f]), int(item[f])
            low, high = int(ends[d]), int(ends[d + 1]) - 1
            got = best.get((d, k))
            if got and not got[0]:
                continue
            if self.short[k]:  # its only piece is all of it
                s, e = int(start[f]), int(start[f]) + len(self.data[k])
                before, behind = data[max(low, s - 4) : s].decode(errors="ignore")[-1:], data[e : min(high, e + 4)].decode(errors="ignore")[:1]
                whole = before + self.items[k][1] + behind
                if data[s:e] == self.data[k] and at_bounds(whole, len(before), len(whole) - len(behind)):
                    best[d, k] = (0, len(data[low:e].decode()))
                continue
            a = max(low, int(start[f]) - 2 * int(slack[f]))
            b = min(high, int(start[l]) + len(self.data[k]) + 2 * int(slack[f]))
            most = max(self.widest[k], int(buffer[a:b].max(initial=0)))
            wide = 2 * self.errors[k] * (1 if most < 0x80 else 2 if most < 0xE0 else 3 if most < 0xF0 else 4)
            a, b = max(a, int(start[f]) - wide), min(b, int(start[l]) + len(self.data[k]) + wide)
            while a > low and buffer[a] & 0xC0 == 0x80:
                a -= 1
            while b < high and buffer[b] & 0xC0 == 0x80:
                b += 1
            if self.least[k] > 0:
                held = np.zeros(1 << 15, bool)
                held[_fours(buffer[a:b])] = True
                if int(held[self.fours[k]].sum()) < self.least[k]:
                    continue
            near = distance_within(self.items[k][1], data[a:b].decode(), self.errors[k])
            if near and (not got or near[0] < got[0]):
                best[d, k] = (near[0], len(data[low:a].decode()) + near[1])
        return best


@lru_cache(maxsize=2)
def _matcher(key: str, items: tuple[Item, ...], share: float, least_words: int) -> Matcher:
    return Matcher(list(items), share, least_words)


def item_blocks(benchmark: DataFrame, block_chars: int = 16 << 20) -> Iterator[tuple[Item, ...]]:
    """Blocks of (item_id, plain text), each of about `block_chars` at most or one item.

    Null items and items without a word match nothing. Equal rows count once. Items come to the
    driver a block at a time and go to the workers from there, so a block's size bounds both.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    block: list[Item] = []
    size = 0
    for row in rows.toLocalIterator():
        text = plain(row["text"])
        if not text:
            continue
        if block and size + len(text) > block_chars:
            yield tuple(sorted(block, key=repr))
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text)
    if block:
        yield tuple(sorted(block, key=repr))


def _key(items: tuple[Item, ...]) -> str:
    return hashlib.sha256(repr(items).encode()).hexdigest()


def plain_blocks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of about `most` bytes of a column's plain texts, with the number of the first; a longer text is a run of its own."""
    first, run, size = 0, [], 0
    for k in range(len(column)):
        text = plain_bytes(column[k].as_py())
        if run and size + len(text) > most:
            yield first, run
            first, run, size = k, [], 0
        run.append(text)
        size += len(text)
    if run:
        yield first, run


def _placed(found: dict[tuple[int, int], tuple[int, int]], first: int) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    return [((first + d, k), x) for (d, k), x in sorted(found.items())]


def matches(docs: DataFrame, benchmark: DataFrame, share: float = 0.08, least_words: int = 5, **limits) -> DataFrame:
    """A row for each document and each test item that stands in it with at most share x length edits.

    Items of fewer than `least_words` words must stand there without edits and as whole words: with
    edits a few words would stand anywhere. Letters of scripts without spaces count as words.
    Returns doc_id, item_id, edits (the smallest distance) and match_end (where that stretch ends in
    the plain text). Null and empty texts hold nothing; rows that share a doc_id, or have none, are
    matched each on its own; an empty table on either side gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, edits int, match_end long"
    parts = []
    for items in item_blocks(benchmark, **limits):

        def match(batches: Iterator[pa.RecordBatch], items=items, key=_key(items)) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(key, items, share, least_words)
            for batch in batches:
                numbers = batch.column("doc_id").to_pylist()
                got = [(numbers[d], items[k][0], edits, end) for first, texts in plain_blocks(batch.column("text")) for (d, k), (edits, end) in _placed(matcher.found(texts), first)]
                columns = zip(*got, strict=True) if got else [()] * 4
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "item_id", "edits", "match_end"])

        parts.append(rows.mapInArrow(match, schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = 0.08, least_words: int = 5, **limits) -> DataFrame:
    """docs without the rows whose text holds a test item; all columns stay, whatever they are called. Cases as in `matches`."""
    kept = docs
    (name,) = common.fresh(docs, "text")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())])
    for items in item_blocks(benchmark, **limits):

        def clean(batches: Iterator[pa.RecordBatch], items=items, key=_key(items)) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(key, items, share, least_words)
            for batch in batches:
                free = np.ones(batch.num_rows, bool)
                for first, texts in plain_blocks(batch.column(name)):
                    free[[first + d for d, _ in matcher.found(texts)]] = False
                yield batch.filter(pa.array(free))

        kept = kept.withColumn(name, F.col("text").cast("string")).mapInArrow(clean, schema).drop(name)
    return kept
