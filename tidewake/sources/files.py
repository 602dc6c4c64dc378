"""Growing log files as a source: lines by byte ranges of files, offsets by file where it streams.

A file is told by its path and by a fingerprint, the hash of its first bytes and of those before the
place up to which it was taken. One that no longer has the fingerprint of what was taken, or is
shorter, was rotated or rewritten and is taken from its start. Only whole lines are taken: the last
one waits for its line feed. Files are read in pieces, so memory follows neither files nor batches.
"""

from __future__ import annotations

import fnmatch
import glob
import hashlib
import json
import os
import re
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, line_no long, line string"
_PIECE, _EDGE = 1 << 20, 256
#: Bytes of a file that a task reads, more or less.
_RANGE = 32 << 20


def local(path: str) -> str | None:
    """The path without its scheme where it is of this machine's file system, else None."""
    m = re.fullmatch(r"(?:file:/*(?=/)|file:)?(/.*)", path)
    return m[1] if m else path if "://" not in path else None


def open_file(path: str):
    if local(path) is not None:
        return open(local(path), "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def listed(include: list[str], exclude: list[str]) -> dict[str, tuple[int, float]]:
    """Length and time of change of all files of all globs, by path; a folder stands for the files in it."""
    out: dict[str, tuple[int, float]] = {}
    for pattern in include:
        if local(pattern) is not None:
            found = [f for x in glob.glob(local(pattern)) for f in ([x] if os.path.isfile(x) else [os.path.join(x, n) for n in os.listdir(x) if n[0] not in "._"])]
            for f in found:
                try:
                    state = os.stat(f)
                except FileNotFoundError:
                    continue
                if os.path.isfile(f):
                    out[f] = (state.st_size, state.st_mtime)
        else:
            from pyarrow import fs

            system, inner = fs.FileSystem.from_uri(re.split(r"[*?\[]", pattern)[0].rpartition("/")[0])
            scheme = pattern[: pattern.index(inner.lstrip("/"))] if inner.lstrip("/") in pattern else ""
            for info in system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True)):
                path = scheme + info.path.lstrip("/")
                if info.is_file and (fnmatch.fnmatch(path, pattern) or os.path.dirname(path) == pattern.rstrip("/")):
                    out[path] = (info.size, info.mtime_ns or 0)
    return {f: x for f, x in out.items() if not any(re.search(e, f) for e in exclude)}


def fingerprint(file, taken: int) -> str:
    """Of an open file of which `taken` bytes were taken."""
    edge = min(taken, _EDGE)
    file.seek(0)
    head = file.read(edge)
    file.seek(taken - edge)
    return hashlib.sha256(head + file.read(edge)).hexdigest()[:24]


def whole_lines(file, size: int, max_line: int) -> int:
    """How many of the first `size` bytes are whole lines; a line that is longer than max_line is split and does not wait."""
    start = max(0, size - max_line)
    file.seek(start)
    tail = file.read(size - start)
    end = tail.rfind(b"\n") + 1
    return start + end if end or not start else size


def cuts(file, start: int, end: int, size: int) -> list[tuple[int, int]]:
    """Ranges of about `size` bytes from start to end that begin right behind a line feed, so that no line is cut."""
    out, begin, at = [], start, start + size
    while at < end:
        file.seek(at - 1)
        piece = file.read(min(_EDGE * 64, end - at + 1))
        n = piece.find(b"\n") + 1
        if not piece:
            break
        if n and at - 1 + n < end:
            out.append((begin, at - 1 + n))
            begin = at - 1 + n
            at = begin + size
        else:
            at += len(piece)
    return [*out, (begin, end)]


def lines_of(file, start: int, end: int, max_line: int) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of the lines from start to end, line feeds kept; longer ones are split before a character."""
    file.seek(start)
    held, at = b"", start
    while start < end:
        piece = file.read(min(_PIECE, end - start))
        if not piece:
            break
        start += len(piece)
        held += piece
        k = 0
        while k < len(held):
            n = held.find(b"\n", k, k + max_line) + 1 - k
            if n <= 0:
                if len(held) - k < max_line and start < end:
                    break
                n = min(max_line, len(held) - k)
                while 1 < n < len(held) - k and held[k + n] & 0xC0 == 0x80:
                    n -= 1
            yield at, held[k : k + n]
            k, at = k + n, at + n
        held = held[k:]


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.include, self.exclude = json.loads(options["include"]), json.loads(options.get("exclude", "[]"))
        self.max_line = int(options.get("max_line", "16384"))
        self.idle = float(options.get("idle", "inf"))
        self.known: dict[str, tuple[tuple[int, float], list]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """By file, how many bytes are there to take and the fingerprint of that."""
        out = {}
        for path, state in listed(self.include, self.exclude).items():
            before = self.known.get(path)
            size, changed = state
            if before and before[0] == state and before[1][0] == size:
                out[path] = before[1]
                continue
            try:
                with open_file(path) as f:
                    done = time.time() - changed > self.idle
                    taken = size if done else whole_lines(f, size, self.max_line)
                    out[path] = [taken, fingerprint(f, taken)]
            except FileNotFoundError:
                continue
            self.known[path] = (state, out[path])
        self.known = {p: x for p, x in self.known.items() if p in out}
        return out

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        out = []
        for path, (taken, _) in sorted(end.items()):
            had, print_ = start.get(path, (0, ""))
            try:
                with open_file(path) as f:
                    if had:
                        had = had if had <= taken and fingerprint(f, had) == print_ else 0
                    if had < taken:
                        out += [_Range(path, *x) for x in cuts(f, had, taken, _RANGE)]
            except FileNotFoundError:
                continue
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return read_range(partition, self.max_line)


class _Whole(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files = listed(json.loads(options["include"]), json.loads(options.get("exclude", "[]")))
        self.max_line = int(options.get("max_line", "16384"))

    def partitions(self) -> list[_Range]:
        out = []
        for path, (size, _) in sorted(self.files.items()):
            try:
                with open_file(path) as f:
                    out += [_Range(path, *x) for x in cuts(f, 0, size, _RANGE)]
            except FileNotFoundError:
                continue
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return read_range(partition, self.max_line) if partition.path else iter(())


def read_range(partition: _Range, max_line: int) -> Iterator[pa.RecordBatch]:
    """Batches of about a MB of lines."""
    columns: tuple[list, list, list] = ([], [], [])
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["file", "line_no", "line"])

    try:
        with open_file(partition.path) as f:
            for at, line in lines_of(f, partition.start, partition.end, max_line):
                for column, x in zip(columns, (partition.path, at, line.decode("utf-8", "replace")), strict=True):
                    column.append(x)
                size += len(line)
                if size > _PIECE:
                    yield batch()
                    size = 0
                    for column in columns:
                        column.clear()
    except FileNotFoundError:  # it went away since it was listed
        pass
    if columns[0]:
        yield batch()


class LogFiles(DataSource):
    """Options: include and exclude (lists in JSON), max_line, and idle, the seconds after which a last line waits no longer."""

    @classmethod
    def name(cls) -> str:
        return "tidewake_log_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Whole(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(dict(self.options))
