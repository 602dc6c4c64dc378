"""Token ids of whole texts with the `tokenizers` library, each distinct chunk encoded once.

A tokenizer whose pre-tokenizer never joins text across white space gives the same ids for a text
as for its chunks one after the other. So texts are cut there, equal chunks share one encoding,
and ids are gathered with numpy. Other tokenizers get whole texts. Strings of special tokens within
a text are those tokens, as the library has it.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: The code points with the Unicode property White_Space, as a character class body.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: ASCII white space, Latin letters, and ASCII punctuation but the apostrophe (which may open a contraction).
ASCII_WHITE = r"\t\n\x0b\x0c\r "
LETTERS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
MARKS = r"!-&(-/:-@\[-`{-~"
#: White space is dropped: chunks are runs of letters or of marks where nothing can join them to what follows, else whatever stands up to the next white space.
DROPPED = re.compile(rf"[{LETTERS}]+(?=[{ASCII_WHITE}{MARKS}]|\Z)|[{MARKS}]+(?=[{ASCII_WHITE}{LETTERS}]|\Z)|[^{ASCII_WHITE}]+")
#: White space is kept and one space joins the word after it.
LEADING = re.compile(rf" ?[{LETTERS}]+(?=[{ASCII_WHITE}{MARKS}]|\Z)| ?[{MARKS}]+(?=[{ASCII_WHITE}{LETTERS}]|\Z)| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def chunk_pattern(tokenizer_json: dict) -> re.Pattern | None:
    """How texts may be cut for this tokenizer; None: not at all."""
    before = tokenizer_json.get("pre_tokenizer") or {}
    normalizer = json.dumps(tokenizer_json.get("normalizer"))
    if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and normalizer == "null":
        return LEADING
    first = (before.get("pretokenizers") or [{}])[0]
    if first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and "[^\\s\\p{L}\\p{N}]+" in first["pattern"].get("Regex", ""):
        return DROPPED
    return None


def special_pattern(tokenizer_json: dict) -> tuple[re.Pattern | None, bool]:
    """A pattern of the added tokens' strings, and whether cutting a text at them is what the library does.

    It is where they are looked for in the text as it stands, without the white space around them;
    else texts that may hold one are encoded whole.
    """
    added = tokenizer_json.get("added_tokens") or []
    if not added:
        return None, True
    plain = not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    longest_first = sorted((t["content"] for t in added), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, longest_first)) + ")", 0 if plain else re.IGNORECASE), plain


class ChunkEncoder:
    """Encodes batches of texts. Every added token is one chunk of its own.

    The table of chunks is emptied when it holds `most` entries, so memory is bounded.
    """

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.pattern = chunk_pattern(described)
        self.special, cuts = special_pattern(described)
        if not cuts:
            self.pattern = None
        self.prefix = os.path.commonprefix([t["content"] for t in described.get("added_tokens") or [{"content": ""}]])
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.fresh: list[str] = []
        self.number = _Numbers(self.fresh)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.bounds = np.zeros(1 << 14, np.int64)
        self.filled = 0

    def _encode_fresh(self) -> None:
        if not self.fresh:
            return
        lists: list[list[int]] = [[]] * len(self.fresh)
        other = []
        tokenize, lower, space = self.tokenizer.model.tokenize, self.pattern is DROPPED, self.pattern is LEADING
        for k, chunk in enumerate(self.fresh):
            word = chunk[1:] if space and chunk[0] == " " else chunk
            if word.isascii() and word.isalpha():  # one word that neither normalizer nor pre-tokenizer splits or changes but for case and the mark of a space
                word = word.lower() if lower else word
                lists[k] = [x.id for x in tokenize(word if word is chunk or lower else f"\u0120{word}")]
            else:
                other.append(k)
        for k, x in zip(other, self.tokenizer.encode_batch_fast([self.fresh[k] for k in other], add_special_tokens=False), strict=True):
            lists[k] = x.ids
        self.fresh.clear()
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for ids in lists for i in ids), np.uint32, int(lengths.sum()))
        n, used = self.filled, int(self.bounds[self.filled])
        self.ids = _room(self.ids, used + len(flat))
        self.bounds = _room(self.bounds, n + len(lists) + 1)
        self.ids[used : used + len(flat)] = flat
        self.bounds[n + 1 : n + len(lists) + 1] = used + np.cumsum(lengths)
        self.filled = n + len(lists)

    def _chunks(self, text: str) -> list[str]:
        find = self.pattern.findall
        lowered = _lowered if self.pattern is DROPPED else str
        if self.special is None or self.prefix not in text:
            return find(lowered(text))
        out: list[str] = []
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                out.append(part)  # an added token, which the library encodes as such
            else:
                low = lowered(part)  # unless that makes an added token of what is none
                out += find(part if self.special.search(low) else low)
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the offsets of each text's (one more than texts)."""
        if self.pattern is None:
            found = [x.ids for x in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
            offsets = np.cumsum([0, *map(len, found)], dtype=np.int64)
            return np.fromiter((i for ids in found for i in ids), np.uint32, int(offsets[-1])), offsets
        if len(self.number) > self.most:
            self._clear()
        number = self.number.__getitem__
        chunks = [np.fromiter(map(number, self._chunks(t)), np.int64) if t else np.zeros(0, np.int64) for t in texts]
        self._encode_fresh()
        which = np.concatenate(chunks) if chunks else np.zeros(0, np.int64)
        starts = self.bounds[which]
        lengths = self.bounds[which + 1] - starts
        ends = np.concatenate([[0], np.cumsum(lengths)])
        offsets = ends[np.cumsum([0, *map(len, chunks)])]
        total = int(ends[-1])
        at = np.arange(total, dtype=np.int64)
        at += np.repeat(starts - ends[:-1], lengths)
        return self.ids[at], offsets.astype(np.int64)


def _lowered(text: str) -> str:
    """text in lower case where the normalizer's steps would give no more than that: within Latin-1 nothing composes."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class _Numbers(dict):
    """Numbers chunks as they come and notes the new ones."""

    def __init__(self, fresh: list[str]):
        super().__init__()
        self.fresh = fresh

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.fresh.append(chunk)
        return n


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """The encoder of this Python worker: its chunks serve the worker's later tasks too."""
    return ChunkEncoder(path)


def _room(array: np.ndarray, n: int) -> np.ndarray:
    if len(array) >= n:
        return array
    wider = np.zeros(max(n, 2 * len(array)), array.dtype)
    wider[: len(array)] = array
    return wider


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id `end` after each text."""
    return np.insert(ids, offsets[1:], np.uint32(end)), offsets + np.arange(len(offsets))


def slices(column, most: int = 1 << 20):
    """Runs of about `most` characters of an Arrow column's texts; no more than that is held as Python strings."""
    run, size = [], 0
    for text in (x for k in range(0, len(column), 128) for x in column.slice(k, 128).to_pylist()):
        run.append(text)
        size += len(text or "") + 1
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run
