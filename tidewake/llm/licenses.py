"""License scans by matching texts against template markup.

A template is wording with optional regions, <<beginOptional>> .. <<endOptional>>, and replaceable
ones, <<var;name="..";original="..";match="..">>, whose match is alternatives of words (`a|b c`) or
a bounded gap of any words (`.{0,9}`). Templates are compiled to token automata (sets of states,
built lazily and shared by all texts of a task); a text is accepted where the mandatory wording
stands exactly, word by word, whatever the optional and replaceable regions hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The phrases of the base scan and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_VERB = '<<var;name="verb";original="Licensed";match="licensed|released|distributed|available|provided">>'
#: Template markup of notices and license texts, by label.
TEMPLATES = {
    "mit-notice": f"{_VERB} under the <<beginOptional>>terms of the<<endOptional>> MIT License",
    "apache-2.0-notice": f"{_VERB} under the <<beginOptional>>terms of the<<endOptional>> Apache License<<beginOptional>>,<<endOptional>> Version 2.0",
    "gpl-3.0-notice": f"{_VERB} under the <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>GNU<<endOptional>> General Public License<<beginOptional>>, as published by the Free Software Foundation<<endOptional>> version 3",
    "cc-by-nc-4.0-notice": f'{_VERB} under <<beginOptional>>a<<endOptional>> <<var;name="name";original="CC BY-NC";match="cc by nc|creative commons attribution noncommercial">> 4.0 <<beginOptional>>International License<<endOptional>>',
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.',
    "isc-text": 'Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.',
    "bsd-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
    "bsd-3-clause-text": 'this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. <<beginOptional>>3<<endOptional>> Neither the name of <<var;name="organization";original="the copyright holder";match=".{0,12}">> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.',
    "apache-2.0-text": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at <<var;name="url";original="http";match="http|https">>://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "gpl-text": 'is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation<<beginOptional>>; either<<endOptional>> version <<var;name="version";original="3";match="2|3">> of the License<<beginOptional>>, or (at your option) any later version<<endOptional>>',
    "lgpl-text": 'is free software: you can redistribute it and/or modify it under the terms of the GNU <<var;name="name";original="Lesser";match="lesser|library">> General Public License as published by the Free Software Foundation<<beginOptional>>; either<<endOptional>> version <<var;name="version";original="3";match="2|2 1|3">> of the License',
    "mpl-2.0-text": 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at <<var;name="url";original="http";match="http|https">>://mozilla.org/MPL/2.0',
    "unlicense-text": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.',
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SPACED = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words (A-Z only): runs of digits, letters and anything beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_SPACED).split()


def parse(template: str) -> list:
    """Markup as a sequence of words (bytes), ("optional", sequence), ("either", sequences), ("gap", n)."""
    stack: list[list] = [[]]
    for part in re.split(r"(<<.*?>>)", template):
        if part == "<<beginOptional>>":
            stack.append([])
        elif part == "<<endOptional>>":
            if len(stack) == 1:
                raise ValueError("an optional region ends that did not begin")
            inner = stack.pop()
            if inner:
                stack[-1].append(("optional", inner))
        elif part.startswith("<<var;"):
            match = re.search(r';match="([^"]*)"', part)
            if not match:
                raise ValueError(f"no match in {part}")
            gap = re.fullmatch(r"\.\{0,(\d+)\}", match[1])
            stack[-1].append(("gap", int(gap[1])) if gap else ("either", [words_of(x) for x in match[1].split("|")]))
        elif part.startswith("<<"):
            raise ValueError(f"unknown markup {part}")
        else:
            stack[-1].extend(words_of(part))
    if len(stack) > 1:
        raise ValueError("an optional region does not end")
    return stack[0]


class Automaton:
    """Token automaton of a template; deterministic states are made when first reached."""

    ANY = object()

    def __init__(self, sequence: list):
        self.moves: list[list[tuple[object, int]]] = []
        self.skips: list[list[int]] = []
        self.start = self._state()
        self.end = self._build(sequence, self.start)
        self.keys = [x for x in sequence if isinstance(x, bytes)]
        if not self.keys:
            raise ValueError("a template needs mandatory wording")
        self.key = max(self.keys, key=len)  # every accepted text holds it
        self.initial = self._closure({self.start})
        self.table: dict[tuple[frozenset, bytes], frozenset] = {}
        self.first = {label for s in self.initial for label, _ in self.moves[s]}

    def _state(self) -> int:
        self.moves.append([])
        self.skips.append([])
        return len(self.moves) - 1

    def _build(self, sequence: list, at: int) -> int:
        for x in sequence:
            if isinstance(x, bytes):
                then = self._state()
                self.moves[at].append((x, then))
            elif x[0] == "optional":
                then = self._build(x[1], at)
                self.skips[at].append(then)
            elif x[0] == "either":
                then = self._state()
                for other in x[1]:
                    self.skips[self._build(other, at) if other else at].append(then)
            else:
                then, ends = at, []
                for _ in range(x[1]):
                    ends.append(then)
                    after = self._state()
                    self.moves[then].append((self.ANY, after))
                    then = after
                for e in ends:
                    self.skips[e].append(then)
            at = then
        return at

    def _closure(self, states: set[int]) -> frozenset:
        todo, found = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)

    def accepts(self, words: list[bytes], at: int) -> bool:
        """Whether the template matches from word `at` on."""
        states = self.initial
        while True:
            if self.end in states:
                return True
            if at >= len(words):
                return False
            step = (states, words[at])
            after = self.table.get(step)
            if after is None:
                after = self._closure({t for s in states for label, t in self.moves[s] if label is self.ANY or label == words[at]})
                if len(self.table) < 100_000:
                    self.table[step] = after
            if not after:
                return False
            states, at = after, at + 1

    def found(self, words: list[bytes]) -> bool:
        anywhere = self.ANY in self.first
        return any((anywhere or w in self.first) and self.accepts(words, i) for i, w in enumerate(words))


def pattern(template: str) -> str:
    """Markup as a regular expression over words that each stand between spaces, by replacing its text part by part.

    For SQL: it shares nothing with `parse` and the automata, so each checks the other.
    """

    def words(text: str) -> str:
        return "".join(f" {w} " for w in re.split("[^0-9a-z]+", text.lower()) if w)

    def part(m: re.Match) -> str:
        markup = m[0]
        if markup == "<<beginOptional>>":
            return "(?:"
        if markup == "<<endOptional>>":
            return ")?"
        if markup.startswith("<<var;"):
            match = re.search('match="(.*?)"', markup)[1]
            return f"(?: [^ ]+ ){match[1:]}" if match.startswith(".{") else "(?:" + "|".join(map(words, match.split("|"))) + ")"
        return words(markup)

    return re.sub("<<.*?>>|[^<]+", part, template)


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, columns: list[str], templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """The given columns of docs with the licenses found in each whole text.

    n_base places of base phrases, their smallest and largest first word, base labels, all labels
    (those of accepted templates too) and a score: 1 where the wording of a license (`..-text`) is
    accepted, 0.9 for a notice alone, 0.8 n / (n + 1) for n base phrases alone, else 0. A null text
    is empty; rows with equal texts or ids are scanned each on its own; an empty table gives no
    rows. A text is walked once, however long it is. A column of `columns` that is called like one
    of the results is an error; other names never clash.
    """
    from pyspark.sql import types as T

    results = [x.split()[0] for x in SCHEMA.split(", ")]
    if {c.lower() for c in columns} & set(results):
        raise ValueError(f"columns are called like results: {columns}")
    (name,) = common.fresh(docs, "text")
    given = docs.select(*columns, F.col("text").cast("string").alias(name))
    schema = T.StructType([*given.schema.fields[:-1], *T._parse_datatype_string(SCHEMA).fields])
    parsed = {label: parse(t) for label, t in templates.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = {label: Automaton(p) for label, p in parsed.items()}
        phrases = {b" " + p.encode().replace(b" ", b"  ") + b" ": label for p, label in PHRASES.items()}
        keys = {a.key for a in automata.values()}
        for batch in batches:
            rows = []
            for text in batch.column(name):
                data = b"" if text.as_py() is None else text.as_buffer().to_pybytes().translate(_SPACED)
                words = data.split()
                places, base, labels = [], set(), set()
                if b"license" in data:
                    joined = b" " + b"  ".join(words) + b" "
                    for phrase, label in phrases.items():
                        at, seen, number = joined.find(phrase), 0, 0
                        while at >= 0:
                            base.add(label)
                            number += joined.count(b"  ", seen, at + 1)  # words since the place before
                            seen = at + 1
                            places.append(number)
                            at = joined.find(phrase, at + 1)
                if any(k in data for k in keys):
                    labels = {label for label, a in automata.items() if a.key in data and a.found(words)}
                score = 1.0 if any(x.endswith("-text") for x in labels) else 0.9 if labels else 0.8 * (len(places) / (len(places) + 1))
                rows.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], *results])

    return given.mapInArrow(run, schema)


def oracle() -> str:
    """DuckDB SQL for the scan of `documents`."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    phrase = {p: f" {p.replace(' ', '  ')} " for p in PHRASES}
    count = {p: f"(length(s) - length(replace(s, '{q}', ''))) // {len(q)}" for p, q in phrase.items()}
    before = "(length({x}) - length(replace({x}, '  ', ''))) // 2"
    first = {p: before.format(x=f"s[1:strpos(s, '{q}')]") for p, q in phrase.items()}
    last = {p: before.format(x=f"s[1:length(s) - strpos(reverse(s), '{q[::-1]}') - {len(q) - 2}]") for p, q in phrase.items()}
    has = {p: f"contains(s, '{q}')" for p, q in phrase.items()}
    base = ", ".join(f"CASE WHEN {has[p]} THEN '{label}' END" for p, label in PHRASES.items())
    more = ", ".join(f"CASE WHEN regexp_matches(s, '{pattern(t)}') THEN '{label}' END" for label, t in TEMPLATES.items())
    n_base = " + ".join(count.values())
    listed = lambda x: f"list_sort(list_distinct(list_filter([{x}], lambda v: v IS NOT NULL)))"
    return f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
), j AS (SELECT doc_id, len(ws) AS n_words, ' ' || array_to_string(ws, '  ') || ' ' AS s FROM w),
l AS (SELECT *, {listed(base)} AS b, {listed(base + ", " + more)} AS a, {listed(more)} AS m FROM j)
SELECT doc_id, n_words, {n_base} AS n_base,
  least({", ".join(f"CASE WHEN {has[p]} THEN {x} END" for p, x in first.items())}) AS first_word,
  greatest({", ".join(f"CASE WHEN {has[p]} THEN {x} END" for p, x in last.items())}) AS last_word,
  array_to_string(b, ',') AS base_labels, array_to_string(a, ',') AS labels,
  CASE WHEN len(list_filter(m, lambda v: v LIKE '%-text')) > 0 THEN 1 WHEN len(m) > 0 THEN 0.9 ELSE 0.8::DOUBLE * (({n_base})::DOUBLE / ({n_base} + 1)::DOUBLE) END::DOUBLE AS score
FROM l"""
