"""Template-markup matching: licence notices and statutory forms, found in page texts by token automata."""
from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

#: A word: digits, letters and everything beyond ASCII. Capitals of ASCII are lowered.
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_PIECE = 1 << 20
_KNOWN_WORDS = 1 << 20
_KNOWN_SETS = 1 << 16
_MARKS = re.compile(r"(\[\[|\]\]|\{\{.*?\}\})", re.S)

#: Phrases that stand for a licence wherever their words follow each other.
PHRASES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}

#: Notices in template markup: [[...]] may be missing, {{name 0-9}} is any run of so many words, {{a/b}} one of the readings.
NOTICES = {
    "mit-notice": "{{licensed/released/distributed/available}} under the [[terms of the]] mit license",
    "mit-terms": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files [[the software]] to deal in the software without restriction including without limitation the rights
        to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the
        software is furnished to do so subject to the following conditions the above copyright notice and this permission notice
        [[including the next paragraph]] shall be included in all copies or substantial portions of the software""",
    "isc-terms": """permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies""",
    "bsd-terms": """redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of
        conditions and the following disclaimer""",
    "bsd-no-endorsement": """neither the {{name/names}} of {{holder 1-12}} nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission""",
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0-header": """licensed under the apache license version 2 0 [[the license]] you may not use this file except in compliance
        with the license [[you may obtain a copy of the license at {{place 1-9}}]] unless required by applicable law or agreed to in
        writing software distributed under the license is distributed on an as is basis""",
    "gpl-2.0": "under the [[terms of the]] gnu general public license [[as published by the free software foundation]] version 2",
    "gpl-3.0": "under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 3",
    "gpl-or-later": """gnu general public license [[as published by the free software foundation]] [[either]] version {{number 1-1}} [[of the
        license]] or [[at your option]] any later version""",
    "cc-by-4.0": "{{licensed/available}} under [[a]] [[creative commons attribution]] cc by 4 0",
    "cc-by-nc-4.0": "{{licensed/available}} under [[a]] [[creative commons attribution noncommercial]] cc by nc 4 0",
    "cc-by-sa-4.0": "{{licensed/available}} under [[a]] [[creative commons attribution sharealike]] cc by sa 4 0",
    "spdx-tag": "spdx license identifier {{mit/apache/gpl/lgpl/agpl/bsd/isc/mpl/cc0/cc}}",
}

SCHEMA = "page_id long, n_words long, places array<struct<label string, kind string, first_word long, last_word long>>, score double"


@dataclass
class Automaton:
    """Word automaton of several templates: states with word, any-word and empty steps, read as sets of states."""

    words: dict[str, int] = field(default_factory=dict)
    empty: list[int] = field(default_factory=list)
    steps: list[dict[int, int]] = field(default_factory=list)
    anything: list[int] = field(default_factory=list)
    accepts: dict[int, tuple[str, str, int]] = field(default_factory=dict)
    start: int = 0

    def state(self) -> int:
        self.empty.append(0)
        self.steps.append({})
        self.anything.append(0)
        return len(self.steps) - 1

    def word(self, at: int, text: str) -> int:
        code, then = self.words.setdefault(text, len(self.words) + 1), self.state()
        self.steps[at][code] = self.steps[at].get(code, 0) | 1 << then
        return then

    def add(self, label: str, kind: str, template: str) -> None:
        """Compile a template. Its mandatory words are those outside optional and replaceable regions."""
        at, opened, mandatory = self.state(), [], 0
        first = at
        for part in _MARKS.split(template):
            if part == "[[":
                opened.append(at)
                # A region starts in a state of its own, so that what it skips is only its own words.
                then = self.state()
                self.empty[at] |= 1 << then
                at = then
            elif part == "]]":
                if not opened:
                    raise ValueError(f"{label}: a region ends that was not opened")
                then = self.state()
                self.empty[at] |= 1 << then
                self.empty[opened.pop()] |= 1 << then
                at = then
            elif part.startswith("{{"):
                at, fixed = self.region(label, at, part[2:-2].strip())
                mandatory += fixed and not opened
            else:
                for word in words_of(part):
                    at = self.word(at, word)
                    mandatory += not opened
        if opened or not mandatory:
            raise ValueError(f"{label}: " + ("a region is left open" if opened else "no mandatory word"))
        self.start |= 1 << first
        self.accepts[at] = (label, kind, mandatory)

    def region(self, label: str, at: int, told: str) -> tuple[int, int]:
        """A replaceable region: one of several readings, or any words between two numbers of them."""
        if "/" in told:
            then = self.state()
            for reading in told.split("/"):
                end = at
                for word in words_of(reading):
                    end = self.word(end, word)
                self.empty[end] |= 1 << then
            return then, 1
        least, most = map(int, re.fullmatch(r"\w+ (\d+)-(\d+)", told).groups())
        if most < least:
            raise ValueError(f"{label}: {told}")
        for n in range(most):
            then = self.state()
            self.anything[at] |= 1 << then
            if n >= least:
                self.empty[at] |= 1 << then
            at = then
        return at, 0

    def closed(self, states: int) -> int:
        """The states reached without a word."""
        todo = states
        while todo:
            low = todo & -todo
            new = self.empty[low.bit_length() - 1] & ~states
            states |= new
            todo = (todo ^ low) | new
        return states

    def step(self, states: int, code: int) -> int:
        then = 0
        while states:
            low = states & -states
            at = low.bit_length() - 1
            then |= self.steps[at].get(code, 0) | self.anything[at]
            states ^= low
        return self.closed(then)

    def accepted(self, states: int) -> tuple:
        return tuple(v for s, v in self.accepts.items() if states >> s & 1)


def words_of(text: str) -> list[str]:
    """Words of a short text."""
    return WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))


def compiled(phrases: Mapping[str, str], templates: Mapping[str, str]) -> Automaton:
    """One automaton of all phrases and templates."""
    machine = Automaton()
    for label, text in phrases.items():
        machine.add(label, "phrase", text)
    for label, text in templates.items():
        machine.add(label, "template", text)
    return machine


class Scanner:
    """Reads texts with an automaton; sets of states seen before are numbered, so that a known step is one look-up."""

    def __init__(self, machine: Automaton):
        self.machine = machine
        self.codes: dict[str, int] = {}
        self.forget()
        start = machine.closed(machine.start)
        self.begins = np.zeros(len(machine.words) + 1, bool)
        for code in machine.words.values():
            self.begins[code] = bool(machine.step(start, code))

    def forget(self) -> None:
        self.sets: dict[int, int] = {}
        self.known: list[tuple[int, tuple]] = []
        self.moves: dict[tuple[int, int], int] = {}
        self.number(0)
        self.first = self.number(self.machine.closed(self.machine.start))

    def number(self, states: int) -> int:
        if states not in self.sets:
            self.sets[states] = len(self.known)
            self.known.append((states, self.machine.accepted(states)))
        return self.sets[states]

    def code(self, word: str) -> int:
        code = self.machine.words.get(word.lower() if word.isascii() else word, 0)
        if len(self.codes) < _KNOWN_WORDS:
            self.codes[word] = code
        return code

    def read(self, text: str) -> np.ndarray:
        """Codes of a text's words; words no template names are 0. Long texts are read piece by piece, parted between words."""
        found, at, get = [], 0, self.codes.get
        while at < len(text):
            end = min(at + _PIECE, len(text))
            if end < len(text) and (last := WORD.match(text, end)) and WORD.match(text, end - 1):
                end = last.end()
            words = WORD.findall(text, at, end)
            codes = [get(w, -1) for w in words]
            found.append(np.array([self.code(w) if c < 0 else c for w, c in zip(words, codes)] if -1 in codes else codes, np.int32))
            at = end
        return np.concatenate(found) if found else np.zeros(0, np.int32)

    def scan(self, text: str) -> tuple[int, list[tuple[str, str, int, int]], int]:
        """Words of a text, its places (label, kind, first and last word) and the most mandatory words of one of them.

        A place is a word a template can start with and, of the readings accepted from there, the longest.
        """
        codes = self.read(text)
        told, places, weight = codes.tolist() if len(codes) else [], [], 0
        for begin in np.flatnonzero(self.begins[codes]).tolist():
            if len(self.known) > _KNOWN_SETS:
                self.forget()
            now, ends, at = self.first, {}, begin
            while now and at < len(told):
                then = self.moves.get((now, told[at]))
                if then is None:
                    then = self.number(self.machine.step(self.known[now][0], told[at]))
                    self.moves[now, told[at]] = then
                now = then
                for accepted in self.known[now][1]:
                    ends[accepted] = at
                at += 1
            for (label, kind, mandatory), end in ends.items():
                places.append((label, kind, begin, end))
                weight = max(weight, mandatory)
        return len(told), places, weight


def matched_templates(documents: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = NOTICES) -> DataFrame:
    """Find licence notices, statutory forms and the like in every whole text of ``documents`` (page_id, text).

    Texts are read as words, runs of ``[0-9A-Za-z]`` and of signs beyond ASCII, capitals of ASCII lowered. A template names
    words that must stand exactly so, with marked regions: ``[[...]]`` may be missing (regions may lie in each other),
    ``{{name 1-9}}`` stands for any one to nine words, ``{{sold/lent}}`` for one of the readings. Phrases and templates
    become one automaton over words; it is run from every word that can start one of them and stops where nothing can
    follow, so a place costs no more than the longest template, whatever the text.

    Returns one row per row: page_id, n_words, places (label, kind ``phrase`` or ``template``, first_word and last_word
    from 0; of several readings from one word the longest; ordered by first word), and score: m / (m + 4), m the mandatory
    words of the place that has most of them, 0 without a place. A two-word mention is weak evidence, a licence's terms
    are nearly 1.

    A null text is empty and has no words and no places. Very long texts are read piece by piece. Repeated rows and rows
    without page_id are rows of their own. Other columns are ignored; an empty table gives no rows.
    """
    small_batches(documents.sparkSession, 1000, "8m")
    machine = compiled(phrases, templates)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(machine)
        kind = pa.struct([("label", pa.string()), ("kind", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())])
        for batch in batches:
            found = [scanner.scan(text or "") for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([n for n, _, _ in found], pa.int64()),
                 pa.array([[dict(zip(("label", "kind", "first_word", "last_word"), p)) for p in places] for _, places, _ in found], pa.list_(kind)),
                 pa.array([w / (w + 4) for _, _, w in found], pa.float64())], ["page_id", "n_words", "places", "score"])

    return documents.select("page_id", "text").mapInArrow(task, SCHEMA)
