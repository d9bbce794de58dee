"""License wording in texts: phrases, and templates with optional and replaceable regions.

A template is license wording with markup.  It is compiled into an automaton over
words: mandatory words follow one another, an optional region may be stepped over,
a replaceable region takes one of its listed wordings or any words up to a number.
A stretch of a text is accepted if the automaton reads it from its first word to
its last; every mandatory word has to stand there, and nothing else between them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, fresh_names

#: What the contract calls base phrases, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Templates by label.  ``[[ ... ]]`` is optional, ``{{a|b}}`` one of the wordings, ``{{*n}}`` any words, at most n.
#: License wording is fixed; the markup says where texts may differ.
TEMPLATES = {
    "mit-notice": (
        "{{released|licensed|distributed|available}} under the [[terms of the]] [[{{expat|x11}}]] mit license"
    ),
    "mit-text": (
        "[[the]] [[mit license]] [[copyright [[c]] {{*24}}]] permission is hereby granted free of charge to any person obtaining a copy"
        " of this software and associated documentation files the software to deal in the software without restriction including without"
        " limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
        " persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this"
        " permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software"
        " [[the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of"
        " merchantability fitness for a particular purpose and noninfringement in no event shall {{*12}} be liable for any claim damages"
        " or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or"
        " the use or other dealings in the software]]"
    ),
    "apache-2.0-notice": (
        "licensed under the apache license version 2 0 [[the license you may not use this file except in compliance with the license"
        " [[you may obtain a copy of the license at {{*12}}]] [[unless required by applicable law or agreed to in writing software"
        " distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or"
        " implied see the license for the specific language governing permissions and limitations under the license]]]]"
    ),
    "gpl-notice": (
        "{{licensed|released|distributed}} under the [[terms of the]] gnu [[{{lesser|library|affero}}]] general public license"
        " [[as published by the free software foundation]] [[either]] [[version {{1|2|2 0|2 1|3|3 0}} [[of the license]]]]"
        " [[or at your option any later version]] [[or later]]"
    ),
    "gpl-text": (
        "free software you can redistribute it and or modify it under the terms of the gnu [[{{lesser|library|affero}}]]"
        " general public license as published by the free software foundation either version {{*2}} of the license or at your option any"
        " later version"
    ),
    "cc-notice": (
        "{{licensed|released|distributed|available}} under [[{{a|the}}]] {{cc|creative commons}}"
        " {{by|attribution}} [[{{nc|noncommercial}}]] [[{{sa|nd|sharealike|noderivatives|noderivs}}]]"
        " [[{{1 0|2 0|2 5|3 0|4 0}}]] [[{{international|unported|generic}}]] [[license]]"
    ),
    "mpl-2.0-notice": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 [[if a copy of the mpl was not distributed"
        " with this file you can obtain one at {{*10}}]]"
    ),
    "isc-text": (
        "[[isc license]] [[copyright [[c]] {{*24}}]] permission to use copy modify and or distribute this software for any purpose with or"
        " without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "bsd-text": (
        "[[copyright [[c]] {{*24}}]] redistribution and use in source and binary forms with or without modification are permitted provided"
        " that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of"
        " conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list"
        " of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
        " [[[[3]] neither the name of {{*14}} nor the names of its contributors may be used to endorse or promote products derived from"
        " this software without specific prior written permission]]"
    ),
    "unlicense-text": (
        "this is free and unencumbered software released into the public domain [[anyone is free to copy modify publish use compile sell or"
        " distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by"
        " any means]]"
    ),
}

_MARKUP = re.compile(r"\[\[|\]\]|\{\{[^}]*\}\}|[^\s\[\]{}]+")
_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_LOWER = bytes(range(0x41, 0x5B))
#: A-Z to a-z, all other ASCII that is no letter or digit to a space.
_TABLE = bytes.maketrans(_LOWER + _SEPARATORS, _LOWER.lower() + b" " * len(_SEPARATORS))
#: Words of a template's beginning that a text is searched for.
OPENING = 3


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters and digits and of all characters beyond ASCII."""
    return text.encode().translate(_TABLE).split()


@dataclass
class Automaton:
    """States are numbered; ``steps`` by word, ``any_word`` and ``free`` (without a word) lead on; 0 is the first state."""

    label: str
    steps: list[dict[bytes, list[int]]] = field(default_factory=list)
    any_word: list[list[int]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    #: mandatory words read when a state is reached
    done: list[int] = field(default_factory=list)
    last: int = 0
    _closed: dict[frozenset[int], frozenset[int]] = field(default_factory=dict, repr=False)
    _next: dict[tuple[frozenset[int], bytes], frozenset[int]] = field(default_factory=dict, repr=False)

    @classmethod
    def compile(cls, label: str, template: str) -> Automaton:
        made = cls(label)
        parts = _MARKUP.findall(template)
        here, rest = made._part(parts, made._state(0), 0)
        if rest:
            raise ValueError(f"{label}: a region is closed that was not opened")
        made.last = here
        if made.last in made.start():
            raise ValueError(f"{label}: no mandatory word")
        return made

    def _state(self, done: int) -> int:
        self.steps.append({})
        self.any_word.append([])
        self.free.append([])
        self.done.append(done)
        return len(self.steps) - 1

    def _read(self, here: int, words: Iterable[str], counted: int) -> int:
        for word in words:
            there = self._state(self.done[here] + counted)
            self.steps[here].setdefault(word.encode(), []).append(there)
            here = there
        return here

    def _part(self, parts: list[str], here: int, depth: int) -> tuple[int, list[str]]:
        """Read markup up to the end of the region; the state after it and what is left."""
        while parts:
            part, parts = parts[0], parts[1:]
            if part == "]]":
                if not depth:
                    return here, [part]
                return here, parts
            if part == "[[":
                inner, parts = self._part(parts, here, depth + 1)
                after = self._state(self.done[here])
                self.free[inner].append(after)
                self.free[here].append(after)
                here = after
            elif part.startswith("{{*"):
                after = self._state(self.done[here])
                for _ in range(int(part[3:-2])):
                    self.free[here].append(after)
                    there = self._state(self.done[here])
                    self.any_word[here].append(there)
                    here = there
                self.free[here].append(after)
                here = after
            elif part.startswith("{{"):
                counted = int(not depth)
                after = self._state(self.done[here] + counted)
                for wording in part[2:-2].split("|"):
                    self.free[self._read(here, wording.split(), 0)].append(after)
                here = after
            else:
                here = self._read(here, [part], int(not depth))
        if depth:
            raise ValueError(f"{self.label}: a region is not closed")
        return here, []

    def closed(self, states: Iterable[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def start(self) -> frozenset[int]:
        return self.closed([0])

    def after(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        """The states a word leads to; remembered, so that states are sets once."""
        known = self._next.get((states, word))
        if known is None:
            there = {t for s in states for t in (*self.steps[s].get(word, ()), *self.any_word[s])}
            known = self.closed(there)
            if len(self._next) > 50_000:
                self._next.clear()
            self._next[states, word] = known
        return known

    def openings(self) -> set[tuple[bytes, ...]]:
        """How accepted stretches begin: up to OPENING words, fewer where any word may follow."""
        out: set[tuple[bytes, ...]] = set()
        todo: list[tuple[tuple[bytes, ...], frozenset[int]]] = [((), self.start())]
        while todo:
            words, states = todo.pop()
            if len(words) == OPENING or self.last in states or any(self.any_word[s] for s in states):
                out.add(words)
                continue
            for word in {w for s in states for w in self.steps[s]}:
                todo.append(((*words, word), self.after(states, word)))
        return out

    def read(self, words: list[bytes], at: int) -> tuple[int, float]:
        """The end of the longest accepted stretch from word ``at`` on (or -1), and the greatest share of mandatory words read."""
        states, end, done = self.start(), -1, 0
        for i in range(at, len(words)):
            states = self.after(states, words[i])
            if not states:
                break
            done = max(done, max(self.done[s] for s in states))
            if self.last in states:
                end = i + 1
        return end, done / self.done[self.last]


class Scanner:
    """All phrases and templates, searched for in one text after another."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]) -> None:
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
        self.automata = [Automaton.compile(label, t) for label, t in templates.items()]
        self.openings: dict[bytes, list[Automaton]] = {}
        for a in self.automata:
            for opening in a.openings():
                if not opening:
                    raise ValueError(f"{a.label}: begins with any words")
                self.openings.setdefault(b" " + b" ".join(opening) + b" ", []).append(a)

    def scan(self, text: str) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str]], float]:
        """Words, places of phrases, accepted stretches of each template (leftmost, longest), and the greatest share matched."""
        words = words_of(text)
        joined = b" " + b" ".join(words) + b" "
        places = sorted((at, label) for phrase, label in self.phrases for at in _places(joined, phrase))
        begins: dict[str, set[int]] = {}
        named: dict[str, Automaton] = {}
        for opening, automata in self.openings.items():
            if opening in joined:
                for at in _places(joined, opening):
                    for a in automata:
                        begins.setdefault(a.label, set()).add(at)
                        named[a.label] = a
        stretches, share = [], 0.0
        for label, starts in begins.items():
            past = 0
            for at in sorted(starts):
                if at < past:
                    continue
                end, part = named[label].read(words, at)
                share = max(share, part)
                if end >= 0:
                    stretches.append((at, end, label))
                    past = end
        return len(words), places, sorted(stretches), share


def _places(joined: bytes, phrase: bytes) -> list[int]:
    """The numbers of the words at which ``phrase`` begins."""
    out, at, word, before = [], joined.find(phrase), 0, 0
    while at >= 0:
        word += joined.count(b" ", before, at)
        before = at
        out.append(word)
        at = joined.find(phrase, at + 1)
    return out


ADDED = ["n_words", "places", "stretches", "score"]


def scan(df: DataFrame, text: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``df`` plus n_words, places (array of start, label), stretches (array of start, end, label) and score (0 to 1).

    Words are numbered from 0.  ``places`` are all places of phrases; ``stretches``
    are what templates accept, each template's leftmost first, longest, without
    overlaps.  ``score`` is 1 where a template accepts, else a half where a phrase
    stands, else half the greatest share of a template's mandatory words that
    stand in one stretch from its beginning.  Null and empty texts have no words
    and score 0.  Input columns of these names are replaced.
    """
    names = fresh_names(df, ADDED)
    scanner = Scanner(phrases, templates)
    place = pa.struct([("start", pa.int64()), ("label", pa.string())])
    stretch = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())])

    def work(texts: list[str]) -> dict[str, pa.Array]:
        found = [scanner.scan(t) for t in texts]
        return {
            "n_words": pa.array([f[0] for f in found], pa.int64()),
            "places": pa.array([[{"start": s, "label": x} for s, x in f[1]] for f in found], pa.list_(place)),
            "stretches": pa.array([[{"start": s, "end": e, "label": x} for s, e, x in f[2]] for f in found], pa.list_(stretch)),
            "score": pa.array([1.0 if f[2] else 0.5 if f[1] else f[3] / 2 for f in found], pa.float64()),
        }

    extra = "n_words bigint, places array<struct<start:bigint,label:string>>, stretches array<struct<start:bigint,end:bigint,label:string>>, score double"
    return arrow_map(df, names, text, extra, work)
