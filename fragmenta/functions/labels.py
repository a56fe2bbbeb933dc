"""Labels of elements in lines that text recognition has marred.

All spellings of all labels stand in one automaton (a trie with failure links) over squeezed text:
lower case, without blanks, hyphens and apostrophes. One pass over a line tells which labels it may
hold; only those are then tried by their own pattern, which also says where they begin and end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cached_property

import ahocorasick

_SQUEEZED = {c: None for c in [*range(9, 14), 32, 0xA0, *map(ord, "-'’ʼ‘`")]}


def squeezed(text: str) -> str:
    return text.translate(_SQUEEZED).lower()


class Labels:
    """table: (canonical name, pattern, spellings). Of labels that fit, the first in the table counts."""

    def __init__(self, table: Sequence[tuple[str, str, Sequence[str]]]) -> None:
        self.table = tuple(table)

    def __reduce__(self):
        return Labels, (self.table,)

    @cached_property
    def patterns(self) -> list[re.Pattern]:
        return [re.compile(p) for _, p, _ in self.table]

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        own: dict[str, set[int]] = {}
        for i, (_, _, spellings) in enumerate(self.table):
            for s in spellings:
                own.setdefault(squeezed(s), set()).add(i)
        out = ahocorasick.Automaton()
        for s, labels in own.items():
            out.add_word(s, labels)
        out.make_automaton()
        return out

    def possible(self, line: str) -> list[int]:
        """The labels that a line may hold somewhere, in the table's order."""
        return sorted(set().union(*(labels for _, labels in self.automaton.iter(squeezed(line)))))

    def matches(self, line: str, where: str) -> Iterator[tuple[str, re.Match]]:
        for i in self.possible(line):
            m = self.patterns[i].match(line) if where == "start" else self.patterns[i].search(line)
            if m:
                yield self.table[i][0], m

    def at_start(self, line: str) -> tuple[str, int] | None:
        """The label that a line begins with, and where it ends."""
        return next(((name, m.end()) for name, m in self.matches(line, "start")), None)

    def at_end(self, line: str) -> tuple[str, int] | None:
        """The label that a line ends with (full stops and blanks aside) and hasn't had before, and where it begins."""
        end = len(line.rstrip(". ").rstrip())
        return next(((name, m.start()) for name, m in self.matches(line, "any") if m.end() == end), None)
