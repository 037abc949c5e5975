"""Vocabulary matches by Aho-Corasick, and the units of a text between which no piece can reach."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick

from .spm import SPACE, Model

#: Units that a worker remembers before it forgets them all.
REMEMBERED = 600_000


class Matcher:
    """Enumerates all vocabulary pieces in a string with one Aho-Corasick pass."""

    def __init__(self, model: Model):
        self.vocabulary = model.normal()
        self.automaton = self.compile(lambda piece, ident: (len(piece), ident))
        self.singles = frozenset(p for p in self.vocabulary if len(p) == 1)
        #: Whether a piece holds spaces behind its leading run; a text can't be cut before its spaces then.
        self.whole = any(SPACE in p.lstrip(SPACE) for p in self.vocabulary)
        inside = {c for p in self.vocabulary for c in p}
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in inside)
        self._units = re.compile(f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def compile(self, value: Callable[[str, int], tuple]) -> ahocorasick.Automaton:
        """The automaton over all pieces, with a value for each piece and id."""
        automaton = ahocorasick.Automaton()
        for piece, ident in self.vocabulary.items():
            automaton.add_word(piece, value(piece, ident))
        automaton.make_automaton()
        return automaton

    def units(self, normal: str) -> list[str]:
        """The runs of a normalised text that segment independently: a word with the spaces before it."""
        return [normal] * bool(normal) if self.whole else self._units.findall(normal)

    def ends(self, unit: str) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """For each end position, the pieces (length, id) that end there, longest first."""
        found: list[list[tuple[int, int]]] = [[] for _ in unit]
        for end, match in self.automaton.iter(unit):
            found[end].append(match)
        for end, matches in enumerate(found):
            matches.sort(reverse=True)
            yield end + 1, matches
