"""A model's normaliser as a sequential transducer."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .spm import SPACE, USER_DEFINED, Model, read_charsmap


class Trie:
    """States are numbers, the root 0; an arc takes one character.  ``end`` holds what is accepted in a state."""

    def __init__(self, entries: dict[str, object]):
        self.arcs: list[dict[str, int]] = [{}]
        self.end: list = [None]
        for text, value in entries.items():
            state = 0
            for char in text:
                to = self.arcs[state].get(char)
                if to is None:
                    to = self.arcs[state][char] = len(self.arcs)
                    self.arcs.append({})
                    self.end.append(None)
                state = to
            self.end[state] = value

    def longest(self, text: str, at: int) -> tuple[int, object] | None:
        """End and value of the longest entry that starts at ``at``."""
        state, found = 0, None
        for i in range(at, len(text)):
            state = self.arcs[state].get(text[i])
            if state is None:
                break
            if self.end[state] is not None:
                found = i + 1, self.end[state]
        return found


class Normaliser:
    """The sequential transducer from texts to normal forms."""

    def __init__(self, model: Model):
        self.model = model
        rules = {k: (v, False) for k, v in read_charsmap(model.charsmap).items()}
        rules |= {p: (p, True) for p in model.of_kind(USER_DEFINED)}
        self.trie = Trie(rules)
        self.mark = SPACE if model.escape_spaces else " "
        #: Characters with which a rule may start; all others are copied.
        self.starts = re.compile("[" + "".join(map(re.escape, self.trie.arcs[0])) + "]") if rules else None
        self.user = Trie({p: True for p in model.of_kind(USER_DEFINED)})

    def rewritten(self, text: str) -> Iterator[str]:
        """Outputs of the first machine: copied runs, and the rules' texts."""
        at = 0
        while True:
            hit = self.starts.search(text, at) if self.starts else None
            if hit is None:
                break
            i = hit.start()
            if i > at:
                yield text[at:i]
            user = self.user.longest(text, i)
            if user:  # user-defined symbols come before the map, however long its match
                yield text[i : user[0]]
                at = user[0]
                continue
            match = self.trie.longest(text, i)
            at = match[0] if match else i + 1
            yield match[1][0] if match else text[i]
        if at < len(text):
            yield text[at:]

    def __call__(self, text: str) -> str:
        """The normal form.  The space machine's states: at the start or behind a space, and elsewhere."""
        model = self.model
        if model.squeeze_spaces:
            out, behind = [], True
            for part in self.rewritten(text):
                if behind:
                    part = part.lstrip(" ")
                if part:
                    out.append(part if part == " " else re.sub("  +", " ", part))
                    behind = part.endswith(" ")
            text = "".join(out)
        elif self.starts:
            text = "".join(self.rewritten(text))
        if not text:
            return ""
        if model.dummy_prefix and not model.space_as_suffix:
            text = " " + text
        text = text.replace(" ", self.mark)
        if model.squeeze_spaces:
            text = text.rstrip(self.mark)
        return text + self.mark if model.dummy_prefix and model.space_as_suffix else text
