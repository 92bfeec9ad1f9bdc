"""Screens lines for patterns: one pass over a line tells which of many patterns can match at all.

From each pattern literals are derived of which every match holds at least one; an Aho-Corasick
automaton finds the literals of all patterns at once. The screen never loses a match, it only saves
the time of patterns that cannot.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser as P

try:
    import ahocorasick
except ImportError:  # the slower search gives the same result
    ahocorasick = None


def _required(seq) -> set[str] | None:
    """Literals (in lower case) of which a match of the parsed sequence holds at least one; None if there are none to name."""
    options: list[set[str]] = []
    run = ""

    def close() -> None:
        nonlocal run
        if run:
            options.append({run})
        run = ""

    for op, arg in seq:
        if op is C.LITERAL:
            run += chr(arg).lower()
            continue
        if op is C.AT:
            close()
            continue
        close()
        found = None
        if op is C.SUBPATTERN:
            found = _required(arg[3])
        elif op is C.BRANCH:
            parts = [_required(x) for x in arg[1]]
            found = None if any(p is None for p in parts) else set().union(*parts)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] >= 1:
            found = _required(arg[2])
        elif op is C.IN and len(arg) <= 4 and all(o is C.LITERAL for o, _ in arg):
            found = {chr(a).lower() for _, a in arg}
        if found:
            options.append(found)
    close()
    return max(options, key=lambda o: (min(map(len, o)), -len(o))) if options else None


class Screen:
    def __init__(self, patterns: list[re.Pattern], literals: dict[int, tuple[str, ...]] | None = None):
        """``literals`` adds bits of their own: bit -> literals."""
        seeds: dict[str, int] = {}
        self.always = 0
        for i, p in enumerate(patterns):
            need = _required(P.parse(p.pattern, p.flags))
            if need is None:
                self.always |= 1 << i
            else:
                for s in need:
                    seeds[s] = seeds.get(s, 0) | 1 << i
        for i, words in (literals or {}).items():
            for s in words:
                seeds[s] = seeds.get(s, 0) | 1 << i
        self.seeds = seeds
        self.automaton = None
        if ahocorasick:
            self.automaton = ahocorasick.Automaton()
            for s, bits in seeds.items():
                self.automaton.add_word(s, bits)
            self.automaton.make_automaton()

    def mask(self, low: str) -> int:
        """Bits of the patterns that may match a text, given in lower case."""
        bits = self.always
        if self.automaton is not None:
            for _, b in self.automaton.iter(low):
                bits |= b
        else:
            for s, b in self.seeds.items():
                if s in low:
                    bits |= b
        return bits
