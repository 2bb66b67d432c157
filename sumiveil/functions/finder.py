"""Places of many literal strings in a text, in one pass."""

from __future__ import annotations

try:
    import ahocorasick
except ImportError:
    ahocorasick = None

#: Up to so many needles are looked for one by one.
FEW = 16


class Finder:
    """All places of each needle, left to right and not overlapping one of its own."""

    def __init__(self, needles: list[str]):
        self.needles = needles
        self.automaton = None
        if ahocorasick and len(needles) > FEW:
            at: dict[str, list[int]] = {}
            for k, n in enumerate(needles):
                if n:
                    at.setdefault(n, []).append(k)
            self.automaton = ahocorasick.Automaton()
            for n, ks in at.items():
                self.automaton.add_word(n, (len(n), ks))
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int]]:
        """(needle, begin) by needle, then place."""
        out = []
        if self.automaton is None:
            for k, n in enumerate(self.needles):
                p = text.find(n) if n else -1
                while p >= 0:
                    out.append((k, p))
                    p = text.find(n, p + len(n))
            return out
        free: dict[int, int] = {}
        for end, (size, ks) in self.automaton.iter(text):
            begin = end - size + 1
            for k in ks:
                if begin >= free.get(k, 0):
                    free[k] = end + 1
                    out.append((k, begin))
        out.sort()
        return out
