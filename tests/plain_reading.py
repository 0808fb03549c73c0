"""Sentences read word by word, in plain Python: what the expressions of ashlar.operators.themes must find too."""

import re
from dataclasses import dataclass

from ashlar.operators.themes import CLAUSE_ENDS, CONNECTORS, EXCEPTIONS, FILLERS, LIST_GAP, NEGATORS, TAKEN_BACK, THEMES, WINDOW, Theme, stems

_WORD = re.compile(r"[a-z0-9]+(?:'[a-z]+)?|[^\sa-z0-9]", re.I)
_BACK = re.compile(TAKEN_BACK, re.I | re.A)


@dataclass(frozen=True)
class Hit:
    theme: int
    start: int
    end: int
    soft: bool  # whether negation turns it


class Scanner:
    """Reads a sentence once, from left to right, and keeps what a negator still reaches.

    A negator opens a scope. Words of the filler list leave it open, WINDOW of them at most; a theme's words inside it are negated, and after them
    connectors of a list, LIST_GAP at most, carry it on to the next theme of the same polarity. Any other word closes it, and so do words whose pattern
    holds its own negation. What the rest of the clause takes back is negated too, and opens the scope for the list it begins.
    """

    def __init__(self, themes: tuple[Theme, ...] = THEMES):
        self.themes = themes
        self.number = {t.theme: k for k, t in enumerate(themes)}
        self.patterns = [(k, re.compile(rf"\b(?:{p})\b", re.I), soft, tuple(stems(p)) or ("",)) for k, t in enumerate(themes) for ps, soft in ((t.patterns, True), (t.fixed, False)) for p in ps]

    def hits(self, sentence: str) -> list[Hit]:
        """What stays of all matches: the longest first, then the leftmost, then in the lexicon's order, each takes its letters for its category. Neutral
        themes take none, and count once."""
        low = sentence.lower()
        found = [Hit(k, m.start(), m.end(), soft) for k, p, soft, texts in self.patterns if any(x in low for x in texts) for m in p.finditer(sentence)]
        taken: dict[str, int] = {}  # letters in use, as bits
        out, neutral = [], set()
        for h in sorted(found, key=lambda h: (h.start - h.end, h.start, h.theme, h.soft is False)):
            t = self.themes[h.theme]
            if t.polarity == "neutral":
                if h.theme not in neutral:
                    neutral.add(h.theme)
                    out.append(h)
                continue
            letters = (1 << h.end) - (1 << h.start)
            if not taken.get(t.category, 0) & letters:
                taken[t.category] = taken.get(t.category, 0) | letters
                out.append(h)
        return sorted(out, key=lambda h: (h.start, h.end, h.theme))

    def scan(self, sentence: str) -> list[tuple[Theme, Hit]]:
        """Themes that the sentence states: a negated one gives its opposite, or none if it has none."""
        hits = self.hits(sentence)
        if not hits:
            return []
        words = [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(sentence)]
        at, left, linked, side = 0, -1, -1, None  # next word; fillers, or connectors, that the scope still allows; polarity of the list
        negated: dict[Hit, bool] = {}
        for h in hits:
            while at < len(words) and words[at][1] < h.start:
                word = words[at][0]
                if word in NEGATORS or word.endswith("n't"):
                    phrase = " ".join(w for w, _, _ in words[at : at + 4]) + " "
                    left, linked = (-1 if phrase.startswith(tuple(f"{e} " for e in EXCEPTIONS)) else WINDOW), -1
                else:
                    left = left - 1 if left >= 0 and word in FILLERS else -1
                    linked = linked - 1 if linked >= 0 and word in CONNECTORS else -1
                at += 1
            polarity = self.themes[h.theme].polarity
            back = bool(_BACK.match(sentence[h.end : next((a for w, a, _ in words if a >= h.end and w in CLAUSE_ENDS), len(sentence))]))
            negated[h] = h.soft and (left >= 0 or back or linked >= 0 and polarity == side)
            if at < len(words) and words[at][1] < h.end:
                left = -1  # inside a negated list only connectors go on
                while at < len(words) and words[at][1] < h.end:
                    at += 1
            linked, side = (LIST_GAP if negated[h] else -1), polarity
        present = {self.themes[h.theme].theme for h in hits}
        out = []
        for h, no in negated.items():
            t = self.themes[h.theme]
            if not present.intersection(t.suppressed_by) and (not no or t.negated):
                out.append((self.themes[self.number[t.negated]] if no else t, h))
        return out
