"""Search queries: phrases in double quotes and single terms."""

from __future__ import annotations

import re
from dataclasses import dataclass

_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Query:
    text: str
    phrases: tuple[str, ...]
    terms: tuple[str, ...]

    @property
    def tokens(self) -> tuple[str, ...]:
        """Words of phrases and terms in order, once each; the whole text if there is none."""
        words = [w for p in self.phrases for w in words_of(p)] + list(self.terms)
        return tuple(dict.fromkeys(words)) or ((self.text,) if self.text else ())

    @property
    def searchable(self) -> bool:
        """Whether there is a word to rank by; a query of punctuation has none."""
        return any(words_of(t) for t in self.tokens)

    @property
    def phrase_words(self) -> tuple[tuple[str, ...], ...]:
        return tuple(tuple(words_of(p)) for p in self.phrases if words_of(p))


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def parse_query(text: str) -> Query:
    """Splits a query; what follows a quote that is never closed counts as terms."""
    phrases, terms = [], []
    pieces = text.split('"')
    for i, piece in enumerate(pieces):
        quoted = i % 2 == 1 and i < len(pieces) - 1
        if quoted and piece.strip():
            phrases.append(piece.strip().lower())
        elif not quoted:
            terms += words_of(piece)
    return Query(text.strip().lower(), tuple(phrases), tuple(terms))
