"""Bounded memory of what words were encoded to, kept by a Python worker over its tasks."""

from __future__ import annotations

from collections.abc import Callable

#: Entries of one generation; the one before is kept too.
ENTRIES = 350_000
#: Longer words are encoded anew each time.
LONGEST = 48


class WordMemory(dict):
    """Maps words to packed ids; what is missing comes from ``encode``.

    When a generation is full a new one begins, and words in use come over from the one before, so that memory stays bounded and common words are never encoded anew.
    """

    def __init__(self, encode: Callable[[bytes], bytes], entries: int = ENTRIES):
        super().__init__()
        self.encode, self.entries, self.before = encode, entries, {}

    def __missing__(self, word: bytes) -> bytes:
        found = self.before.get(word)
        if found is None:
            found = self.encode(word)
        if len(word) <= LONGEST:
            self.put(word, found)
        return found

    def put(self, word: bytes, packed: bytes) -> None:
        if len(self) >= self.entries:
            self.before = dict(self)
            self.clear()
        self[word] = packed

    def learn(self, words: set[bytes], encode_all: Callable[[list[bytes]], list[bytes]]) -> None:
        """Encode in one go those of ``words`` that are not known, and bring over those of the generation before. All of ``words`` then stay known until ``turn``."""
        new = [w for w in words if w not in self]
        if self.before:
            before = self.before
            self.update((w, before[w]) for w in new if w in before)
            new = [w for w in new if w not in before]
        self.update(zip(new, encode_all(new), strict=True))

    def turn(self) -> None:
        """Begin a new generation if this one is full."""
        if len(self) >= self.entries:
            self.before = {w: x for w, x in self.items() if len(w) <= LONGEST}
            self.clear()
