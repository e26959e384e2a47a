"""What a Python worker remembers between rows, bounded in bytes."""

from __future__ import annotations

from collections.abc import Iterable

# What a dictionary entry costs beside its key's and its value's characters.
ENTRY = 250


class Memory:
    """Values by word, in two generations of at most `most` / 2 bytes each.

    When the younger one is full it becomes the older one, and what the older one held and nobody
    asked for since is forgotten. So a worker keeps what it meets often, however many different
    words pass by, and a single batch of words may exceed the bound only by its own size.
    """

    def __init__(self, most: int):
        self.most = most // 2
        self.now: dict[str, object] = {}
        self.before: dict[str, object] = {}
        self.used = 0

    def missing(self, words: Iterable[str]) -> list[str]:
        """Which of these words are to be unknown; all others are in `now` from here on."""
        asked = set(words)
        if self.used > self.most:
            self.before, self.now, self.used = self.now, {}, 0
        new = asked.difference(self.now)
        unknown = []
        kept = []
        for word in new:
            (kept if word in self.before else unknown).append(word)
        if kept:
            self.put(kept, [self.before[word] for word in kept])
        return unknown

    def put(self, words: list[str], values: Iterable[object], size: int = 0) -> None:
        """Remember these; `size` is what the values take beyond what the words do."""
        self.now.update(zip(words, values))
        self.used += ENTRY * len(words) + 2 * sum(map(len, words)) + size
