"""Whole-text encoding with the tokenizers library, where a word is merged once.

The vocabulary used here cuts a text at white space before any merge, so
the ids of a text are the ids of its words in a row.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable

from quarterdeck.llm.common import worker_store

#: Words that a worker keeps. A full store starts anew when ten times as many words were missing.
KEPT = 500_000
MARKS = ".,;:!?"


class _Words(dict):
    """word -> its ids as unsigned 32-bit integers, little-endian as all machines here are.

    A word of Latin letters and one mark is the letters' ids and the mark's, as both vocabularies cut
    between the two; ``fold`` may map the letters to others with the same ids.
    """

    def __init__(self, encode: Callable[[str], bytes], marks: dict[str, bytes], fold: Callable[[str], str] | None = None):
        super().__init__()
        self.encode, self.marks, self.fold, self.missing = encode, marks, fold, 0

    def __missing__(self, word: str) -> bytes:
        ids = self._merge(word)
        self.missing += 1
        if self.missing > 10 * KEPT:
            self.clear()
            self.missing = 0
        if len(self) < KEPT:
            self[word] = ids
        return ids

    def _merge(self, word: str) -> bytes:
        mark = self.marks.get(word[-1:])
        letters = word if mark is None else word[:-1]
        if letters.isalpha() and max(letters) < "Ā":
            if mark is not None:
                return self[letters] + mark
            if self.fold and (folded := self.fold(word)) != word:
                return self[folded]
        return self.encode(word)


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        # the vocabularies' letter for a space
        self.spaces = {"": "", " ": "Ġ"}
        self.marks = {m: self.whole(m) for m in MARKS}

    def whole(self, text: str) -> bytes:
        """The library's ids of a text."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str, space: str = "") -> bytes:
        """The ids of a word, ``space`` in front. ASCII letters are one word to the vocabulary and go straight to its merges."""
        if word.isascii() and word.isalpha():
            return array("I", [t.id for t in self.merges(self.spaces[space] + word)]).tobytes()
        return self.whole(space + word)

    def encode(self, text: str) -> bytes:
        raise NotImplementedError


class SpaceDroppingEncoder(WordEncoder):
    """BPE with word ends on lower-cased text, where white space only separates: spaces and line ends may be cut anywhere."""

    def __init__(self, path: str):
        super().__init__(path)
        self.words = _Words(self.word, self.marks, str.lower)

    def word(self, word: str, space: str = "") -> bytes:
        return super().word(word) if word.islower() else self.whole(word)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


def space_dropping(path: str) -> SpaceDroppingEncoder:
    return worker_store(("space dropping", path), lambda: SpaceDroppingEncoder(path))
