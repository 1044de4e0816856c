"""Byte-level BPE of many texts at a time, where each distinct word is merged once.

The vocabulary parts a text before it merges, and a single space between visible characters always begins a part.
So the ids of such a text are those of its words in a row. Texts whose spaces touch other white space go to the library whole.
"""

from __future__ import annotations

import json
import os
from array import array
from itertools import chain

import numpy as np

from quarterdeck.llm.common import worker_store

#: Words of one call of a tokenizer.
AT_ONCE = 4096


def _byte_alphabet() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: visible ones as they are, the others from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(others)}


def flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter(chain.from_iterable(rows), np.int64, int(sizes.sum())), sizes


class Numbers(dict):
    """Words numbered in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = len(self)
        return self[word]


def plain_word(word: str) -> bool:
    """Whether the spaces around a word touch no other white space."""
    return bool(word) and not word[0].isspace() and not word[-1].isspace()


#: How byte-level BPE parts a text before it merges (fixed value).
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevel:
    """A byte-level vocabulary of the tokenizers library. With ``specials`` its special tokens are found in texts, else they are plain text."""

    def __init__(self, path: str, specials: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not specials
        alphabet, vocabulary = _byte_alphabet(), self.library.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, ident in vocabulary.items():
            self.bytes[ident] = bytes(map(alphabet.__getitem__, token)) if set(token) <= alphabet.keys() else token.encode()
        self.opens = np.array([b[:1] == b" " for b in self.bytes])
        # a vocabulary in the order of its merges is its own list of ranks; without the offsets of the other library it is much faster
        added = {t.content for t in self.library.get_added_tokens_decoder().values()}
        self.specials = sorted(added) if specials else []
        merges = json.loads(self.library.to_str())["model"]["merges"]
        made = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
        ranks = {self.bytes[i]: i for t, i in vocabulary.items() if t not in added}
        ordered = sorted(made, key=vocabulary.__getitem__) == made and len(ranks) == len(made) + 256
        self.ranked = tiktoken.Encoding("a", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if ordered else None

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, each with the space before it, and their counts: a token that begins with the space begins a word."""
        text = " " + " ".join(words)
        if self.ranked and not any(s in text for s in self.specials):
            ids = np.array(self.ranked(text), np.int64)
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(words):
                return ids, np.diff(starts, append=len(ids))
        return flat([self.whole(" " + w) for w in words])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The library's ids of whole texts, as little-endian unsigned 32-bit integers.

        Each distinct word of the texts is merged once. What is held is bounded by the texts of the call,
        and nothing is kept for the next one.
        """
        numbers, rows = Numbers(), []
        for text in texts:
            first, *rest = text.split(" ")
            rows.append((first, list(map(numbers.__getitem__, rest))))
        words = list(numbers)
        plain = list(map(plain_word, words))
        ids, known = [b""] * len(words), [i for i, p in enumerate(plain) if p]
        for i in range(0, len(known), AT_ONCE):
            part = known[i:i + AT_ONCE]
            found, counts = self.words([words[k] for k in part])
            data, ends = found.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
            for k, s, e in zip(part, [0, *ends], ends, strict=False):
                ids[k] = data[s:e]
        out = []
        for text, (first, rest) in zip(texts, rows, strict=True):
            if rest and first and not first[-1].isspace() and all(map(plain.__getitem__, rest)):
                out.append(array("I", self.whole(first)).tobytes() + b"".join(map(ids.__getitem__, rest)))
            else:
                out.append(array("I", self.whole(text)).tobytes() if text else b"")
        return out


def byte_level(path: str) -> ByteLevel:
    return worker_store(("byte level", path), lambda: ByteLevel(path))
