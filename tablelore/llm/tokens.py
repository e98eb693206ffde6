"""Token ids of a word-level byte-pair tokenizer, and greedy word-piece counts."""

from __future__ import annotations

import re
import struct
from collections import deque
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

#: Words that a task remembers in each of two generations, unless a kind of memory says less.
MEMORY_WORDS = 400_000
#: Longer words are never remembered.
MEMORY_CHARS = 64

#: Letters whose lower case and composition do not depend on their neighbours, then marks.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
_LATIN = "[a-zß-öø-ÿ]+"
#: Marks that touch, and control characters: there a mark is not a stretch of its own.
_UNSAFE = re.compile(r"[^\w\s][^\w\s]|_|[\x00-\x08\x0b-\x1f\x7f-\xa0]")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves, the other bytes for the letters
    from U+0100 on, in order.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memory(dict):
    """A dictionary of bounded size that computes what is missing.

    When it is full it becomes the older generation, whose entries are taken over when
    they are asked for again; so frequent words stay and rare ones go.
    """

    def __init__(self, words: int | None = None):
        super().__init__()
        self._words = words or MEMORY_WORDS
        self._older: dict = {}

    def _compute(self, word):
        raise NotImplementedError

    def __missing__(self, word):
        value = self._older.get(word)
        if value is None:
            value = self._compute(word)
        if len(word) <= MEMORY_CHARS:
            if len(self) >= self._words:
                self._older = dict(self)
                self.clear()
            self[word] = value
        return value


@lru_cache(maxsize=4)
def tokenizer_of(tokenizer_json: str):
    """The tokenizer of a vocabulary file's text, one per process.

    A tokenizer that has been used leaves some megabytes in its process when it is dropped
    (measured with tokenizers 0.23). Spark's workers run many tasks, so one tokenizer per
    task would add up.
    """
    from tokenizers import Tokenizer

    return Tokenizer.from_str(tokenizer_json)


class WordIds(Memory):
    """Little-endian 32-bit ids of a stretch of text without blanks, remembered by stretch.

    White space is no part of any token of such a tokenizer, so a text's ids are those of
    its stretches in a row. Plain Latin words go straight to the merge table; everything
    else through the whole tokenizer.
    """

    def __init__(self, tokenizer_json: str):
        super().__init__()
        self._tokenizer = tokenizer_of(tokenizer_json)
        self._letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self._bare = re.compile(_LATIN).fullmatch
        self._joins = self._keeps_words_whole()

    def _whole(self, text: str) -> bytes:
        ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _merged(self, word: str) -> bytes:
        found = self._tokenizer.model.tokenize(
            word.encode().decode("latin-1").translate(self._letters))
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def _keeps_words_whole(self) -> bool:
        """Whether the short way agrees with the whole tokenizer on words and marks."""
        probes = ("word", "été", "über", "a", "niño", "straße", "Zwölf", "zz")
        return (all(self._merged(p.lower()) == self._whole(p) for p in probes)
                and all(self._whole(p + m) == self._whole(p) + self._whole(m)
                        for p in probes for m in (".", ",", "!!", "***", "?\"")))

    def _compute(self, stretch: str) -> bytes:
        if not stretch:
            return b""
        if self._joins:
            if self._bare(stretch):
                return self._merged(stretch)
            if plain := _PLAIN.fullmatch(stretch):
                word, marks = plain.groups()
                return self[word.lower()] + (self[marks] if marks else b"")
        return self._whole(stretch)

    def of(self, text: str) -> bytes:
        if self._joins and not _UNSAFE.search(text):
            try:
                text.encode("latin-1")
                text = text.lower().replace(". ", " . ").replace(", ", " , ")
            except UnicodeEncodeError:
                pass  # letters whose lower case may depend on their neighbours
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


class WordPieces:
    """Greedy longest-match piece counts of words, without building the pieces.

    The vocabulary is a trie of bytes. Where a word leaves the trie, the failure link of
    a node leads to what is left after the longest pieces in it are taken, and the node
    holds how many those are. So a word is read once from left to right.
    """

    def __init__(self, vocabulary: Iterable[bytes]):
        step: dict[int, int] = {}
        whole = [False]
        for token in vocabulary:
            node = 0
            for byte in token:
                key = node << 8 | byte
                after = step.get(key)
                if after is None:
                    after = step[key] = len(whole)
                    whole.append(False)
                node = after
            whole[node] = bool(token)
        fail, pops = [-1] * len(whole), [0] * len(whole)
        children: list[list[tuple[int, int]]] = [[] for _ in whole]
        for key, node in step.items():
            children[key >> 8].append((key & 255, node))
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, node in children[parent]:
                if whole[node]:
                    fail[node], pops[node] = 0, 1
                else:
                    count, back = pops[parent], fail[parent]
                    while back >= 0 and back << 8 | byte not in step:
                        count += pops[back]
                        back = fail[back]
                    if back >= 0:
                        fail[node], pops[node] = step[back << 8 | byte], count
                queue.append(node)
        self._step, self._fail, self._pops = step, fail, pops

    def count(self, word: bytes) -> int:
        """Pieces of a word; 0 if it cannot be cut into pieces of the vocabulary."""
        step, fail, pops = self._step, self._fail, self._pops
        node = total = 0
        for byte in word:
            after = step.get(node << 8 | byte)
            while after is None:
                if fail[node] < 0:
                    return 0
                total += pops[node]
                node = fail[node]
                after = step.get(node << 8 | byte)
            node = after
        while node:
            if fail[node] < 0:
                return 0
            total += pops[node]
            node = fail[node]
        return total


class PieceCounts(Memory):
    """Piece counts of words, remembered by word."""

    def __init__(self, vocabulary: Iterable[bytes], lead: bytes = b" "):
        super().__init__()
        self._pieces, self._lead = WordPieces(vocabulary), lead

    def _compute(self, word: bytes) -> int:
        return self._pieces.count(self._lead + word)
