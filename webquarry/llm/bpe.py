"""Byte-pair merging with a heap over a linked list, and the text handling of the JSON tokenizer files."""

from __future__ import annotations

import json
import unicodedata
from heapq import heapify, heappop, heappush

import regex

#: Characters of the White_Space property (fixed values).
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: str.split() also splits at these four, which are no white space for the tokenizer.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
_SPLIT = regex.compile(f"[{WHITE_SPACE}]+")
#: Contractions, letter runs, single digits, runs of anything else.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+", regex.V0)


def chunks(text: str) -> list[str]:
    """The parts of a text between white space.  No token reaches across two of them."""
    if any(c in text for c in _SEPARATORS):
        return [x for x in _SPLIT.split(text) if x]
    return text.split()


def split_plain(part: str) -> list[str]:
    """A lower-case part without white space, split as the tokenizer's pattern does."""
    return [part] if part.isalpha() else _PIECES.findall(part)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(extra)) for b in range(256)]


def lower(text: str) -> str:
    """Lower-case each character by itself, so that a final sigma is not special."""
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


class MergeCounter:
    """Counts the tokens of a text for a BPE file with an end-of-word suffix; makes no token ids.

    ``cache_size`` bounds the memory of the worker: the counts of that many parts of texts are remembered.
    """

    def __init__(self, path: str, cache_size: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or model["dropout"]:
            raise ValueError(f"{path}: a BPE model with an end-of-word suffix is needed")
        self.suffix = model["end_of_word_suffix"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.symbols = byte_symbols()
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.special_texts = special
        self.cache_size = cache_size
        self.known: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def merges(self, word: str) -> tuple[int, int]:
        """Initial symbols of a word and the merges made on them.

        The heap holds (rank, position) of adjacent pairs; a linked list over positions holds the symbols.
        The lowest rank is merged first, the leftmost one of equals; pairs that changed meanwhile are skipped.
        """
        symbols = [self.symbols[b] for b in word.encode("utf-8")]
        n = len(symbols)
        if not n:
            return 0, 0
        symbols[-1] += self.suffix
        ranks = self.ranks
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapify(heap)
        done = 0
        while heap:
            rank, i = heappop(heap)
            left = symbols[i]
            j = after[i]
            if left is None or j >= n or ranks.get((left, symbols[j])) != rank:
                continue
            symbols[i] = left = left + symbols[j]
            symbols[j] = None
            after[i] = k = after[j]
            done += 1
            if k < n:
                before[k] = i
                if (r := ranks.get((left, symbols[k]))) is not None:
                    heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], left))) is not None:
                heappush(heap, (r, h))
        return n, done

    def _of_word(self, word: str) -> int:
        count = self.words.get(word)
        if count is None:
            symbols, merges = self.merges(word)
            count = symbols - merges
            if len(word) <= 64:
                if len(self.words) >= self.cache_size:
                    self.words.clear()
                self.words[word] = count
        return count

    def _of_plain(self, part: str) -> int:
        part = lower(unicodedata.normalize("NFC", part) if not part.isascii() else part)
        if part.isascii() and part.isalpha():
            return self._of_word(part)
        return sum(map(self._of_word, _PIECES.findall(part)))

    def of_chunk(self, chunk: str) -> int:
        """Tokens of a part without white space; a special string inside it is one token."""
        if self.special is None or "<" not in chunk and not any(s in chunk for s in self.special_texts):
            return self._of_plain(chunk)
        parts = self.special.split(chunk)
        return sum(1 if i % 2 else self._of_plain(x) for i, x in enumerate(parts) if x)

    def __call__(self, text: str) -> int:
        known, total = self.known, 0
        parts = chunks(text)
        try:
            return sum([known[c] for c in parts])
        except KeyError:
            pass
        for c in parts:
            count = known.get(c)
            if count is None:
                count = self.of_chunk(c)
                if len(c) <= 64:
                    if len(known) >= self.cache_size:
                        known.clear()
                    known[c] = count
            total += count
        return total


_counters: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """The counter of this worker for a file."""
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]
