"""Token ids of whole texts by a public byte-level BPE tokenizer.

The tokenizers library does the encoding. Byte-level BPE splits a text into words before it merges, and a single space
belongs to the word after it, so a text whose white space is only single spaces and line feeds is encoded word by word:
Arrow splits a batch into words and lists the distinct ones, a worker remembers the ids of the words that it has met,
and numpy puts them together. Every other text goes to the library whole. Both ways give the same ids.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pagemill.llm.shared import kept

END_ID = 2
DEFAULT_TOKENIZER = "byte_bpe_50k.json"
#: Words that a worker remembers, the first that it meets. Memory only: the ids don't depend on it.
CACHED_WORDS = 600_000
RUN = 1 << 24  # bytes of texts whose words are looked up together
SLICE = 1 << 22  # bytes of texts that are held as ids at once
#: Texts that can't be taken word by word: other white space, runs of white space, text of a special token.
_ODD = (
    r"^[ \n]|[ \n]$|[ \n][ \n]|<\||[\t\x{b}\x{c}\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}"
    r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    """The place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Encodes batches of texts; the ids are those that the library gives for each whole text."""

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._limit = cached_words
        self._known: dict[str, int] = {"": 0}
        self._starts, self._lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self._pool, self._filled = np.zeros(1 << 18, np.uint32), 0
        (self._feed,) = self._whole("\n")
        self._opens = np.zeros(self._tokenizer.get_vocab_size() + 1, bool)
        self._opens[[n for token, n in self._tokenizer.get_vocab().items() if token[0] == "Ġ"]] = True
        self._opens[self._feed] = True

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, words: list[str]) -> None:
        """Encodes words joined to longer texts; each word's ids begin with the only one that opens with its space or line feed.

        The first of them are remembered as far as there is room; the ids of the others stay until the next words come.
        """
        n, room = len(self._known), self._limit - len(self._known)
        self._known.update(zip(words[:room], range(n, n + len(words)), strict=False))
        if n + len(words) > len(self._starts):
            self._starts, self._lengths = np.resize(self._starts, 2 * (n + len(words))), np.resize(self._lengths, 2 * (n + len(words)))
        for at in range(0, len(words), 256):
            part = words[at : at + 256]
            ids = self._whole("".join(w if w[0] == "\n" else " " + w for w in part))
            begin = np.flatnonzero(self._opens[ids])
            size = self._filled + len(ids)
            if size > len(self._pool):
                self._pool = np.resize(self._pool, 2 * size)
            self._pool[self._filled : size] = ids
            self._starts[n + at : n + at + len(part)] = begin + self._filled
            self._lengths[n + at : n + at + len(part)] = np.diff(np.append(begin, len(ids)))
            self._filled = size

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word of all texts, and where each text's begin (with the end at last)."""
        lines = pc.replace_substring(pc.binary_join_element_wise(pa.scalar("", texts.type), texts, pa.scalar("\n", texts.type)), "\n", " \n")
        split = pc.split_pattern(lines, " ")
        coded = split.flatten().dictionary_encode()
        words, indices = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
        known = np.fromiter(map(self._known.get, words, repeat(-1)), np.int32, len(words))
        if len(self._known) >= self._limit and np.count_nonzero(known[indices] < 0) > len(indices) // 4:
            self._known = {"": 0}  # texts of another kind than those remembered
            known = np.where(words == "", 0, -1).astype(np.int32)
        last = len(self._known) - 1
        self._filled = int(self._starts[last] + self._lengths[last])
        new = np.flatnonzero(known < 0)
        known[new] = np.arange(last + 1, last + 1 + len(new))
        self._learn(words[new].tolist())
        return known[indices], split.offsets.to_numpy() - split.offsets[0].as_py()

    def _by_words(self, word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self._lengths[word].astype(np.int64)
        ends = np.cumsum(lengths)
        at = np.repeat(self._starts[word] - (ends - lengths), lengths)
        at += np.arange(len(at))
        ids = self._pool[at]
        bounds = np.append(0, ends)[offsets]
        kept = np.ones(len(ids), bool)
        kept[bounds[:-1]] = False  # the line feed that was put before each text
        return ids[kept], bounds - np.arange(len(bounds))

    def parts(self, texts: pa.Array, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each run of about `most` bytes: (its first text, all ids in a row, where each text's begin, with the end at last).

        Each distinct word of all texts is looked up once. A null text has no ids. Take all parts before other texts.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        word, offsets = self._words(texts.filter(pa.array(~odd)) if odd.any() else texts)
        before = np.append(0, np.cumsum(~odd))
        for begin, end in slices(texts, most):
            here = offsets[before[begin] : before[end] + 1]
            ids, bounds = self._by_words(word[here[0] : here[-1]], here - here[0])
            if odd[begin:end].any():
                parts = iter(np.split(ids, bounds[1:-1]))
                mixed = [self._whole(texts[k].as_py()) if odd[k] else next(parts) for k in range(begin, end)]
                ids, bounds = np.concatenate(mixed), np.append(0, np.cumsum([len(x) for x in mixed]))
            yield begin, ids, bounds

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin (with the end at last). A null text has none."""
        if not len(texts):
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        _, ids, bounds = next(self.parts(texts, 1 << 62))
        return ids, bounds


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a tokenizer file."""
    return kept(f"encoder {path}", lambda: WordEncoder(path))


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of texts with about `most` bytes together, so that a long batch isn't held as ids at once."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + most, "right")))
        yield begin, end
        begin = end


def encoded(texts: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each slice of a batch: (index of its first text, ids, bounds), each text closed by END_ID."""
    for first, last in slices(texts, RUN):
        for begin, ids, bounds in encoder(path).parts(texts[first:last], SLICE):
            yield first + begin, np.insert(ids, bounds[1:], END_ID), bounds + np.arange(len(bounds))
    pa.default_memory_pool().release_unused()
