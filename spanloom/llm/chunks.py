"""Texts cut at white space into chunks, and each distinct chunk encoded once: what the two encoders share.

Splitting, making distinct and putting together are done on Arrow columns, for a group of texts at a time; an encoder
is asked only for chunks that it doesn't remember. Results don't depend on groups or on what is remembered.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker remembers from one group of texts, and task, to the next; those of a group may come on top.
MEMORY = 300_000
#: Characters of the texts whose chunks are made distinct and encoded together.
TOGETHER = 4_000_000
#: Case mappings of characters up to here are settled and don't look at their neighbours.
BEYOND = re.compile("[^\x00-\u024f]")
#: Of the others, U+0130 alone is not one letter in lower case.
UNSURE = "[^\x00-\u012f\u0131-\u024f]"
#: Splitting at white space also splits at these, which are none.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Marks that are taken off a word's end.
MARKS = ".,;:!?#$%&*)"


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of flat that begin at starts and have those sizes, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Chunks:
    """An encoder's memory of chunks. Subclasses say how a word is normalised and how new chunks are encoded.

    folds: upper and lower case are alike, but for what holds "<|". parts: a word and the marks behind it are encoded
    each by itself, so both are remembered by themselves.
    """

    def __init__(self, folds: bool, parts: bool):
        self.folds, self.parts = folds, parts
        self.forget()

    def normal(self, word: str) -> str:
        raise NotImplementedError

    def learn(self, keys: pa.Array, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of chunks, in their order; plain: which are words of letters."""
        raise NotImplementedError

    def forget(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _plain(self, words: pa.Array) -> pa.Array:
        """Which are letters alone and stay so in lower case."""
        out, unsure = pc.utf8_is_alpha(words), pc.match_substring_regex(words, UNSURE)
        if pc.any(unsure).as_py():  # İ is i and a mark in lower case
            sure = [w.isalpha() and self.normal(w).isalpha() for w in words.filter(unsure).to_pylist()]
            out = pc.replace_with_mask(out, unsure, pa.array(sure, pa.bool_()))
        return out

    def _known(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, sizes and ids of distinct keys; the new ones are learned."""
        at = pc.index_in(keys, value_set=self.words)
        if at.null_count:
            new = keys.filter(at.is_null())
            sizes, flat = self.learn(new, np.asarray(self._plain(new)) if self.parts else np.zeros(len(new), bool))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])
            self.words = pa.concat_arrays([self.words, new])
            at = pc.index_in(keys, value_set=self.words)
        at = np.asarray(at)
        starts, sizes, flat = self.starts[at], self.sizes[at], self.flat
        if len(self.words) > MEMORY or len(flat) > 16 * MEMORY:  # those of this group stay, if they aren't too long
            self.words, self.sizes, self.flat = keys, sizes, gather(flat, starts, sizes)
            self.starts = np.cumsum(sizes) - sizes
            if len(self.flat) > 16 * MEMORY:
                self.forget()
        return starts, sizes, flat

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, sizes and ids of distinct chunks."""
        if not self.parts:
            return self._known(chunks)
        words = pc.utf8_rtrim(chunks, MARKS)
        words = pc.if_else(self._plain(words), words, chunks)
        # what is behind the word, cut from the chunks' own bytes
        long, short = (np.asarray(pc.binary_length(a)) for a in (chunks, words))
        begins = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset : chunks.offset + len(chunks)]
        data = gather(np.frombuffer(chunks.buffers()[2] or b"", np.uint8), begins + short, long - short)
        ends = np.concatenate([[0], np.cumsum(long - short)]).astype(np.int64)
        tails = pa.LargeStringArray.from_buffers(len(chunks), pa.py_buffer(ends), pa.py_buffer(data))
        keys = pa.concat_arrays([words, tails]).dictionary_encode()
        starts, sizes, flat = self._known(keys.dictionary)
        both = np.asarray(keys.indices).reshape(2, -1).T.ravel()
        ids, sizes = gather(flat, starts[both], sizes[both]), sizes[both].reshape(-1, 2).sum(1)
        return np.cumsum(sizes) - sizes, sizes, ids

    def _group(self, texts: list[str], split: Callable) -> list[bytes]:
        if not texts:
            return []
        lists = split(pa.array(texts, pa.large_string()))
        keys = lists.values.dictionary_encode()
        starts, sizes, flat = self._chunks(keys.dictionary)
        at = np.asarray(keys.indices)
        sizes = sizes[at]
        ids = gather(flat, starts[at], sizes).tobytes()
        ends = 4 * np.concatenate([[0], np.cumsum(sizes)])[np.asarray(lists.offsets)]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def encode_many(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Each text's ids, in order."""
        group, odd, held = [], [], 0
        for t in texts:
            held += len(t)
            if self.folds and (t.isascii() or not BEYOND.search(t)) and "<|" not in t:
                t = t.lower()
            group.append(t)
            odd.append(bool(SEPARATORS.search(t)))
            if held > TOGETHER:
                yield from self._both(group, odd)
                group, odd, held = [], [], 0
        yield from self._both(group, odd)

    def _both(self, texts: list[str], odd: list[bool]) -> Iterator[bytes]:
        """Texts with separators are split at blanks alone."""
        plain = iter(self._group([t for t, o in zip(texts, odd) if not o], pc.utf8_split_whitespace))
        others = iter(self._group([t for t, o in zip(texts, odd) if o], lambda a: pc.split_pattern(a, " ")))
        return (next(others if o else plain) for o in odd)
