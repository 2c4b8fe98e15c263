"""Small helpers that the Python-side operators share: bounded memo tables and reading texts batch by batch."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401


class Memo(dict):
    """word -> row number; new words are listed in ``new`` until their rows have been computed.

    A worker keeps its memo between tasks. ``tidy`` empties it, between batches, once it has ``most`` words or its words
    have ``most_bytes``; a batch adds the words of one slice of texts at most, so memory is bounded while results stay
    the same.
    """

    def __init__(self, most: int = 250_000, most_bytes: int = 16 << 20):
        super().__init__()
        self.most, self.most_bytes, self.bytes, self.new = most, most_bytes, 0, []

    def __missing__(self, word):
        self[word] = n = len(self)
        self.bytes += len(word)
        self.new.append(word)
        return n

    def numbers(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def tidy(self) -> None:
        if len(self) > self.most or self.bytes > self.most_bytes:
            self.clear()
            self.bytes = 0


class Kept(dict):
    """What short keys became: at most ``most`` of them and ``most_bytes`` of keys and values. Long keys are not kept."""

    LONGEST = 64

    def __init__(self, most: int, most_bytes: int):
        super().__init__()
        self.most, self.most_bytes, self.bytes = most, most_bytes, 0

    @contextlib.contextmanager
    def including(self, new: dict):
        """All of ``new`` for a while; afterwards only its short keys."""
        self.update(new)
        try:
            yield
        finally:
            for key, value in new.items():
                if len(key) > self.LONGEST:
                    del self[key]
                else:
                    self.bytes += len(key) + len(value)

    def tidy(self) -> None:
        if len(self) > self.most or self.bytes > self.most_bytes:
            self.clear()
            self.bytes = 0


def text_slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Each batch cut into slices of about ``most_bytes`` of text, one row at least: what bounds working memory."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        length = column.cast(pa.large_string()).cast(pa.large_binary())
        sizes = np.asarray(pa.compute.binary_length(length).fill_null(0))
        group = np.cumsum(sizes) // most_bytes
        starts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [n]])
        for a, b in zip(starts[:-1], starts[1:]):
            yield batch.slice(int(a), int(b - a))


def per_worker(make: Callable, *key, _made: dict = {}):  # noqa: B006  the default is the worker's own table
    """``make(*key)``, made once in each Python worker and kept between its tasks, until it makes something else.

    So a worker that serves one stage after the other holds the tables of one operator at a time.
    """
    if (make, key) not in _made:
        _made.clear()
        _made[make, key] = make(*key)
    return _made[make, key]
