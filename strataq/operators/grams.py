"""Runs of neighbouring tokens, counted in whole arrays inside a task.

Spark cuts the texts into tokens; here some rows at a time become numbers, a run of
n tokens is its beginning (a run of n - 1) and one token more, and equal numbers are
counted. Strings are built once for each different run of what is held together, so
that nothing has to be shuffled to count within a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: Tokens that are counted together (a row may have more).
TOGETHER = 1 << 17


class Runs:
    """Tokens in order; unit: what is counted apart; ends: the place behind the last token of the line each token is in."""

    def __init__(self, tokens: pa.Array, unit: np.ndarray, ends: np.ndarray) -> None:
        own = tokens.dictionary_encode()
        self.words, self.code = own.dictionary, own.indices.to_numpy().astype(np.int64)
        self.left = ends - np.arange(len(self.code))
        self.before = np.unique(unit * max(1, len(self.words)) + self.code, return_inverse=True)[1]
        self.n = 1

    def some(self, at: np.ndarray, key: np.ndarray, extra: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first place, count and number of each of equal keys."""
        _, first, number = np.unique(key, return_index=True, return_inverse=True)
        return at[first], np.bincount(number, None if extra is None else 1 + extra, len(first)).astype(np.int64), number

    def longer(self, extra: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First places and counts of the runs that are one token longer; extra: what a place counts more."""
        self.n += 1
        at = np.flatnonzero(self.left >= self.n)
        first, count, number = self.some(at, self.key(at, self.n), None if extra is None else extra[at])
        self.before = np.zeros(len(self.code), np.int64)
        self.before[at] = number
        return first, count

    def key(self, at: np.ndarray, n: int) -> np.ndarray:
        return self.before[at] * len(self.words) + self.code[at + n - 1]

    def joined(self, words: pa.Array, at: np.ndarray, n: int) -> pa.Array:
        each = [words.take(pa.array(self.code[at + k])) for k in range(n)]
        return pc.binary_join_element_wise(*each, " ") if n > 1 else each[0]


def _parts(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows first to last (not included) of at most ``TOGETHER`` tokens, or one."""
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + TOGETHER, "right")) - 1)
        yield i, j
        i = j


def frequencies(tokens: DataFrame, most: int) -> DataFrame:
    """Phrase, n of the column tokens: runs of 1 to ``most`` within a row, counted over some rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(0)
            flat, offsets = column.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]).astype(np.int64)
            for i, j in _parts(offsets):
                low, high = int(offsets[i]), int(offsets[j])
                ends = np.repeat(offsets[i + 1 : j + 1] - low, np.diff(offsets[i : j + 1]))
                own = Runs(flat.slice(low, high - low), np.zeros(high - low, np.int64), ends)
                first, count, _ = own.some(np.arange(high - low), own.code)
                while True:
                    yield pa.RecordBatch.from_arrays([own.joined(own.words, first, own.n), pa.array(count)], ["Phrase", "n"])
                    if own.n == most:
                        break
                    first, count = own.longer()

    return tokens.select("tokens").mapInArrow(run, "Phrase string, n long")


def _core(own: Runs, start: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """n, first places and counts: runs of 2 to 4 tokens, and once more each line of 2 to 6."""
    whole = lambda n: start & (own.left == n)
    for n in (2, 3, 4):
        yield (n, *own.longer(whole(n)))
    for n in (5, 6):
        at = np.flatnonzero(whole(n))
        key = own.key(at, 5)
        if n == 6:
            key = np.unique(key, return_inverse=True)[1] * len(own.words) + own.code[at + 5]
        yield (n, *own.some(at, key)[:2])


def core_phrases(rows: DataFrame, keys: tuple[str, ...], lines: bool) -> DataFrame:
    """keys, phrase, normalized_phrase, occurrence_count, line of rows with keys, tokens (a list a line) and, if asked for, lines; a row's phrases are counted in the row."""
    stop, numeric = set(tx.PHRASE_STOP_WORDS), set("0123456789 \t\n\x0b\f\r./x+-")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(len(keys))
            each, a_row = column.flatten(), pc.list_value_length(column).to_numpy(zero_copy_only=False)
            flat, a_line = each.flatten(), pc.list_value_length(each).to_numpy(zero_copy_only=False)
            row_lines = np.concatenate([[0], np.cumsum(a_row)]).astype(np.int64)
            line_tokens = np.concatenate([[0], np.cumsum(a_line)]).astype(np.int64)
            row_of_line, texts = np.repeat(np.arange(len(a_row)), a_row), b.column(len(keys) + 1).flatten() if lines else None
            for i, j in _parts(line_tokens[row_lines]):
                first_line, last_line = int(row_lines[i]), int(row_lines[j])
                low, high = int(line_tokens[first_line]), int(line_tokens[last_line])
                if low == high:
                    continue
                line = np.repeat(np.arange(first_line, last_line), a_line[first_line:last_line])
                own = Runs(flat.slice(low, high - low), row_of_line[line] - i, line_tokens[line + 1] - low)
                start = line_tokens[line] - low == np.arange(high - low)
                words = own.words.to_pylist()
                folds = [tx.folded(w) for w in words]
                same = folds == words
                folded = own.words if same else pa.array(folds, pa.string())
                ending, size = np.array([w in stop for w in words]), np.array([len(f) for f in folds])
                number = np.array([numeric.issuperset(f) for f in folds])
                pieces = []
                for n, at, count in _core(own, start):
                    code = [own.code[at + k] for k in range(n)]
                    good = ~ending[code[0]] & ~ending[code[-1]] & (sum(size[c] for c in code) + n - 1 >= 4) & ~np.logical_and.reduce([number[c] for c in code])
                    at, count = at[good], count[good]
                    phrase = own.joined(own.words, at, n)
                    pieces.append(pa.table([pa.array(at), phrase, phrase if same else own.joined(folded, at, n), pa.array(count)], ["at", "phrase", "folded", "count"]))
                # by place, the longest first: what is written (or shuffled) then has its words just before it, and is compressed to two thirds
                found = pa.concat_tables(pieces[::-1]).combine_chunks()
                order = np.argsort(found["at"].to_numpy(), kind="stable")
                for k in range(0, len(order), TOGETHER):
                    for part in found.take(pa.array(order[k : k + TOGETHER])).to_batches():
                        own_line = line[part["at"].to_numpy()]
                        row = pa.array(row_of_line[own_line])
                        out = [b.column(c).take(row) for c in range(len(keys))] + part.columns[1:]
                        yield pa.RecordBatch.from_arrays([*out, texts.take(pa.array(own_line))] if lines else out, names)

    names = [*keys, "phrase", "normalized_phrase", "occurrence_count", *["line"] * lines]
    types = {"phrase": "string", "normalized_phrase": "string", "occurrence_count": "long", "line": "string"}
    own = rows.select(*keys, "tokens", *["lines"] * lines)
    return own.mapInArrow(run, ", ".join(f"`{c}` {types.get(c) if i >= len(keys) else rows.schema[c].dataType.simpleString()}" for i, c in enumerate(names)))
