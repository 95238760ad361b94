"""Which of many phrases a text contains, in one pass over the text.

Phrases, as UTF-8 bytes, are the ends of paths of an automaton in flat arrays: a
table of next states (states x symbols that occur in phrases), the phrase that
ends in a state, and the nearest state behind it (by failure links) in which
another one ends. It is built level by level over whole arrays and run over many
texts at a time, a byte of each a step. Long texts are cut into stretches that
overlap by as much as the longest phrase has, so that one of them doesn't hold up
the others. The time depends on the texts and on what is found, hardly on the
number of phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of one automaton's table, at most (one phrase may have more); bytes of a stretch; bytes of texts that are run together.
CELLS, STRETCH, TOGETHER = 1 << 24, 1 << 10, 1 << 22


class Automaton:
    """Of different phrases, none of them empty."""

    def __init__(self, phrases: list[bytes]) -> None:
        sizes = np.fromiter(map(len, phrases), np.int64, len(phrases))
        first = np.cumsum(sizes) - sizes
        raw = np.frombuffer(b"".join(phrases), np.uint8)
        self.symbol = np.zeros(256, np.int32)  # 0: in no phrase
        used = np.unique(raw)
        self.symbol[used] = np.arange(1, len(used) + 1)
        width, text = len(used) + 1, self.symbol[raw]
        self.longest = int(sizes.max(initial=0))
        # the tree of beginnings: of each level the states, what they follow and by which symbol
        state, levels, n = np.zeros(len(phrases), np.int64), [], 1
        for depth in range(self.longest):
            on = np.flatnonzero(sizes > depth)
            ways, own = np.unique(state[on] * width + text[first[on] + depth], return_inverse=True)
            state[on] = n + own
            levels.append((n + np.arange(len(ways)), ways // width, ways % width))
            n += len(ways)
        self.next = np.zeros((n, width), np.int32)
        self.phrase = np.full(n, -1, np.int64)
        self.phrase[state] = np.arange(len(phrases))
        self.other = np.zeros(n, np.int64)
        for states, before, symbol in levels:
            behind = self.next[before, symbol].astype(np.int64)  # what the state before it had there by failure
            self.other[states] = np.where(self.phrase[behind] >= 0, behind, self.other[behind])
            self.next[before, symbol] = states
            self.next[states] = self.next[behind]
        self.ends = (self.phrase >= 0) | (self.other > 0)

    def found(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places of texts and of phrases that they contain, each pair once, in order."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        symbols = self.symbol[np.frombuffer(b"".join(texts), np.uint8)]
        begin = np.cumsum(sizes) - sizes
        pieces = np.maximum(1, -(-(sizes - self.longest + 1) // STRETCH))
        text = np.repeat(np.arange(len(texts)), pieces)
        at = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * STRETCH
        size = np.minimum(sizes[text] - at, STRETCH + self.longest - 1)
        order = np.argsort(-size, kind="stable")
        text, start, size = text[order], (begin[text] + at)[order], size[order]
        going = len(size) - np.searchsorted(size[::-1], np.arange(int(size[0]) if len(size) else 0), "right")  # pieces that have a byte there
        state = np.zeros(len(size), np.int64)
        met = []
        for k, on in enumerate(going.tolist()):
            state[:on] = self.next[state[:on], symbols[start[:on] + k]]
            hit = np.flatnonzero(self.ends[state[:on]])
            met.append(text[hit] * len(self.phrase) + state[hit])
        met = np.unique(np.concatenate(met)) if met else np.empty(0, np.int64)
        out = []
        while len(met):
            text, state = np.divmod(met, len(self.phrase))
            there = self.phrase[state] >= 0
            out.append(text[there] * len(self.phrase) + self.phrase[state[there]])
            on = self.other[state] > 0
            met = np.unique(text[on] * len(self.phrase) + self.other[state[on]])
        pairs = np.unique(np.concatenate(out)) if out else np.empty(0, np.int64)
        return np.divmod(pairs, len(self.phrase))


def automata(phrases: list[bytes]) -> list[tuple[list[bytes], Automaton]]:
    """Different phrases, none empty, in order, and automata over runs of them whose tables keep to ``CELLS``."""
    out, own, size = [], [], 0
    width = len(set(b"".join(phrases))) + 1
    for p in sorted(set(phrases) - {b""}):
        if own and (size + len(p)) * width > CELLS:
            out.append((own, Automaton(own)))
            own, size = [], 0
        own.append(p)
        size += len(p)
    return [*out, (own, Automaton(own))] if own else out


_built: dict[int, tuple[list[bytes], list]] = {}


def _automata(shared) -> list[tuple[list[bytes], Automaton]]:
    """One set a worker process and dictionary, built when first needed."""
    phrases = shared.value
    if id(phrases) not in _built:
        _built.clear()
        _built[id(phrases)] = phrases, automata(phrases)
    return _built[id(phrases)][1]


def _stretches(column: pa.Array) -> Iterator[list[bytes]]:
    own: list[bytes] = []
    size = 0
    for x in column.cast(pa.large_binary()):
        text = x.as_py() or b""
        if own and size + len(text) > TOGETHER:
            yield own
            own, size = [], 0
        own.append(text)
        size += len(text)
    if own:
        yield own


def contained(phrases: DataFrame, phrase: str = "phrase"):
    """A column function of a text: the different phrases that it contains, as an array; an empty phrase is in every text, a null in none.

    The phrases are collected and broadcast: count them first.
    """
    known = [r["p"] for r in phrases.select(F.col(phrase).alias("p")).distinct().collect() if r["p"] is not None]
    shared, everywhere = phrases.sparkSession.sparkContext.broadcast([p.encode() for p in known]), [p for p in known if not p]

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        each: list[list[str]] = []
        for some in _stretches(texts):
            own = [list(everywhere) for _ in some]
            for names, automaton in _automata(shared):
                for i, k in zip(*(x.tolist() for x in automaton.found(some))):
                    own[i].append(names[k].decode())
            each += own
        return pa.array(each, pa.list_(pa.string()))

    return found


def contains_few(texts: DataFrame, phrases: DataFrame, text: str = "search_text", phrase: str = "phrase") -> DataFrame:
    """Inner join where the text contains the phrase, with a dictionary of a counted, small size: the rows that a join on ``contains`` gives.

    Null texts and phrases are in no row; rows that repeat on either side do so in the join.
    """
    has = contained(phrases, phrase)
    whole = lambda df: F.struct(*["`" + c.replace("`", "``") + "`" for c in df.columns])
    each = texts.where(F.col(text).isNotNull()).select(whole(texts).alias("_row"), F.explode(has(F.col(text))).alias("_phrase"))
    known = phrases.select(whole(phrases).alias("_entry"), F.col(phrase).alias("_key"))
    return each.join(F.broadcast(known), F.col("_phrase") == F.col("_key")).select("_row.*", "_entry.*")
