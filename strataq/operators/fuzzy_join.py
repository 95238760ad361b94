"""Similarity join of texts with a dictionary: exact, without scoring all pairs.

Dictionary blocks meet slices of the queries (fragment and replicate): a task has
one block, as an inverted index of tokens and bigrams, and a stream of queries.
What a query shares with each text of the block is counted by its posting lists.
Three bounds, each implied by a score of the asked height, then leave few texts
that are scored:

* bigrams. Texts (with a space at both ends) of m and n characters whose longest
  common subsequence has L share at least L + 1 - (m + n - 2 L) bigrams, as each
  character left out parts at most one pair of neighbours of the subsequence. An
  indel similarity 2 L / (m + n) of t so needs (m + n)(1.5 t - 1) + 1 of them. A
  token gives the same bigrams wherever it stands, so sorted tokens need no others.
* tokens. Of texts that share tokens the part made of these is known exactly.
* characters. L is at most the number of characters (in any order) both have.

Cases: nulls are empty texts; equal texts are scored once; a text of any length
and characters will do; with a low least score the bounds let all pairs through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import SCORERS

#: Dictionary texts that a task has at once, about; kinds that characters are counted by.
BLOCK, KINDS = 20_000, 64
_SLACK = 1e-9


def bigrams(text: str) -> list:
    """Neighbouring characters of a text between two spaces; the second and later ones of a kind carry their number."""
    spaced = " " + "".join(" " if c.isspace() else c for c in text) + " "
    seen: dict[str, int] = {}
    out: list = []
    for i in range(len(spaced) - 1):
        g = spaced[i : i + 2]
        seen[g] = k = seen.get(g, -1) + 1
        out.append((g, k) if k else g)
    return out


def characters(text: str) -> np.ndarray:
    """How many characters of each kind a text has (all white space is one kind)."""
    return np.bincount([32 if c.isspace() else ord(c) % KINDS for c in text], minlength=KINDS)


class Index:
    """Posting lists of the tokens and bigrams of a block of texts, and their lengths and characters."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        tokens: dict[str, list[int]] = {}
        grams: dict = {}
        unique = []
        for i, text in enumerate(texts):
            own = set(text.split())
            unique.append(sum(map(len, own)) + max(0, len(own) - 1))
            for token in own:
                tokens.setdefault(token, []).append(i)
            for g in bigrams(text):
                grams.setdefault(g, []).append(i)
        self.tokens, self.grams = ({k: np.array(v, np.int32) for k, v in x.items()} for x in (tokens, grams))
        self.length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.unique = np.array(unique, np.int64)  # characters of the different tokens, with spaces between
        self.characters = np.array([characters(t) for t in texts], np.int32).reshape(-1, KINDS)

    def candidates(self, query: str, scorer: str, least: float) -> np.ndarray:
        """Places of the texts that could reach ``least`` percent, a superset of those that do."""
        n, t = len(self.texts), least / 100 - _SLACK
        own = set(query.split())
        core = np.zeros(n, np.int64)  # characters of the shared tokens, with spaces between
        for token in own:
            if token in self.tokens:
                core[self.tokens[token]] += len(token) + 1
        has = core > 0
        core -= has
        lists = [self.grams[g] for g in bigrams(query) if g in self.grams]
        shared = np.bincount(np.concatenate(lists), minlength=n) if lists else np.zeros(n, np.int64)
        m, u = len(query), sum(map(len, own)) + max(0, len(own) - 1)
        both, sets = m + self.length, u + self.unique
        short = np.minimum(m, self.length)
        enough = lambda size, x: shared >= size * (1.5 * x - 1) + 1 - _SLACK
        alike = lambda at, common, size, x: 2 * common >= x * size[at] - _SLACK
        same = lambda at: np.minimum(characters(query), self.characters[at]).sum(1)

        def of_sets(at: np.ndarray, common: np.ndarray, x: float) -> np.ndarray:
            """Token sets could be that similar: what is shared is a beginning of both, what else is common may follow."""
            return alike(at, common, sets, x) | has[at] & (alike(at, core[at], core + u, x) | alike(at, core[at], core + self.unique, x))

        if scorer in ("indel", "sequence"):  # matching blocks are a common subsequence
            at = np.flatnonzero((2 * short >= t * both - _SLACK) & enough(both, t))
            return at[alike(at, same(at), both, t)]
        if scorer == "token_set":
            at = np.flatnonzero(has | enough(sets, t))
            return at[of_sets(at, same(at), t)]
        # weighted: lengths decide which similarities count, and by how much
        ratio = np.maximum(m, self.length) / np.maximum(1, short)
        near = ratio < 1.5
        scale = np.where(ratio <= 8, 0.9, 0.6)
        part = t / scale  # what a stretch of the longer text must reach
        least_of = np.minimum(u, self.unique)  # of any form of the shorter text
        inside = (part <= 1) & (shared >= least_of * 2 / (2 - np.minimum(part, 1)) * (1.5 * part - 1) - 1 - _SLACK)
        whole = has & (0.95 * scale >= t)
        at = np.flatnonzero(np.where(near, has | enough(sets, t) | enough(both, t), whole | inside | enough(both, t)))
        common = same(at)
        stretch = (part[at] <= 1) & (common >= part[at] * least_of[at] / (2 - np.minimum(part[at], 1)) - _SLACK)
        return at[np.where(near[at], of_sets(at, common, t), whole[at] | stretch | alike(at, common, both, t))]

    def search(self, query: str, scorer: str, least: float) -> list[tuple[str, float]]:
        """Texts and scores of at least ``least``."""
        score = SCORERS[scorer]
        found = ((self.texts[i], score(query, self.texts[i])) for i in self.candidates(query, scorer, least).tolist())
        return [(text, s) for text, s in found if s >= least]


def similar(queries: DataFrame, dictionary: DataFrame, scorer: str = "weighted", least: float = 75.0, *, query: str = "query", value: str = "value", block: int = BLOCK) -> DataFrame:
    """query, value, raw: all pairs of different texts whose score (0 to 100) is at least ``least``, once each.

    The dictionary's texts are dealt into blocks by their hash, queries into slices; each slice meets each block in one
    task, texts of the block first. Neither side is collected or broadcast, and a task holds one block.
    """
    spark = queries.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = queries.select(F.coalesce(F.col(query), F.lit("")).alias("text")).distinct()
    values = dictionary.select(F.coalesce(F.col(value), F.lit("")).alias("text")).distinct()
    blocks = max(1, -(-values.count() // block))
    dealt = lambda n: F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = values.select(dealt(blocks).alias("block"), every(slices).alias("slice"), F.lit(False).alias("asked"), "text")
    sides = sides.unionByName(own.select(every(blocks).alias("block"), dealt(slices).alias("slice"), F.lit(True).alias("asked"), "text"))
    met = sides.repartition(blocks * slices, "block", "slice").sortWithinPartitions("block", "slice", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, texts, index = None, [], None
        for b in batches:
            found: list[tuple[str, str, float]] = []
            for k, s, asked, text in zip(*(c.to_pylist() for c in b.columns)):
                if (k, s) != group:
                    group, texts, index = (k, s), [], None
                if not asked:
                    texts.append(text)
                    continue
                index = index or Index(texts)
                found += [(text, v, x) for v, x in index.search(text, scorer, least)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.float64()))], ["query", "value", "raw"])

    return met.mapInArrow(run, "query string, value string, raw double")
