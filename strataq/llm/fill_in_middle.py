"""Fill-in-middle transformation by run-length class encoding.

A UTF-8 text is a row of runs, maximal ones of code points of one class: the
number of bytes a code point has. A run is stored as its class with the units
(code points) and the bytes that come before it. The byte of a cut after k units
is then found by a binary search for the run that holds unit k, and from there by
arithmetic: the run's first byte, and as many times the class as there are units
before the cut in that run. No text is decoded; an ASCII text is one run.

Cuts and forms follow from doc_id alone: h1 to h4 are the first four groups of
eight digits of the hex sha256 of ``salt`` and doc_id. The prefix ends after the
smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger. The
form is plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle).

Cases: a null text is empty; empty texts, and those that hold a sentinel, are
plain whatever the numbers say; a null doc_id counts as an empty one; rows that
share a doc_id have the same numbers, taken of each text's own length; other
columns stay, but those with a name (in any case) of a made column, which are
replaced; a very long text is one row, taken apart a block at a time; an empty
table gives an empty one. Bytes that are no UTF-8 stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import others, ref, release, texts_in

#: Sentinels before prefix, suffix and middle; percent of texts that are cut; percent of those that begin with the suffix.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CUT_PERCENT, SPM_PERCENT, SALT = 90, 20, "1:"
MADE = ["n", "form", "prefix_chars", "middle_chars", "output"]
#: Bytes of which the runs are found at once.
_BLOCK = 1 << 20
#: Class of a byte: of a leading one how many bytes its code point has, 0 of all others.
_CLASS = np.array([1] * 0x80 + [0] * 0x40 + [2] * 0x20 + [3] * 0x10 + [4] * 0x10, np.int8)


class Runs:
    """Runs of one class over the bytes of texts, one after the other, with what comes before each: ``unit``, ``byte``, ``width``."""

    def __init__(self, data: np.ndarray) -> None:
        units, places, widths = [], [], []
        n, last = 0, 0
        for at in range(0, len(data), _BLOCK):
            own = _CLASS[data[at : at + _BLOCK]]
            lead = np.flatnonzero(own)
            width = own[lead]
            new = np.flatnonzero(np.append(np.int8(last), width[:-1]) != width) if len(lead) else lead
            units.append(new + n)
            places.append(lead[new] + at)
            widths.append(width[new])
            n, last = n + len(lead), int(width[-1]) if len(lead) else last
        self.unit, self.byte, self.width = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (units, places, widths))
        self.n, self.size = n, len(data)

    def bytes_at(self, units: np.ndarray) -> np.ndarray:
        """First bytes of the units of these numbers; behind the last one, the end."""
        if not len(self.unit):
            return np.full(len(units), self.size)
        run = np.maximum(np.searchsorted(self.unit, units, "right") - 1, 0)
        return np.where(units >= self.n, self.size, self.byte[run] + (units - self.unit[run]) * self.width[run])

    def units_at(self, places: np.ndarray) -> np.ndarray:
        """How many units begin before these bytes."""
        if not len(self.unit):
            return np.zeros(len(places), np.int64)
        run = np.maximum(np.searchsorted(self.byte, places, "left") - 1, 0)
        behind = np.append(self.unit[1:], self.n)[run]
        inside = np.maximum(places - self.byte[run] + self.width[run] - 1, 0) // self.width[run]
        return np.minimum(self.unit[run] + inside, behind)


def pieces_of(texts: list[bytes], h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts and their numbers: units, units and bytes of the prefix, units and bytes up to the middle's end."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(sizes)
    runs = Runs(np.frombuffer(b"".join(texts), np.uint8))
    before = runs.units_at(end - sizes)
    n = runs.units_at(end) - before
    low, high = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
    at = lambda k: np.where(k == n, sizes, runs.bytes_at(before + k) - (end - sizes))
    return n, low, at(low), high, at(high)


def numbers(doc: Column, salt: str = SALT) -> list[Column]:
    """h1 to h4 of a document, each below 2**32."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(doc.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", salt: str = SALT, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """docs with n (code points), form, prefix_chars, middle_chars (null if plain) and output: a narrow map."""
    sentinels = [s.encode() for s in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = sentinels

    @F.arrow_udf("struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:binary>")
    def moved(texts: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
        h = [x.to_numpy(zero_copy_only=False) for x in (h1, h2, h3, h4)]
        parts = []
        for first, (own,) in texts_in(texts):
            own = [x or b"" for x in own]
            a, b, c, d = (x[first : first + len(own)] for x in h)
            n, low, low_at, high, high_at = pieces_of(own, a, b)
            form, output = [], []
            for x, i, j, k, spm in zip(own, low_at.tolist(), high_at.tolist(), c.tolist(), (d % 100 < spm_percent).tolist()):
                if not x or k % 100 >= cut_percent or any(t in x for t in sentinels):
                    form.append("plain")
                    output.append(x)
                elif spm:
                    form.append("spm")
                    output.append(b"".join((s, x[j:], p, x[:i], m, x[i:j])))
                else:
                    form.append("psm")
                    output.append(b"".join((p, x[:i], s, x[j:], m, x[i:j])))
            plain = np.array([f == "plain" for f in form], bool)
            columns = [pa.array(n), pa.array(form, pa.string()), pa.array(low, mask=plain), pa.array(high - low, mask=plain), pa.array(output, pa.binary())]
            parts.append(pa.StructArray.from_arrays(columns, MADE))
        release()
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())]))

    rows = docs.select(F.struct(*others(docs, *MADE)).alias("row"), moved(F.coalesce(ref(text), F.lit("")), *numbers(ref(doc), salt)).alias("made"))
    return rows.select("row.*", *[F.col(f"made.{c}").cast("string" if c == "output" else rows.schema["made"].dataType[c].dataType).alias(c) for c in MADE])


def restored(output: Column, form: Column) -> Column:
    """The text of which ``transform`` made an output: what a sentinel precedes, in the order prefix, middle, suffix."""
    parts = F.split(output, "<[PSM]>")
    joined = lambda *places: F.concat(*[F.get(parts, F.lit(k)) for k in places])
    return F.when(form == "psm", joined(1, 3, 2)).when(form == "spm", joined(2, 3, 1)).otherwise(output)
