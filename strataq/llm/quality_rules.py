"""Quality rules: a learned decision list, with DataFrame functions only.

``measures`` are statistics of the whole text. ``learn`` grows an ordered list
of threshold conjunctions by sequential covering: a rule starts empty, takes
the condition with the best information gain on the growing rows until it is
pure, and is then pruned from its end while its precision on the pruning rows
gets no worse. Rules under the least precision are refused and end the list.
Each step is one aggregation over a table of binned statistics of at most
``SAMPLE`` labelled rows (the only sample; chosen by hash of the doc_id); what
comes to the driver is a histogram of fixed size. ``verdict`` turns the list
into a Spark conditional expression, so applying it is a narrow projection.

Cases: null text has no words and fails the base rule; so do texts under 20
words; very long texts are measured whole; a label that repeats counts as its
least quality; rows without a label don't train; no labels or no rule good
enough give an empty list, which keeps all that the base rule keeps; other
columns pass through, but those that have the name of a measure, ``kept`` or
``rule`` are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_groups, let, others, ref, window_hashes, written

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Labelled rows that train at most, thresholds a measure has, rules and conditions a rule at most, least precision of a rule.
SAMPLE, BINS, RULES, CONDITIONS, PRECISION, LEAST = 20_000, 16, 8, 3, 0.9, 8
MIN_WORDS, MAX_REPEATED = 20, 30


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.measure) > self.threshold if self.above else F.col(self.measure) <= self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold:.6g}"


def _repeat_words(words: Column) -> Column:
    """Words in 8-word windows that occur twice or more in the text."""
    width = 8

    def positions(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))
        return let(pairs, lambda p: F.array_sort(F.array_distinct(F.flatten(F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<bigint>")))))))

    none = F.lit(0).cast("long")
    return let(window_hashes(words, width), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(let(positions(h), lambda p: in_groups(p, width))))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_shouts", "n_stops", "n_lines", "n_different")
MEASURES = tuple(f"m_{k}" for k in ("mean_word", "symbols", "dup_lines", "repeats", "upper", "digits", "shouts", "stops", "different", "words_a_line"))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, and the ratios that rules use."""
    # the columns of docs are one struct meanwhile, so that no name of theirs meets one of ours
    one = docs.select(F.struct(*others(docs, *COUNTS, *MEASURES, "base_failed")).alias("row"), F.coalesce(ref(text), F.lit("")).alias("_t"))
    one = one.withColumn("_w", F.regexp_extract_all("_t", F.lit(f"({WORD})"), F.lit(1)))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD))
    count = lambda chars: (F.length("_t") - F.length(F.translate("_t", chars, ""))).cast("long")
    two = one.select(
        "row",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        _repeat_words(F.col("_w")).alias("n_repeat_words"),
        count("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        count("0123456789").alias("n_digits"),
        count("!?").alias("n_shouts"),
        count(".,").alias("n_stops"),
        (count("\n") + 1).alias("n_lines"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_different"),
    )
    of = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    ratios = {"mean_word": of("word_chars", "n_words"), "symbols": of("n_symbols", "n_words"), "dup_lines": of("n_dup_lines", "n_lines"), "repeats": of("n_repeat_words", "n_words"), "upper": of("n_upper", "word_chars"), "digits": of("n_digits", "word_chars"), "shouts": of("n_shouts", "n_words"), "stops": of("n_stops", "n_words"), "different": of("n_different", "n_words"), "words_a_line": of("n_words", "n_lines")}
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return two.select("row.*", *COUNTS, *[c.alias(f"m_{k}") for k, c in ratios.items()], failed.alias("base_failed"))


def labelled(docs: DataFrame, labels: DataFrame, *, doc: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """bad (0/1), part (grow: 0, prune: 1), measures of at most ``sample`` labelled rows that the base rule keeps."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc).isNotNull()).groupBy(doc).agg((F.min(label) == 0).cast("int").alias("bad"))
    known = known.withColumn("order", F.xxhash64(doc)).orderBy("order", doc).limit(sample)
    found = measures(docs.select(doc, text).join(F.broadcast(known), doc), text)  # at most ``sample`` short rows
    # the filter stands behind the table: before it, the optimizer would measure every text to filter it below the join
    return written(found.select("base_failed", "bad", (F.pmod(F.xxhash64(doc, F.lit("part")), F.lit(3)) == 0).cast("int").alias("part"), *MEASURES), "labelled").where(~F.col("base_failed"))


def learn(rows: DataFrame, *, bins: int = BINS, most: int = RULES, conditions: int = CONDITIONS, precision: float = PRECISION, least: int = LEAST) -> list[list[Condition]]:
    """Ordered rules (conjunctions) that reject."""
    cuts = [k / bins for k in range(1, bins)] + [0.99]
    limits = rows.agg(F.count("*").alias("n"), *[F.percentile(m, F.array(*[F.lit(c) for c in cuts])).alias(f"all_{m}") for m in MEASURES], *[F.percentile(F.when(F.col("bad") == 1, F.col(m)), F.array(*[F.lit(c) for c in (0.05, 0.25, 0.5, 0.75, 0.95)])).alias(f"bad_{m}") for m in MEASURES]).first()
    if not limits["n"]:
        return []
    values = {m: sorted({*(limits[f"all_{m}"] or []), *(limits[f"bad_{m}"] or [])}) for m in MEASURES}
    # halfway between two quantiles: a rule keeps its distance from both kinds
    thresholds = {m: [(a + b) / 2 for a, b in zip(v, v[1:])] for m, v in values.items()}
    bin_of = lambda m: F.array_size(F.filter(F.array(*[F.lit(x) for x in thresholds[m]]).cast("array<double>"), lambda x: F.col(m) > x))
    table = rows.select("bad", "part", *MEASURES, F.array(*[bin_of(m) for m in MEASURES]).alias("bins")).groupBy("bad", "part", "bins", *MEASURES).agg(F.count("*").alias("n"))
    table = written(table.coalesce(1), "binned")

    def counts(where: Column) -> tuple[dict, dict]:
        """Rows by (part, bad), and by (part, bad, measure, bin), of those where the condition holds."""
        got = table.where(where).select("bad", "part", "n", F.posexplode("bins").alias("m", "bin")).groupBy("part", "bad", "m", "bin").agg(F.sum("n").alias("n")).collect()  # a histogram of fixed size
        total: dict = {}
        cell: dict = {}
        for r in got:
            if r["m"] == 0:
                total[r["part"], r["bad"]] = total.get((r["part"], r["bad"]), 0) + r["n"]
            cell.setdefault((r["part"], MEASURES[r["m"]]), {}).setdefault(r["bin"], [0, 0])[r["bad"]] += r["n"]
        return total, cell

    def split(cell: dict, part: int, m: str, k: int) -> tuple[int, int, int, int]:
        """good and bad with measure <= threshold k; good and bad above."""
        low, high = [0, 0], [0, 0]
        for b, (g, x) in cell.get((part, m), {}).items():
            to = low if b <= k else high
            to[0] += g
            to[1] += x
        return (*low, *high)

    rules: list[list[Condition]] = []
    free = F.lit(True)
    for _ in range(most):
        rule: list[Condition] = []
        inside = free
        kept: list[tuple[float, int]] = []  # precision and rows on the pruning rows after each condition
        for _ in range(conditions):
            total, cell = counts(inside)
            good, bad = total.get((0, 0), 0), total.get((0, 1), 0)
            if not bad or not good:
                break
            base, best = math.log2(bad / (good + bad)), (0.0, None, (0, 0))
            for m in MEASURES:
                for k in range(len(thresholds[m])):
                    lg, lb, hg, hb = split(cell, 0, m, k)
                    for above, g, b in ((False, lg, lb), (True, hg, hb)):
                        if b >= least and g + b < good + bad and (gain := b * (math.log2(b / (g + b)) - base)) > best[0]:
                            g1, b1 = split(cell, 1, m, k)[2:] if above else split(cell, 1, m, k)[:2]
                            best = (gain, Condition(m, above, float(thresholds[m][k])), (g1, b1))
            if best[1] is None:
                break
            rule.append(best[1])
            inside = inside & best[1].column()
            g1, b1 = best[2]
            kept.append(((b1 + 1) / (g1 + b1 + 2), g1 + b1))
        while len(kept) > 1 and kept[-2][0] >= kept[-1][0]:
            kept.pop()
            rule.pop()
        if not rule or kept[-1][0] < precision or kept[-1][1] < 2:
            break
        rules.append(rule)
        whole = F.lit(True)
        for c in rule:
            whole = whole & c.column()
        free = free & ~whole
    return rules


def verdict(rules: list[list[Condition]]) -> tuple[Column, Column]:
    """kept (boolean) and rule (which rejects, from 1; null if none does), from ``measures``."""
    rule = F.lit(None).cast("int")
    for i, own in reversed(list(enumerate(rules, 1))):
        holds = F.lit(True)
        for c in own:
            holds = holds & c.column()
        rule = F.when(holds, F.lit(i)).otherwise(rule)
    return ~F.col("base_failed") & rule.isNull(), rule


def apply(docs: DataFrame, labels: DataFrame, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with measures, kept and rule; the list is learnt from labels first."""
    kept, rule = verdict(learn(labelled(docs, labels, doc=doc, text=text)))
    return measures(docs.select(*others(docs, "kept", "rule")), text).select("*", kept.alias("kept"), rule.alias("rule"))
