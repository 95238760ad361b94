"""Text functions on the reference's cases."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from strataq.functions import similarity as sim
from strataq.functions import text as tx
from strataq.operators import mining


def phrases(spark, text):
    return {r["phrase"]: r["occurrence_count"] for r in mining.core_phrases(spark.createDataFrame([(1, text)], "id int, raw_text string"), "id").collect()}


def test_noise_gives_no_phrases(spark):
    assert phrases(spark, "REI120\n+9.56\n150\nD=40 mm") == {}
    assert phrases(spark, None) == phrases(spark, "") == {}


def test_tails_are_cut(spark):
    assert "strop żelbetowy" in phrases(spark, "STROP ŻELBETOWY WG PROJEKTU KONSTRUKCJI")
    assert phrases(spark, "RC SLAB REF. TO STRUCT. ENG. DESIGN") == {"rc slab": 2}


def test_folded_phrases(spark):
    df = spark.createDataFrame([(1, "WEŁNA MINERALNA WG SPECYFIKACJI\nMINERAL WOOL ACC. TO SPECIFICATION")], "id int, raw_text string")
    folded = {r["normalized_phrase"] for r in mining.core_phrases(df, "id").collect()}
    assert folded == {"wena mineralna", "mineral wool"}


def test_dimensions_go(spark):
    got = phrases(spark, "SŁUPEK BALUSTRADY ZE STALI NIERDZEWNEJ D=40 mm")
    assert got == dict.fromkeys(["słupek balustrady", "stali nierdzewnej", "balustrady ze stali", "słupek balustrady ze stali", "balustrady ze stali nierdzewnej", "słupek balustrady ze stali nierdzewnej"], 1)


def test_whole_phrase_counts_twice(spark):
    got = phrases(spark, "STAINLESS STEEL TOP RAIL")
    assert got["stainless steel top rail"] == 2 and got["top rail"] == 1 and len(got) == 6


def test_fold_equals_unicode_tables(spark):
    texts = ["Żółć ĄĘ ß × ½ ﬁ ² é 日本", "plain", "", None, "ÀÉîõü Ÿ ſ ǅ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = [unicodedata.normalize("NFKD", t or "").encode("ascii", "ignore").decode() for t in texts]
    assert [r[0] for r in df.select(tx.ascii_fold_exact("t")).collect()] == want
    latin = [unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in ("Żółć wełna", "Straße")]
    assert [r[0] for r in spark.createDataFrame([("Żółć wełna",), ("Straße",)], "t string").select(tx.ascii_fold("t")).collect()] == latin


def test_white_space_and_lines(spark):
    row = spark.createDataFrame([("\t A  b\n",)], "t string").select(tx.normalize_text("t"), tx.matcher_form(F.lit(None)), tx.line_kind(F.lit("+9.56")), tx.line_kind(F.lit("150")), tx.entry_kind(F.lit(""))).first()
    assert tuple(row) == ("a b", "", "number", "elevation", "specific")


def test_similarities():
    assert sim.indel("", "") == 100 and sim.indel("abc", "abc") == 100 and sim.indel("abcd", "abxd") == 75
    assert sim.token_set_ratio("fire door internal", "internal door fire") == 100 and sim.token_set_ratio("fire door", "fire door old") == 100
    assert sim.partial("wall", "brick wall") == 100 and sim.weighted_ratio("wall", "") == 0
    assert sim.weighted_ratio("steel plate", "steel plate") == 100 > sim.weighted_ratio("steel plate", "steel pipe") > 50
    assert sim.sequence_ratio("abcd", "bcde") == 75


def test_exact_rounding(spark):
    draw = random.Random(5)
    ties = [k / 20 for k in range(-3000, 3000)]
    xs = [0.35, 0.45, 0.25, -0.05, 1e9 + 0.25, *ties, *(t + draw.choice([-1, 1]) * 2**-44 for t in ties), *(draw.uniform(-200, 200) for _ in range(5000))]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(sim.rounded(F.col("x"))).collect()]
    assert got == [round(x, 1) for x in xs]
    odd = spark.createDataFrame([(None,), (float("nan"),)], "x double").select(sim.rounded(F.col("x"))).collect()
    assert odd[0][0] is None and odd[1][0] != odd[1][0]


@pytest.mark.parametrize("k,most", [(1, 1), (1, 3), (2, 4)])
def test_ngrams(spark, k, most):
    for n in range(6):
        words = [f"w{i}" for i in range(n)]
        got = spark.createDataFrame([(words,)], "t array<string>").select(tx.ngrams(F.col("t"), k, most)).first()[0]
        assert got == [words[i : i + m] for m in range(k, most + 1) for i in range(n - m + 1)]
