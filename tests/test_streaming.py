"""Streams give what the batch operators give."""

from strataq.operators import mining
from strataq.streaming import phrases


def run(spark, stream, name, mode):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"SELECT * FROM {name}")


def test_phrases(spark, tmp_path):
    rows = [("c1", "STAINLESS STEEL TOP RAIL\nREI120"), ("c2", "TOP RAIL OF STEEL"), ("c3", None)]
    df = spark.createDataFrame(rows, "crop_id string, raw_text string")
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = {r["phrase"]: r["count"] for r in run(spark, phrases.phrase_counts(stream()), "counts", "complete").collect()}
    assert got["top rail"] == 2 and got["stainless steel top rail"] == 1
    batch = {r["phrase"]: r["count"] for r in phrases.phrase_counts(spark.read.parquet(str(tmp_path / "in"))).collect()}
    assert batch == got
    assert set(got) == {r["phrase"] for r in mining.core_phrases(df, "crop_id").collect()}
    syn = spark.createDataFrame([("E1", "Top rail", 1.0, "exact", True, 0)], "ElementCode string, Phrase string, Weight double, MatchType string, Active boolean, row_ord int")
    assert sorted(r["crop_id"] for r in run(spark, phrases.code_hits(stream(), syn), "codes", "append").collect()) == ["c1", "c2"]
