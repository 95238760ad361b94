"""Classification, candidates, import, extraction and export on the reference's cases."""

import time

import pytest
from pyspark.sql import functions as F

from strataq.operators import classify, dictionary, export, extraction, mining
from strataq.sources import files, workbook

SYN = "ElementCode string, Phrase string, Weight double, MatchType string, Active boolean, row_ord int"


def texts(spark, *rows):
    return spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "crop_id string, raw_text string, row_ord int")


def test_report_has_a_row_a_text(spark):
    syn = spark.createDataFrame([("E1", "pompa", 1.0, "exact", True, 0)], SYN)
    el = spark.createDataFrame([("E1", 100.0, 0)], "ElementCode string, Priority double, row_ord int")
    got = {r["crop_id"]: r for r in classify.classify(texts(spark, ("c1", "brak"), ("c2", "pompa"), ("c3", None)), syn, None, el).collect()}
    assert (got["c2"]["classification_code"], got["c2"]["match_score"], got["c2"]["confidence"], got["c2"]["status"]) == ("E1", 1.0, 1.0, "matched")
    assert got["c1"]["classification_code"] == got["c3"]["classification_code"] == "UNMATCHED"


def test_fallback_synonyms(spark):
    el = spark.createDataFrame([("RF.STL", "Dach stalowy", "Steel Roof", "Dach", 90.0, 0)], "ElementCode string, NamePL string, NameEN string, Category string, Priority double, row_ord int")
    syn = dictionary.synonyms_from_elements(el).withColumn("row_ord", F.col("o2"))
    r = classify.classify(texts(spark, ("c", "detail steel roof")), syn, None, el).first()
    assert r["classification_code"] == "RF.STL" and r["match_score"] == pytest.approx(1.17) and r["confidence"] == 1.0


def test_low_priority_penalties_and_nan(spark):
    syn = spark.createDataFrame([("A", "aa", 1.0, "exact", True, 0), ("B", "bb", 2.0, "exact", True, 1), ("C", "cc", 3.0, "exact", True, 2), ("L", "ll", 9.0, "exact", True, 3), ("N", "nn", float("nan"), "exact", True, 4)], SYN)
    neg = spark.createDataFrame([("A", "bb", 0.75, 0), ("Z", "cc", 5.0, 1)], "ElementCode string, Phrase string, Penalty double, row_ord int")
    el = spark.createDataFrame([("L", 10.0, 0)], "ElementCode string, Priority double, row_ord int")
    got = {r["crop_id"]: r for r in classify.classify(texts(spark, ("1", "aa bb cc ll"), ("2", "ll nn"), ("3", "cc"), ("4", "aa bb")), syn, neg, el).collect()}
    assert got["1"]["detected_elements"] == ["C", "B", "L"] and got["1"]["confidence"] == pytest.approx(3 / (0.25 + 2 + 3 + 0.9), abs=1e-8)
    assert got["2"]["detected_elements"] == ["L"] and got["3"]["confidence"] == 1.0 and got["4"]["detected_elements"] == ["B"]


def test_candidates(spark):
    el = spark.createDataFrame([("E1", "Barierka", "Guardrail", 0), ("E2", "Drzwi pożarowe", "Fire door", 1)], "ElementCode string, TitlePL string, TitleEN string, row_ord int")
    syn = spark.createDataFrame([("E1", "stainless steel top rail", 1.0, "exact", True, 0)], SYN)
    out = mining.synonym_candidates(texts(spark, ("c1", "STAINLESS STEEL TOP RAIL"), ("c2", "STAINLESS STEEL TOP RAIL")), dictionary.reference_terms(el, syn)).collect()
    r = next(x for x in out if x["Phrase"] == "stainless steel top rail")
    assert (r["SourceCount"], r["OccurrenceCount"], r["SuggestedElementCode"], r["SuggestedBy"], r["Confidence"], r["Decision"]) == (2, 4, "E1", "substring", 1.0, "pending")
    assert r["ExampleCropIDs"] == "c1;c2" and r["ExampleTexts"] == "stainless steel top rail" and out[0]["Phrase"] == "stainless steel top rail"


def test_example_lines_are_bounded_and_may_repeat_if_long(spark):
    long = "top rail " + "x" * 200
    got = mining.phrase_rollup(mining.core_phrases(texts(spark, ("a", long), ("b", long), ("c", "top rail"), ("d", "top rail end")), "crop_id", "row_ord"), "crop_id").where("NormalizedPhrase = 'top rail'").first()
    assert got["ExampleTexts"].split(" | ") == [long[:160], long[:160], "top rail"] and got["SourceCount"] == 4


def test_import(spark, tmp_path):
    folder = str(tmp_path / "dict")
    with pytest.raises(workbook.DictionaryError):
        workbook.load(spark, folder)
    sheets = workbook.template(spark)
    workbook.save(spark, folder, sheets)
    cand = "Phrase string, SuggestedElementCode string, Decision string"
    yes = lambda _: True
    assert workbook.import_accepted(spark, folder, spark.createDataFrame([("internal fire door", "E2", "pending")], cand), yes) == 0
    two = spark.createDataFrame([("internal fire door", "E2", "accept")] * 2, cand)
    assert workbook.import_accepted(spark, folder, two) == 0 and workbook.import_accepted(spark, folder, two, lambda _: False) == 0
    assert workbook.import_accepted(spark, folder, two, yes) == 1
    assert workbook.load(spark, folder)["Synonyms"].count() == 1 and len(workbook.versions(spark, folder)) >= 2


def test_extraction(spark, tmp_path):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    page, green = (0.0, 0.0, 200.0, 200.0), [0.0, 85 / 255, 0.0]
    rows = [
        ("a.pdf", 0, 0, "Square", (5.0, 5.0, 30.0, 30.0), None, page, green, None, "a text that is long", None), ("a.pdf", 0, 1, "Circle", (5.0, 5.0, 30.0, 30.0), None, page, green, None, "", ""),
        ("a.pdf", 0, 2, "Square", (5.0, 5.0, 5.0, 10.0), None, page, green, None, "", ""), ("a.pdf", 1, 0, "Square", (50.0, 5.0, 30.0, 30.0), None, page, None, green, "ab", "seen"),
        ("a.pdf", 1, 1, "Square", (float("nan"), 5.0, 30.0, 30.0), None, page, green, None, "", ""), ("a.pdf", 1, 2, "Square", (5.0, 5.0, 30.0, 30.0), None, page, [1.0, 1.0, 0.0], None, "", ""),
    ]
    df = spark.createDataFrame(rows, f"source_pdf string, page_index int, order int, kind string, rect {box}, bound {box}, page {box}, stroke array<double>, fill array<double>, native_text string, ocr_text string")
    crops, report = extraction.extract(df, "P")
    got = crops.orderBy("annotation_index").collect()
    assert [r["crop_id"] for r in got] == ["P_page_001_detail_001", "P_page_002_detail_004"] and tuple(got[0]["bbox_pdf_coords"]) == (0.0, 0.0, 40.0, 40.0)
    assert (got[1]["raw_text"], got[1]["text_source"], got[1]["ocr_used"]) == ("ab\n\nseen", "native_pdf_text+ocr_text", True)
    assert sorted((r["annotation_index"], r["status"], r["reason"]) for r in report.collect()) == [(1, "ok", None), (3, "skipped", "invalid_clip"), (4, "ok", None), (5, "skipped", "invalid_clip")]
    assert extraction.run_counters(crops).first().asDict() == {"pages": 2, "boxes": 2}
    files.save_tables({"crops": crops, "report": report}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/crops.parquet").count() == spark.read.json(f"{tmp_path}/crops.json").count() == spark.read.csv(f"{tmp_path}/crops.csv", header=True, multiLine=True).count() == 2


def test_export(spark):
    ex = spark.createDataFrame([("c1", 3, "ok"), ("c2", 4, "ok")], "crop_id string, page_number int, status string")
    cl = spark.createDataFrame([("c1", "A-B"), ("c1", "C")], "crop_id string, proposed_code string")
    got = sorted(tuple(r) for r in export.export_metadata(ex, cl, "X Y").select("FileName", "status", "export_status").collect())
    assert got == [("DET_A-B_REF-X_Y_S3_c1.pdf", "ok", "Do weryfikacji"), ("DET_C_REF-X_Y_S3_c1.pdf", "ok", "Do weryfikacji"), ("DET_UNCLASSIFIED_REF-X_Y_S4_c2.pdf", "ok", "Do weryfikacji")]
    assert export.export_metadata(ex, cl, "P", compat_nan_code=True).where("FileName like 'DET_nan%'").count() == 1
    assert export.export_metadata(ex.drop("crop_id"), cl, "P").first()["FileName"] == "DET_UNCLASSIFIED_REF-P_S3_NA.pdf"


def test_text_sources(spark):
    box = "page int, id int, x0 int, y0 int, x1 int, y1 int, text string"
    rows = lambda page, n: [(page, i, 0, 0, 9, 9, "t") for i in range(n)]
    native, ocr = spark.createDataFrame(rows(1, 3) + rows(2, 1) + rows(3, 2), box), spark.createDataFrame(rows(1, 5) + rows(2, 2), box)
    got = {(r["page"], r["origin"]): r["count"] for r in extraction.text_source(native, ocr).groupBy("page", "origin").count().collect()}
    assert got == {(1, "native"): 3, (2, "ocr"): 2, (3, "native"): 2}
    spans = spark.createDataFrame([(1, 7, 1, 0, 0, 10, 8, " b "), (1, 7, 0, 12, 2, 40, 9, "a"), (1, 7, 2, 0, 0, 2, 2, "tiny")], "page int, line_id int, span_no int, x0 int, y0 int, x1 int, y1 int, text string")
    assert tuple(extraction.text_lines(spans).first()) == (1, 7, 0, 0, 40, 9, "a b")
    words = spark.createDataFrame([("x", "30", 0, 0, 9, 9), ("", "90", 0, 0, 9, 9), ("y", "bad", 0, 0, 9, 9), ("z", "99", 0, 0, 2, 9)], "text string, confidence string, x0 int, y0 int, x1 int, y1 int")
    assert [r["text"] for r in extraction.recognised_words(words).collect()] == ["x"]


def test_program(tmp_path):
    def script(body):
        p = tmp_path / f"p{abs(hash(body))}"
        p.write_text(f"#!/bin/sh\n{body}\n")
        p.chmod(0o755)
        return str(p)

    assert files.recognise("i.png", script("echo hello")) == ("hello", None)
    text, error = files.recognise("i.png", script("echo bad >&2; exit 1"))
    assert text == "" and "bad" in error
    assert "timeout" in files.recognise("i.png", script("sleep 5"), timeout=0.2)[1]
    assert "missing executable" in files.recognise("i.png", str(tmp_path / "none"))[1]
    begun = time.monotonic()
    assert "timeout" in files.recognise("i.png", script("sleep 60; echo late"), timeout=0.3)[1] and time.monotonic() - begun < 20  # what it started ends too


def test_one_hung_program_does_not_stop_its_batch(spark, tmp_path):
    program, runs = tmp_path / "program", tmp_path / "runs"
    program.write_text(f'#!/bin/sh\necho "$1" >> {runs}\ncase "$1" in hang*) sleep 120;; bad*) echo broken >&2; exit 3;; esac\necho "text of $1"\n')
    program.chmod(0o755)
    images = ["hang.png", *[f"i{k}.png" for k in range(12)], "bad.png", "i0.png", "i0.png", None, ""]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(images)], "k int, image string").coalesce(1)
    begun = time.monotonic()
    got = {r["k"]: (r["image"], r["o"]["text"], r["o"]["error"]) for r in df.withColumn("o", files.recognised(F.col("image"), str(program), at_once=2, timeout=5)).collect()}
    assert time.monotonic() - begun < 100 and len(got) == len(images)
    for image, text, error in got.values():
        if not image:
            assert (text, error) == ("", None)
        elif image.startswith("i"):
            assert (text, error) == (f"text of {image}", None)
        else:
            assert text == "" and ("timeout" if image == "hang.png" else "broken") in error
    assert runs.read_text().split().count("i0.png") == 1


def test_pages_and_settings(tmp_path):
    assert files.page_numbers(None, 3) == ([1, 2, 3], []) and files.page_numbers("1,3,9,3", 3)[0] == [1, 3] and len(files.page_numbers([0, 2], 3)[1]) == 1
    path = str(tmp_path / "s.json")
    assert files.load_settings(path) == files.SETTINGS
    files.save_settings(path, {"ocr_language": "ż"})
    assert files.load_settings(path)["ocr_language"] == "ż" and files.find_program({}, "no-such-program") is None


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Top rail\n\n150\nSteel")
    lines = mining.parsed_lines(files.texts(spark, str(tmp_path)), "doc_id").orderBy("line_index").collect()
    assert [(r["line_index"], r["kind"]) for r in lines] == [(0, "text"), (2, "elevation"), (3, "text")]


def test_program_state(tmp_path):
    program, data = tmp_path / "ocr", tmp_path / "tessdata"
    state = lambda **o: files.program_state(str(program), "pol+eng", **o)
    assert files.program_state(None)["state"] == state()["state"] == "missing_tesseract"
    program.write_text("")
    assert state()["message"] == "missing tessdata"
    data.mkdir()
    (data / "eng.traineddata").write_text("")
    assert state()["message"] == "missing language data: pol" and state(data=str(data))["state"] == "missing_tessdata"
    (data / "pol.traineddata").write_text("")
    assert state()["state"] == "available"


def test_crop_outputs(spark, tmp_path):
    rows = [("p_page_001_detail_001", "first\nsecond", 1), ("p_page_001_detail_002", None, 2), ("a=b/c", "", 3)]
    files.save_crops(spark.createDataFrame(rows, "base_name string, raw_text string, n int"), str(tmp_path))
    assert (next((tmp_path / "text" / "base_name=p_page_001_detail_001").glob("part-*")).read_text()) == "first\nsecond\n"
    meta = {r["base_name"]: r["n"] for r in spark.read.json(str(tmp_path / "text_meta")).collect()}
    assert meta == {r[0]: r[2] for r in rows}
    assert spark.read.text(str(tmp_path / "text"), wholetext=True).count() == 3

