"""Order of sheets over files and versions, and .xlsx files taken apart."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from strataq.operators import classify, dictionary
from strataq.sources import spreadsheet, workbook
from strataq.sources.ordinals import numbered


@pytest.mark.parametrize("format", ["parquet", "csv", "json"])
def test_rows_are_numbered_by_file_and_place(spark, tmp_path, format, monkeypatch):
    """A small first and large later files, in more stretches than files: Spark packs the largest first."""
    sizes, at = [3, 40_000, 1, 9_000], 0
    for k, n in enumerate(sizes):
        spark.range(at, at + n).select(F.col("id").alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("pad")).coalesce(1).write.format(format).option("header", "true").save(f"{tmp_path}/{k}")
        at += n
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
    try:
        read = spark.read.format(format).option("header", "true").schema("v long, pad string").load([f"{tmp_path}/{k}" for k in range(len(sizes))])
        assert read.rdd.getNumPartitions() > len(sizes) or format == "parquet"
        got = numbered(read)
        assert got.columns == ["v", "pad", "row_ord"] and got.count() == at and got.where("v != row_ord").count() == 0
        assert got.where("v != row_ord").count() == 0 and numbered(got).columns == got.columns
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_first_and_last_rows_survive_versions(spark, tmp_path):
    folder = str(tmp_path / "dict")
    sheets = workbook.template(spark)
    workbook.save(spark, folder, sheets)
    at = f"{folder}/v000001/Synonyms"
    schema = "ElementCode string, Language string, Phrase string, Weight double, MatchType string, Active boolean"
    few = spark.createDataFrame([("E1", "en", "rail", 0.25, "exact", True)], schema)
    many = spark.createDataFrame([("E1", "en", "rail", 0.75, "exact", True)] + [(f"X{k}", "en", f"phrase {k}", 1.0, "exact", True) for k in range(5_000)], schema)
    for df in (few, many):  # appended files: names aren't in the order of writing, so name them
        df.coalesce(1).write.mode("append").parquet(at)
    import glob
    import os

    small, large = sorted((p for p in glob.glob(f"{at}/*.parquet") if os.path.getsize(p) > 0), key=os.path.getsize)[-2:]
    for p, name in ((small, "a"), (large, "b")):
        os.rename(p, f"{at}/{name}.parquet")
    for p in glob.glob(f"{at}/.*.crc"):
        os.remove(p)
    cand = spark.createDataFrame([("rail", "E1", "accept"), ("handle", "E2", "accept")], "Phrase string, SuggestedElementCode string, Decision string")
    assert workbook.import_accepted(spark, folder, cand, lambda _: True) == 0  # one more, and a repeated one less
    for _ in range(2):
        own = workbook.load(spark, folder)["Synonyms"]
        assert [tuple(r) for r in own.where("ElementCode = 'E1'").select("Phrase", "Weight").collect()] == [("rail", 0.25)]
        ends = own.orderBy("row_ord").select("Phrase").collect()
        assert ends[0][0] == "rail" and ends[-1][0] == "handle" and [r[0] for r in ends[1:4]] == ["phrase 0", "phrase 1", "phrase 2"]
        workbook.save(spark, folder, workbook.load(spark, folder))


# --- .xlsx ---------------------------------------------------------------------------------------


MAIN, REL = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def xlsx(sheets, shared=(), styles=("0", "14", "164"), date1904=False):
    """A workbook from name -> list of row XML texts."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><workbookPr date1904="{int(date1904)}"/><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(shared) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="0.0 &quot;days&quot;"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs>' + "".join(f'<xf numFmtId="{s}"/>' for s in styles) + "</cellXfs></styleSheet>")
        for k, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>' + "".join(rows) + "</sheetData></worksheet>")
    return out.getvalue()


def inline(*cells, r=None):
    return f'<row{"" if r is None else f" r={chr(34)}{r}{chr(34)}"}>' + "".join("<c/>" if c is None else f'<c t="inlineStr"><is><t>{c}</t></is></c>' if isinstance(c, str) else f"<c><v>{c}</v></c>" for c in cells) + "</row>"


def test_kinds_of_cells():
    shared = ["<si><t>plain</t></si>", "<si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si>", "<si/>"]
    row = '<row r="3"><c r="B3" t="s"><v>1</v></c><c r="D3" t="s"><v>0</v></c><c r="E3" t="b"><v>1</v></c><c r="F3" t="e"><v>#N/A</v></c><c r="G3" s="1"><v>45292.5</v></c><c r="H3" s="2"><v>59</v></c><c r="I3" s="3"><v>7</v></c><c r="J3" t="str"><f>A1</f><v>made</v></c><c r="K3"/><c r="AA3"><v>1.50</v></c><c r="AB3" t="s"><v>2</v></c></row>'
    book = xlsx({"One": [inline("x", 1), row, inline("after")], "Two": []}, shared, ("0", "14", "164", "165"))
    got = list(spreadsheet.rows_of(book))
    assert got[0] == ("One", 1, ["x", "1"]) and got[2] == ("One", 4, ["after"]) and len(got) == 3
    assert got[1] == ("One", 3, [None, "rich", None, "plain", "True", None, "2024-01-01 12:00:00", "1900-02-28 00:00:00", "7", "made", None, *[None] * 15, "1.50", ""])
    assert next(spreadsheet.rows_of(xlsx({"S": ['<row><c s="1"><v>1</v></c></row>']}, date1904=True)))[2] == ["1904-01-02 00:00:00"]


@pytest.fixture
def book(tmp_path):
    elements = [inline("ElementCode", "TitlePL", "TitleEN", "Category", "Priority"), inline("E1", "Barierka", "Guardrail", None, 90), inline("E1", "Barierka", "Guardrail", None, "high"), inline("E2", None, "Fire door", None, 20)]
    synonyms = [inline("ElementCode", "Language", "Phrase", "Weight", "MatchType", "Active"), '<row><c t="inlineStr"><is><t>E1</t></is></c><c/><c t="inlineStr"><is><t>top rail</t></is></c><c><v>0.5</v></c><c t="inlineStr"><is><t>exact</t></is></c><c t="b"><v>1</v></c></row>', inline(None, None), inline("E2", "en", "fire door", 1, "exact", "FALSE", r=9)]
    path = tmp_path / "dict.xlsx"
    path.write_bytes(xlsx({"Elements": elements, "Synonyms": synonyms, "NegativeSynonyms": [inline("ElementCode", "Phrase", "Penalty")], "Other": [inline("a", "a", None, "row_ord"), inline("1", "2", "3", "4")]}))
    return str(path)


def test_dictionary_of_a_spreadsheet(spark, book):
    sheets = workbook.from_spreadsheet(spark, book)
    assert set(sheets) == {*dictionary.SHEETS, "Other"}
    assert [tuple(r) for r in sheets["Synonyms"].orderBy("row_ord").collect()] == [("E1", None, "top rail", 0.5, "exact", True, 2), ("E2", "en", "fire door", 1.0, "exact", False, 9)]
    assert [(r["Priority"], r["row_ord"]) for r in sheets["Elements"].orderBy("row_ord").collect()] == [(90.0, 2), (None, 3), (20.0, 4)]
    assert sheets["NegativeSynonyms"].count() == sheets["StopWords"].count() == 0
    assert sheets["Other"].columns == ["a", "a.1", "Unnamed: 2", "row_ord"]
    texts = spark.createDataFrame([("c", "a top rail and a fire door")], "crop_id string, raw_text string")
    out = classify.classify(texts, sheets["Synonyms"], sheets["NegativeSynonyms"], sheets["Elements"]).first()
    assert out["detected_elements"] == ["E1"]
    assert spreadsheet.cells(spark, book).select("path", "sheet").distinct().count() == 4


def test_what_is_no_workbook(spark, tmp_path, book):
    with pytest.raises(workbook.DictionaryError, match="StopWords"):
        workbook.from_spreadsheet(spark, book, required=("StopWords",))
    (tmp_path / "bad.xlsx").write_bytes(b"not a zip")
    with pytest.raises(Exception, match="bad.xlsx is no workbook"):
        spreadsheet.cells(spark, str(tmp_path / "bad.xlsx")).collect()
