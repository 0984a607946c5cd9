"""Word-processor documents, scans and books, on small cases of each kind."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from versewright.functions import headings as H
from versewright.operators import books, conversion, docx, projects, scan
from versewright.sources import files as sources

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def archive(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in entries.items():
            z.writestr(k, v)
    return bytearray(out.getvalue())


def shape(spark, *texts, keep=False, book=None, listed=()):
    d = spark.createDataFrame([("d", i, t, i in listed) for i, t in enumerate(texts)], "doc_id string, para_no int, text string, is_numbered boolean")
    lines, issues = conversion.from_shape(d, ["genesis", "exodus"], keep, book)
    return [r["line"] for r in lines.orderBy("line_no").collect()], [r["code"] for r in issues.collect()]


def test_shape_of_paragraphs(spark):
    lines, codes = shape(spark, "preface", "Genesis", "translation", "Chapter 1", "1. In the beginning", "went on", "2 second 3. third", r"\v 4", "4 fourth, then", r"\v 5 five \v 6 six", "Chapter 2 ", "no number here")
    assert lines == [
        r"\mt Genesis", r"\c 1", r"\cl Chapter 1", r"\p", r"\v 1 In the beginning went on", r"\v 2 second", r"\v 3 third", r"\v 4 fourth, then", r"\v 5 five", r"\v 6 six",
        r"\c 2", r"\cl Chapter 2", r"\p", r"\v 1 no number here",
    ]
    assert sorted(codes) == ["PREFACE_IGNORED", "VERSE_INFERRED", "VERSE_SPLIT_RECOVERED"]


def test_guessed_verse_is_taken_back(spark):
    lines, codes = shape(spark, "Genesis", "Chapter 1", r"\v 1 One ended.", "Another sentence here", r"\v 2 two", keep=True)
    assert lines[-2:] == [r"\v 1 One ended. Another sentence here", r"\v 2 two"] and codes == ["VERSE_INFERRED_FROM_PARAGRAPH_BOUNDARY"]
    assert shape(spark, "Chapter 3", "1 x", book="Exodus")[0][:2] == [r"\mt Exodus", r"\c 3"]
    assert shape(spark, "Exodus", "Chapter 1", "1 a", "b", listed=(3,))[0][-1] == r"\v 2 b"
    assert shape(spark, "Exodus", "Chapter 1", "1 a. Chapter 2 1. b")[0][3:] == [r"\p", r"\v 1 a.", r"\c 2", r"\cl Chapter 2", r"\p", r"\v 1 b"]


def test_styles(spark):
    run = lambda t, s="": f'<w:r>{f"<w:rPr><w:rStyle w:val={chr(34)}{s}{chr(34)}/></w:rPr>" if s else ""}<w:t>{t}</w:t></w:r>'
    p = lambda s, *r: f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr>{"".join(r)}</w:p>'
    doc = f'<w:document xmlns:w="{W}"><w:body>{p("USFM_MT", run("Title"))}{p("USFM_P", run("lost"), run("1", "USFM_V"), run(" one "), run("2", "USFM_V"), run("two"))}{p("Odd", run("x"))}</w:body></w:document>'
    styles = f'<w:styles xmlns:w="{W}"><w:style w:type="paragraph" w:styleId="USFM_P"/><w:style w:type="table" w:styleId="T"/></w:styles>'
    props = '<Properties xmlns="http://schemas.openxmlformats.org/officeDocument/2006/custom-properties" xmlns:vt="v"><property name="USFM_H"><vt:lpwstr>Head</vt:lpwstr></property><property name="USFM_ID"><vt:lpwstr> GEN </vt:lpwstr></property></Properties>'
    a = spark.createDataFrame([("d", archive({"word/document.xml": doc, "word/styles.xml": styles, "docProps/custom.xml": props})), ("e", bytearray(b"no zip")), ("f", archive({"x": "y"}))], "path string, content binary")
    lines, issues = docx.from_styles(sources.paragraphs(a), sources.footnotes(a))
    assert [r["line"] for r in lines.orderBy("line_no").collect()] == [r"\mt Title", r"\p", r"\v 1 one", r"\v 2 two"]
    assert sorted((r["code"], r["found"]) for r in issues.collect()) == [("STYLE_UNKNOWN_PARAGRAPH", "Odd 1"), ("VERSE_TEXT_WITHOUT_NUMBER", "lost")]
    assert [tuple(r) for r in sources.styles(a).collect()] == [("d", "paragraph", "USFM_P")]
    assert [r["code"] for r in docx.missing_styles(sources.styles(a), a.where("path = 'd'").select(F.col("path").alias("doc_id"))).collect()] == ["STYLE_MISSING_USFM_V"]
    assert [r["line"] for r in docx.headers(sources.properties(a)).orderBy("no").collect()] == [r"\id GEN", r"\h Head"]
    assert sorted((r["path"], r["code"]) for r in sources.broken(a, sources.DOCUMENT).collect()) == [("e", "ZIP_INVALID"), ("f", "DOCX_ENTRY_MISSING")]


def _lines(spark, *texts):
    return spark.createDataFrame([("d", i, t) for i, t in enumerate(texts, 1)], "doc_id string, line_no long, line string")


def _texts(df, order="line_no"):
    return [r["line"] for r in df.orderBy(order).collect()]


def test_lines_set_right(spark):
    d = _lines(spark, r"\c 1", r"\v 9 end of it Chapter 2", r"\v 1 next")
    assert _texts(docx.heading_freed(d)) == [r"\c 1", r"\v 9 end", r"\c 2", r"\cl of it Chapter 2", r"\v 1 next"]
    d = _lines(spark, r"\mt Числа", r"\c 12", r"\v 15 a", r"\c 13", r"\v 1 После того", r"\v 2 b", r"\c 14", r"\v 1 c")
    assert _texts(docx.numbers_remapped(d)) == [r"\mt Числа", r"\c 12", r"\v 15 a", r"\v 16 После того", r"\c 13", r"\v 1 b", r"\c 14", r"\v 1 c"]
    assert _texts(docx.numbers_remapped(d, "orthodox-ot")) == _texts(d) == _texts(docx.numbers_remapped(d, books=["GEN"]))
    bad = docx.continuity(_lines(spark, r"\mt A", r"\c 1", r"\v 1 a", r"\v 3 b", r"\v 3 c", r"\v 2 d", r"\v 1 e", r"\c 3", r"\c x"))
    assert sorted(r["code"] for r in bad.collect()) == ["CHAPTER_INVALID_NUMBER", "CHAPTER_SEQUENCE_GAP", "CHAPTER_WITHOUT_VERSES", "VERSE_DUPLICATE", "VERSE_DUPLICATE", "VERSE_OUT_OF_ORDER", "VERSE_RESTART_WITHOUT_CHAPTER", "VERSE_SEQUENCE_GAP"]
    assert {r["severity"] for r in docx.strict(bad, "strict").collect()} == {"Error"}


def test_books(spark):
    known = lambda c: F.lower(c).contains("exodus")
    d = _lines(spark, r"\mt Genesis", r"\c 1", r"\v 1 a The Book Exodus", r"\c 1", r"\v 1 b", "Exodus two", "Exodus three", r"\v 2 c")
    rows = books.segments(d, known, [], [" The Book "])
    assert [(r["segment"], r["title"], r["line"]) for r in rows.orderBy("line_no").collect()] == [
        (1, "Genesis", r"\mt Genesis"), (1, "Genesis", r"\c 1"), (1, "Genesis", r"\v 1 a"), (2, "The Book Exodus", r"\c 1"), (2, "The Book Exodus", r"\v 1 b"),
        (3, "Exodus two", "Exodus three"), (3, "Exodus two", r"\v 2 c"),
    ]
    one = _lines(spark, r"\mt A", r"\c 1", r"\v 1 x", r"\c 2", r"\v 1 y The Book Exodus", r"\v 2 z").withColumn("segment", F.lit(1)).withColumn("title", F.lit("A")).withColumn("book", F.lit("AAA"))
    limits = spark.createDataFrame([("AAA", 2)], "book string, chapters int")
    assert _texts(books.trimmed(one, limits, [], [" The Book "], known)) == [r"\mt A", r"\c 1", r"\v 1 x", r"\c 2", r"\v 1 y"]
    again = _lines(spark, r"\c 1", r"\v 1 x", r"\c 2", r"\c 1", r"\v 1 z").withColumn("segment", F.lit(1)).withColumn("title", F.lit("A")).withColumn("book", F.lit("BBB"))
    assert _texts(books.trimmed(again, limits, [], [], known)) == [r"\c 1", r"\v 1 x", r"\c 2"]
    psalm = _lines(spark, r"\mt x", r"\cl Псалом 3", r"\cl Song", r"\v 1 [Of David]", r"\v 2 a", r"\c 4", r"\p", r"\v 1 Song of him", r"\v 2 b")
    marked = books.psalm_markers(psalm)
    assert _texts(marked)[:4] == [r"\mt ПСАЛТЫРЬ", r"\c 3", r"\cl Псалом 3", r"\d Song"]
    assert _texts(books.psalm_bodies(marked, ["Song of"])) == [r"\mt ПСАЛТЫРЬ", r"\c 3", r"\cl Псалом 3", r"\p", r"\d Song", r"\v 1 [Of David]", r"\v 2 a", r"\c 4", r"\p", r"\d Song of him", r"\v 1 b"]
    assert books.output_folder("/a/b.usfm", False) == "/a/b_books" and books.output_folder("/a/b", False) == "/a/b"


@pytest.mark.parametrize("text,want", [("Book of Ruth (Ruth)", True), ("Book of Ruth, told", False), ("Chapter 3", False), ("1 Samuel", True), ("9 Samuel, told", False), ("Ruth", True), ("Ruth is a good book of us all", False)])
def test_titles(spark, text, want):
    known = F.col("t").rlike("Ruth|Samuel")
    assert spark.createDataFrame([(text,)], "t string").select(H.scanned_title(F.col("t"), known)).first()[0] is want


def test_scan(spark):
    p = spark.createDataFrame([("d", i, t) for i, t in enumerate(["1 early", "Exodus", "Chapter 1", "1 one 2 Two", "Genesis", "Chapter 1", "3 x", "Chapter 3"])], "doc_id string, line_no int, text string")
    a = spark.createDataFrame([("GEN", "Genesis", 0), ("EXO", "Exodus", 0)], "book string, alias string, priority int")
    f = scan.events(p, a)
    assert tuple(scan.totals(f).first()) == ("d", 2, 3, 3)
    assert [r["books"] for r in scan.detected_books(f).orderBy("testament").collect()] == ["(none)", "EXO, GEN"]
    assert [r["book"] for r in scan.order_mismatch(f).collect()] == ["GEN"]
    assert sorted(r["code"] for r in scan.structure_issues(f).collect()) == ["CHAPTER_SEQUENCE_GAP", "CHAPTER_WITHOUT_VERSES", "VERSE_BEFORE_BOOK", "VERSE_MERGED_MARKERS_DETECTED", "VERSE_START_NOT_ONE"]
    assert [c for _, c, _ in scan.canon_notes("orthodox-ot")] == ["CANON_PROFILE_SCOPE", "CANON_SELECTED", "VERSIFICATION_PROFILE_SELECTED"]


def test_profiles(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "X", "bookAliases": {" gen ": [" Genesis ", "genesis", ""]}, "headingPrefixes": [" Book ", "book"]}))
    (tmp_path / "b.json").write_text(json.dumps({"bookAliases": {"EXO": ["Exodus"]}}))
    (tmp_path / "c.json").write_text(json.dumps({"id": "x", "bookAliases": {"EXO": ["Exodus"]}}))
    (tmp_path / "d.json").write_text("{broken")
    all_ = sources.profiles(spark, [str(tmp_path / f"{c}.json") for c in "abcd"], {"headingPrefixes": ["The"]})
    assert sorted((r["id"], r["headingPrefixes"]) for r in all_.collect()) == [("X", ["Book"]), ("b", ["The"])]
    assert [tuple(r) for r in sources.aliases(sources.profile(all_, "x")).collect()] == [("GEN", "genesis", 0)]
    with pytest.raises(ValueError, match="Unknown profile"):
        sources.profile(all_, "zz")


def test_stamp():
    text, before = projects.stamped('{"generator": {"name": "x"}, "a": 1}')
    assert before == "x (missing)" and json.loads(text) == {"generator": {"name": "ts-desktop", "build": "1074"}, "a": 1}
    assert projects.stamped(text) == (text, None) and projects.stamped("broken") == ("broken", None)
