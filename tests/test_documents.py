from pyspark.sql import functions as F

from versewright.operators import documents as D


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_direct_speech(spark):
    d = spark.createDataFrame([("اس نے کہا کہ ’آؤ‘", 'He said "come"'), ("اس نے کہا کہ ’آؤ", 'He said "come"'), ("کہ ’آؤ‘", None)], "t string, s string")
    got = [r[0] for r in d.select(D.direct_speech(F.col("t"), F.col("s"))).collect()]
    assert got == ["اس نے کہا ’آؤ‘", "اس نے کہا کہ آؤ", "کہ ’آؤ‘"]


def test_source_text(spark):
    c = spark.createDataFrame([("B", 1, 1, r"\v 1 a \v 2 b"), ("B", 1, 3, "plain"), ("C", 1, 1, "x")], "book string, chapter int, start int, text string")
    s = spark.createDataFrame([("B", 1, 1, "one"), ("B", 1, 2, " "), ("B", 1, 3, "three")], "book string, chapter int, verse int, text string")
    assert rows(D.source_text(c, s).select("book", "start", "source")) == [("B", 1, "one"), ("B", 3, "three"), ("C", 1, None)]


def test_canon(spark):
    v = spark.createDataFrame([("B", 1, 1), ("B", 1, 4), ("B", 9, 1), ("X", 1, 1)], "book string, chapter int, verse int")
    dim = spark.createDataFrame([("B", 1, 3), ("B", 2, 2)], "book string, chapter int, max_verse int")
    assert rows(D.canon_issues(v, dim)) == sorted([("B", "CANON_CHAPTER_MISSING", 2, None), ("B", "CANON_CHAPTER_EXTRA", 9, None), ("B", "CANON_VERSE_MISSING", 1, 2), ("B", "CANON_VERSE_MISSING", 1, 3), ("B", "CANON_VERSE_EXTRA", 1, 4), ("X", "NO_VERSIFICATION", None, None)], key=str)


def test_inference(spark):
    d = spark.createDataFrame([("d", 1, "A text without number", 1, 0, 9), ("d", 2, "2 the second.", 1, 2, 9), ("d", 3, "goes on here", 1, 2, 9), ("d", 4, "and here", 1, 2, 9)], "doc_id string, para_no int, text string, chapter int, verse int, max_verse int")
    assert rows(D.inferred_verses(d).select("para_no", "infer")) == [(1, "first"), (2, None), (3, "next"), (4, None)]


def test_remap(spark):
    d = spark.createDataFrame([("d", "N", 12, 15, "x"), ("d", "N", 13, 1, "After that"), ("d", "N", 13, 2, "y"), ("e", "N", 13, 1, "Other")], "doc_id string, book string, chapter int, verse int, text string")
    assert rows(D.shifted(d, 13, "^After")) == [("d", "N", 12, 15, "x"), ("d", "N", 12, 16, "After that"), ("d", "N", 13, 1, "y"), ("e", "N", 13, 1, "Other")]


def test_files(spark):
    d = spark.createDataFrame([("a/10 x.docx",), ("a/2.docx",), ("a/intro.docx",), ("a/ch3.docx",)], "path string")
    assert [r[0] for r in d.orderBy(*D.file_order(F.col("path"))).collect()] == ["a/2.docx", "a/10 x.docx", "a/ch3.docx", "a/intro.docx"]
    assert spark.sql("select 'x/41-MAT.usfm' p").select(D.book_of_file(F.col("p"), ["MRK", "MAT"])).first()[0] == "MAT"


def test_script(spark):
    d = spark.createDataFrame([("a", 1, "Кн"), ("a", 2, "ab"), ("b", 1, "12")], "doc_id string, title_no int, title string")
    assert rows(D.dominant_script(d)) == [("a", "Cyrillic"), ("b", None)]


def test_sources_stay_with_their_archive(spark):
    c = spark.createDataFrame([("A", "p", "GEN", 1, 1, r"\v 1 x"), ("B", "p", "GEN", 1, 1, r"\v 1 x"), ("B", "q", "GEN", 1, 1, "y"), ("B", "p", "GEN", 1, 1, r"\v 2 \v 1")], "archive string, project_root string, book string, chapter int, start int, text string")
    s = spark.createDataFrame([("A", "p", "GEN", 1, 1, "source of A"), ("B", "p", "GEN", 1, 1, "source of B"), ("B", "p", "GEN", 1, 2, "two")], "archive string, project_root string, book string, chapter int, verse int, text string")
    assert rows(D.source_text(c, s).select("archive", "project_root", "source")) == [("A", "p", "source of A"), ("B", "p", "source of B two"), ("B", "p", "source of B"), ("B", "q", None)]


def test_documents_are_held_alone_against_the_canon(spark):
    v = spark.createDataFrame([("d1", "B", 1, 1), ("d2", "B", 1, 2)], "doc_id string, book string, chapter int, verse int")
    dim = spark.createDataFrame([("B", 1, 2)], "book string, chapter int, max_verse int")
    assert rows(D.canon_issues(v, dim, ["doc_id"])) == [("d1", "B", "CANON_VERSE_MISSING", 1, 2), ("d2", "B", "CANON_VERSE_MISSING", 1, 1)]
    assert rows(D.canon_issues(v, dim)) == []


def test_markers_inside_a_line(spark):
    from versewright.operators import scan

    t = spark.createDataFrame([("4 one. 5 12 two. 7 three",), ("4 one .6 next",), ("x.8) “a 9 b 9 c 300 d 3 e",), (None,)], "t string")
    assert [r[0] for r in t.select(scan.embedded(F.col("t"), F.lit(4))).collect()] == [[7, 12], [6], [8, 9], None]


def test_one_closer_before_a_stop(spark):
    from versewright.functions import text as T

    cases = {"word‘”.": "word‘”.", "Go!‘”.": "Go!‘”.", "word””.": "word””.", "word”.": "word۔”", "word‘‘.": "word۔”", "Go!‘.": "Go!‘", "Go!”۔": "Go!”"}
    t = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["x"] for r in t.select("t", T.apply(T.COMMON, F.col("t")).alias("x")).collect()} == cases


def test_sequences_in_order(spark):
    from versewright.operators import sequences

    a = spark.createDataFrame([(k, i + 1, v) for k in "abcde" for i, v in enumerate(["x", None, "", "y"])], "k string, i long, v string")
    b = spark.createDataFrame([("a", i + 1, v) for i, v in enumerate(["x", None, "", "y"])] + [("b", i + 1, v) for i, v in enumerate(["x", "", None, "y"])] + [("c", i + 1, v) for i, v in enumerate(["x", None, ""])] + [("d", i + 2, v) for i, v in enumerate(["x", None, "", "y"])] + [("f", 1, "x")], "k string, i long, v string")
    got = {r["k"]: (r["n_a"], r["n_b"], r["same"]) for r in sequences.equal_sequences(a, b, ["k"], "i", "v").collect()}
    assert got == {"a": (4, 4, True), "b": (4, 4, False), "c": (4, 3, False), "d": (4, 4, False), "e": (4, 0, False), "f": (0, 1, False)}


def test_identities(spark):
    from versewright.operators import usfm

    said = {"a": [r"\id gen The First", r"\toc1 one", r"\mt two", r"\h", r"\toc1 three", r"\c 1", r"\id exo"], "b": [r"\h Head", "text"], "c": [r"  \ID rut", r"\C 1"], "d": [r"\identity x", r"\id"]}
    d = spark.createDataFrame([(k, i, t) for k, v in said.items() for i, t in enumerate(v)], "doc_id string, line_no long, line string")
    assert rows(usfm.job_identity(d)) == [("a", "gen", "The First", "three", None), ("b", None, "Head", "Head", "ID_MISSING"), ("c", "rut", None, None, None), ("d", None, None, None, "ID_MISSING")]
    p = spark.createDataFrame([("a/x.TSTUDIO",), ("b.usfm",), ("c.Txt",), ("d.pdf",), ("e.usfm/f",)], "p string")
    assert [r[0] for r in p.select(usfm.file_kind(F.col("p"))).collect()] == ["project", "usfm", "usfm", None, None]


def test_repeated_verse_replaces(spark):
    from versewright.operators import usfm

    said = ["lost", r"\c 1", "lost too", r"\v 1 one", r"\q1 more", "", r"\v 2", "text", r"\v 1 again", r"\c 2", "no verse", r"\V3 three", r"\c 1", r"\v 2 last"]
    d = spark.createDataFrame([("d", i, t) for i, t in enumerate(said)], "doc_id string, line_no long, line string")
    assert rows(usfm.source_verses(d)) == [("d", 1, 1, "again"), ("d", 1, 2, "last"), ("d", 2, 3, "three")]


def test_forms_for_other_programs(spark):
    from versewright.operators import usfm

    said = [r"\ide x", "plain", r"\c 1", r"\cl Psalm 1. A song", "first words", r"\v 1 a", "later words", r"\c 2", r"\p", "words", r"\v 1 b", r"\c 3", r"\s head", r"\v 1 c"]
    d = spark.createDataFrame([("d", i, t) for i, t in enumerate(said)], "doc_id string, line_no long, line string")
    text = lambda df: [r["line"] for r in df.orderBy("line_no").collect()]
    assert text(usfm.compatible(d)) == [r"\ide UTF-8", "plain", r"\c 1", r"\cl Psalm 1", r"\d A song", *said[4:]]
    assert text(usfm.compatible(d, legacy=True)) == [r"\ide x", "plain", r"\c 1", r"\cl Psalm 1", r"\p", r"\d A song", r"\d first words", r"\v 1 a", "later words", r"\c 2", r"\p", r"\d words", r"\v 1 b", r"\c 3", r"\s head", r"\p", r"\v 1 c"]
