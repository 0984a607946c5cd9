import json

from pyspark.sql import functions as F

from versewright.functions import text as T
from versewright.operators import audit, lookups, projects, sequences, usfm
from versewright.sinks import files as sinks
from versewright.sources import files as sources


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_edits():
    at = lambda *x: audit.edits("f/3/1.txt", "some stage", *x)
    assert at("a  b", "a b") == [(1, 3, "3:heading", " ", "", "a  b", "a b", "some stage")]
    assert at("\\c 2\n\\v 7 ay", "\\c 2\n\\v 7 by") == [(2, 6, "2:7", "a", "b", "\\v 7 ay", "\\v 7 by", "some stage")]
    assert at("same", "same") == []
    assert at("a" * 1500, "b" * 1500)[0][-1] == audit.COMBINED
    assert [e[3:5] for e in at("xabcy", "xbdcy")] == [("a", ""), ("", "d")]
    assert [e[3:5] for e in audit.edits("p", audit.CHAPTER_MARKERS, "\\c 1 one \\c 2 two", "one two")] == [("\\c 1 ", ""), ("\\c 2 ", "")]
    assert audit.edits("p", "s", "\\v 4 a \\f + b c", "\\v 4 a \\f + b d")[0][2] == "unspecified chapter:4 (footnote)"


def test_fewest_edits():
    import random

    rnd = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abc ") for _ in range(rnd.randrange(12))) for _ in range(2))
        out, i, edits = [], 0, audit.changes(a, b)
        for at, n, to, m in edits:
            assert out.append(a[i:at]) is None and len("".join(out)) == to
            out.append(b[to : to + m])
            i = at + n
        assert "".join(out) + a[i:] == b
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for x, c in enumerate(a):
            for y, d in enumerate(b):
                t[x + 1][y + 1] = t[x][y] + 1 if c == d else max(t[x][y + 1], t[x + 1][y])
        assert sum(n + m for _, n, _, m in edits) == len(a) + len(b) - 2 * t[-1][-1]


def test_report(spark):
    d = spark.createDataFrame([("r/1/2.txt", "a  b۔۔"), ("r/1/1.txt", "x ,y")], "path string, text string")
    f = audit.trail(d, T.cleaner()).unionByName(audit.reviewed(d))
    rows = audit.in_report_order(f).collect()
    assert [(r["path"], r["type"]) for r in rows] == [("r/1/1.txt", "Space before punctuation"), ("r/1/2.txt", "Repeated inline spaces"), ("r/1/2.txt", "Repeated punctuation")]
    assert [r["quantity"] for r in audit.report_rows(f).orderBy("section", "row_no").collect()] == ["1 spaces removed", "1 spaces removed", "2 characters flagged"]
    files = spark.createDataFrame([(2, 2)], "files_scanned int, files_changed int")
    assert [r["line"] for r in audit.summary(f, files).orderBy("line_no").collect()] == ["Files scanned: 2", "Files changed: 2", "Affected text lines (stage-local): 2", "Human-review findings: 1", "Verification issues after cleaning: 0", "Repeated Spaces (spaces removed): 1", "Spaces Before Punctuation (spaces removed): 1"]
    html = sinks.html_report(audit.report_rows(f), "Report").collect()
    assert html[0]["html"].startswith("<h2>") and "<td>" in html[1]["html"]


def test_totals_count_what_changed(spark):
    d = spark.createDataFrame([("f", "a  b ,c", "a b,c"), ("g", "x", "x")], "path string, x string, y string")
    f = audit.captured(d, "x", "y", F.lit("Punctuation/spacing normalization"))
    assert {(r["type"], r["original"]) for r in f.collect()} == {("Repeated inline spaces", " "), ("Space before punctuation", " ")}
    assert sum(r["n"] for r in audit.totals(f).collect()) == 2
    assert audit.affected_lines(f).first()["n"] == 1


def test_floor_before_first_is_null(spark):
    starts = spark.createDataFrame([("B", 1, 3), ("B", 1, 7)], "book string, chapter int, start int")
    v = spark.createDataFrame([("B", 1, 2), ("B", 1, 3), ("B", 1, 9), ("C", 1, 1)], "book string, chapter int, verse int")
    assert rows(lookups.floor(v, "verse", starts, "start", ["book", "chapter"]).select("book", "verse", "floor")) == [("B", 2, None), ("B", 3, 3), ("B", 9, 7), ("C", 1, None)]


def archive(files: dict) -> bytes:
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return out.getvalue()


def test_project_gate(spark):
    man = json.dumps({"project": {"id": "abc", "name": "Abc"}, "target_language": {"id": "xx"}, "finished_chunks": ["01-01", "09-01"]})
    z = archive({"p/manifest.json": man, "p/01/01.txt": r"\v 1 one \v 2 two", "p/01/03.txt": r"\v 2 again \v 3 three \v 3 x", "p/01/title.txt": r"Title \c 1", "p/03/01.txt": r"\v 1 far", "p/.DS_Store": "x"})
    e = sources.entries(spark.createDataFrame([("a.zip", bytearray(z)), ("broken.zip", bytearray(b"no"))], "path string, content binary"))
    vers = spark.createDataFrame([("ABC", c, 5) for c in (1, 2, 3)], "book string, chapter int, max_verse int")
    starts = spark.createDataFrame([("ABC", 1, 1), ("ABC", 1, 3), ("ABC", 3, 1)], "book string, chapter int, start int")
    codes = {r["code"] for r in projects.blocking(e, vers, starts).collect()}
    assert codes == {"TITLE_CONTAINS_USFM_MARKER", "DUPLICATE_VERSE_COVERAGE", "IMPOSSIBLE_FINISHED_CHUNK", "VERSE_OUTSIDE_CANONICAL_CHUNK"}
    warn = {(r["code"], r["args"].get("chapter")) for r in projects.warnings(e, vers, starts).collect()}
    assert ("MISSING_CHAPTER_DIRECTORY", "2") in warn and ("DUPLICATE_VERSE_IN_CHUNK", None) in warn
    assert projects.manifests(e).first()["book"] == "ABC"


def test_package_round_trip(spark, tmp_path):
    from versewright.operators import packaging, projects

    text = [r"\id abc Regular", r"\h Abc", r"\c 1", r"\cl First", r"\v 1 one", r"\v 2 two \v 3 three", r"\c 2", r"\v 1 باب"]
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(text, 1)] + [("e", 1, r"\id x"), ("e", 2, r"\c 1"), ("e", 3, r"\v 1 a"), ("e", 4, r"\v 1 b")], "doc_id string, line_no long, line string")
    starts = spark.createDataFrame([("ABC", 1, 1), ("ABC", 1, 3)], "book string, chapter int, start int")
    files, bad = packaging.package_files(lines, starts, "ur", 7, {"ABC": "The Abc"})
    assert [tuple(r) for r in bad.collect()] == [("e", "VERSE_DUPLICATE", 1, 1)]
    assert rows(sinks.write(sinks.packages(files), str(tmp_path))) and [p.name for p in tmp_path.iterdir()] == ["d.tstudio"]
    e = sources.entries(sources.binary(spark, str(tmp_path)))
    got = {r["path"]: bytes(r["content"]).decode() for r in e.collect()}
    root = "ur_abc_text_reg"
    assert got[f"{root}/01/01.txt"] == "\\v 1 one \\v 2 two\n" and got[f"{root}/01/03.txt"] == "\\v 3 three\n"
    assert got[f"{root}/01/title.txt"] == "First\n" and got[f"{root}/02/title.txt"] == "Chapter 2\n" and got[f"{root}/front/title.txt"] == "Abc\n"
    inner, outer = json.loads(got[f"{root}/manifest.json"]), json.loads(got["manifest.json"])
    assert inner["finished_chunks"] == ["front-title", "01-title", "01-01", "01-03", "02-title", "02-01"]
    assert inner["package_version"] == 8 and inner["target_language"] == {"id": "ur", "name": "اردو", "direction": "rtl"} and inner["project"] == {"id": "abc", "name": "The Abc"}
    assert outer["target_translations"][0]["path"] == root and outer["package_version"] == 2 and outer["timestamp"] == 7
    assert rows(projects.manifests(e.withColumn("archive", F.lit("a")))) == [("a", root, "ABC", "The Abc", "ur", "usfm", inner["finished_chunks"])]


def test_usfm_file_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([("d", 2, "two  "), ("d", 1, "one")], "doc_id string, line_no long, line string")
    out = sinks.usfm(lines).select(F.lit("x.usfm").alias("path"), "content")
    sinks.write(out, str(tmp_path)).collect()
    t = sources.texts(spark, str(tmp_path))
    assert t.first()["had_bom"] and t.first()["text"] == "one\ntwo\n"


def test_docx(spark):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    doc = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="P"/></w:pPr><w:r><w:t>one</w:t><w:br/><w:t>two</w:t><w:footnoteReference w:id="2"/></w:r></w:p><w:p><w:r><w:rPr><w:vertAlign w:val="superscript"/></w:rPr><w:t>3</w:t></w:r></w:p></w:body></w:document>'
    notes = f'<w:footnotes xmlns:w="{w}"><w:footnote w:id="-1"><w:p><w:r><w:t>x</w:t></w:r></w:p></w:footnote><w:footnote w:id="2"><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote></w:footnotes>'
    a = spark.createDataFrame([("d", bytearray(archive({"word/document.xml": doc, "word/footnotes.xml": notes})))], "path string, content binary")
    p = sources.paragraphs(a)
    assert rows(p.select("para_no", "sub_no", "text", "style")) == [(1, 0, "one", "P"), (1, 1, "two", "P"), (2, 0, "3", None)]
    t = sources.with_footnotes(p, sources.footnotes(a)).orderBy("para_no", "sub_no").collect()
    assert t[1]["text"] == r"two\f + \ft note\f*"


def test_compatibility(spark):
    d = spark.createDataFrame([("d", i, x) for i, x in enumerate([r"\id ABC", r"\c 1", r"\v 1 a", r"\v 2 b"], 1)], "doc_id string, line_no long, line string")
    out = [r["line"] for r in usfm.compatible(d, legacy=True).orderBy("line_no").collect()]
    assert out == [r"\id ABC", r"\c 1", r"\p", r"\v 1 a", r"\v 2 b"]
    assert usfm.capped(d, 0).count() == 1


def test_empty_sequences(spark):
    d = spark.createDataFrame([], "k int, n int, o int")
    assert sequences.issues(d, ["k"], "n", ["o"]).count() == 0
    assert sequences.missing_between(d, ["k"], "n").count() == 0


def test_stream(spark, tmp_path):
    from versewright.streaming.arrivals import stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.usfm").write_text("Come , here")
    q = stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("arrived").first()["cleaned"] == "Come, here"


def test_counters_of_the_pass_that_cleans(spark):
    said = ["a\u200eb \u200e", "\u200e\u00a0x ,y", "plain", None, "\ufeffx  y", "\u200f"]
    d = spark.createDataFrame([(str(i), t) for i, t in enumerate(said)], "path string, text string").repartition(3)
    rules = [r for r in T.cleaner() if r.name in ("bom", "controls", "bidi", "inline_spaces", "nbsp")] or [T.BOM, T.CONTROLS, T.BIDI]
    out, seen = audit.observed(d, rules)
    cleaned = {r["path"]: r["cleaned"] for r in out.collect()}
    got = seen.get
    found = audit.trail(d, rules).groupBy("stage").agg(F.countDistinct("path").alias("files"), F.sum(F.char_length("original") - F.char_length("replacement")).alias("removed"))
    want = {r["stage"]: (r["files"], r["removed"]) for r in found.collect()}
    for r in rules:
        assert (got[f"{r.name}_files"], got[f"{r.name}_removed"]) == want.get(r.label or r.name, (0, 0))
    assert got["files"] == 6 and got["files_changed"] == sum(cleaned[str(i)] != t for i, t in enumerate(said)) and got["bidi_removed"] == 4
