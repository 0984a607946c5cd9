"""Zipped projects: roots, manifests, chunk paths, blocking checks and warnings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versewright.functions import patterns as P
from versewright.functions import text as T

from . import lookups, sequences
from .shared import stored

#: A title file has chapter or verse markers if one of these stands at a word's start.
TITLE_MARKER = r"(?i)(?<!\S)\\(?:c\s+|v\s*)\d"
MANIFEST = "project struct<id:string,name:string>, resource struct<id:string,name:string>, target_language struct<id:string,name:string,direction:string>, format string, generator struct<name:string,build:string>, package_version int, finished_chunks array<string>"


def rooted(entries: DataFrame) -> DataFrame:
    """entries(archive, path, content) with project_root ('' for the archive itself) and rel_path."""
    roots = entries.where(F.col("path").rlike(r"^[^/]+/manifest\.json$")).groupBy("archive").agg(F.collect_set(F.split("path", "/")[0]).alias("roots"))
    top = F.when(F.col("path").contains("/"), F.split("path", "/")[0])
    d = entries.join(roots, "archive", "left").withColumn("is_root", F.coalesce(F.array_contains("roots", top), F.lit(False)))
    root = F.when(F.col("is_root"), top).when(F.col("roots").isNull(), F.lit(""))
    d = d.withColumn("project_root", root).withColumn("rel_path", F.when(F.col("is_root"), F.substring("path", F.char_length("project_root") + 2, F.char_length("path"))).otherwise(F.col("path")))
    return d.drop("roots", "is_root")


def manifests(entries: DataFrame) -> DataFrame:
    """A row for each project: ids in upper case, with defaults where a field or the file is missing."""
    return _manifests(rooted(entries))


def _manifests(roots: DataFrame) -> DataFrame:
    d = roots.where("project_root is not null")
    text = F.when(F.col("rel_path") == "manifest.json", F.expr("make_valid_utf8(cast(content as string))"))
    each = d.groupBy("archive", "project_root").agg(F.max(text).alias("t")).withColumn("m", F.from_json("t", MANIFEST, {"allowComments": "true"}))
    return each.select("archive", "project_root", F.upper(F.coalesce("m.project.id", F.lit("unk"))).alias("book"), F.coalesce("m.project.name", "m.project.id", F.lit("unknown")).alias("name"), F.coalesce("m.target_language.id", F.lit("unknown")).alias("language"), F.coalesce("m.format", F.lit("usfm")).alias("format"), F.coalesce("m.finished_chunks", F.array().cast("array<string>")).alias("finished"))


def chunk_path(rel: Column) -> tuple[Column, Column]:
    """(chapter, start) of "NN/NN.txt"; nulls for anything else, titles too."""
    ok = rel.rlike(r"^\d+/\d+\.txt$")
    return F.when(ok, F.split(rel, "/")[0].try_cast("int")), F.when(ok, F.regexp_extract(rel, r"/(\d+)\.txt$", 1).try_cast("int"))


def loose_reference(path: Column) -> tuple[Column, Column]:
    """(chapter, start) from the last folder and the file's stem, at any depth and with any extension."""
    return F.regexp_extract(path, r"(?:^|/)(\d+)/\d+(?:\.[^/.]*)?$", 1).try_cast("int"), F.regexp_extract(path, r"(?:^|/)\d+/(\d+)(?:\.[^/.]*)?$", 1).try_cast("int")


def chunks(entries: DataFrame) -> DataFrame:
    """(archive, project_root, rel_path, chapter, start, text) of chunk files; Finder files are left out."""
    return _chunks(rooted(entries))


def _chunks(roots: DataFrame) -> DataFrame:
    ch, st = chunk_path(F.col("rel_path"))
    d = roots.where("project_root is not null and not path rlike '(^|/)[.]DS_Store$'")
    return d.select("archive", "project_root", "rel_path", ch.alias("chapter"), st.alias("start"), F.expr("make_valid_utf8(cast(content as string))").alias("text")).where("chapter is not null")


def chunk_verses(chunk_rows: DataFrame) -> DataFrame:
    return chunk_rows.select("*", F.explode(T.verse_numbers(F.col("text"))).alias("verse")).where("verse is not null")


def blocking(entries: DataFrame, versification: DataFrame, starts: DataFrame) -> DataFrame:
    """(archive, project_root, code, args): what keeps a project from being cleaned. The entries are read once."""
    roots = stored(rooted(entries), "entries")
    m = stored(_manifests(roots).select("archive", "project_root", "book", "finished"), "manifests")
    c = stored(_chunks(roots).join(m, ["archive", "project_root"]), "chunks")
    counts = versification.select("book", "chapter", "max_verse")
    issue = lambda d, code, **args: d.select("archive", "project_root", F.lit(code).alias("code"), F.create_map(*[x for k, v in args.items() for x in (F.lit(k), F.col(v).cast("string"))]).alias("args"))
    titles = roots.where("rel_path rlike '(^|/)title[.]txt$' and project_root is not null").withColumn("text", F.expr("make_valid_utf8(cast(content as string))"))
    marked = issue(titles.where(F.col("text").rlike(TITLE_MARKER)), "TITLE_CONTAINS_USFM_MARKER", path="rel_path")
    known = counts.select("book").distinct().withColumn("known", F.lit(True))
    impossible = issue(c.join(counts, ["book", "chapter"], "left").join(known, "book", "left").where("known and (max_verse is null or start < 1 or start > max_verse)"), "IMPOSSIBLE_CHUNK_PATH", path="rel_path")
    v = stored(chunk_verses(c).drop("text", "finished"), "verses")
    canonical = c.join(starts.select("book", "chapter", "start").distinct(), ["book", "chapter", "start"], "left_semi").select("archive", "project_root", "rel_path")
    placed = lookups.floor(v.join(canonical, ["archive", "project_root", "rel_path"], "left_semi"), "verse", starts, "start", ["book", "chapter"], "home")
    outside = issue(placed.where("home is not null and home <> start"), "VERSE_OUTSIDE_CANONICAL_CHUNK", path="rel_path", verse="verse")
    twice = sequences.first_owner(v.select("archive", "project_root", "chapter", "verse", "rel_path").distinct(), ["archive", "project_root", "chapter", "verse"], "rel_path", ["rel_path"])
    covered = issue(twice, "DUPLICATE_VERSE_COVERAGE", path="rel_path", owner="owner", verse="verse")
    done = m.select("archive", "project_root", "book", F.explode("finished").alias("chunk")).select("*", F.regexp_extract("chunk", r"^(\d+)-\d+$", 1).try_cast("int").alias("chapter"), F.regexp_extract("chunk", r"^\d+-(\d+)$", 1).try_cast("int").alias("start")).where("start is not null")
    bad = issue(done.join(counts, ["book", "chapter"], "left").join(known, "book", "left").where("known and (max_verse is null or start < 1 or start > max_verse)"), "IMPOSSIBLE_FINISHED_CHUNK", chunk="chunk")
    t = titles.select(F.concat_ws("\u0001", "archive", "project_root").alias("project"), F.col("rel_path").alias("path"), "text")
    k = c.select(F.concat_ws("\u0001", "archive", "project_root").alias("project"), F.col("rel_path").alias("path"), "text")
    same = lookups.duplicated_titles(t, k, T.comparable).select(F.split("project", "\u0001")[0].alias("archive"), F.split("project", "\u0001")[1].alias("project_root"), "title_path", "chunk_path")
    doubled = issue(same, "TITLE_DUPLICATES_CHUNK_TEXT", path="title_path", chunk="chunk_path")
    out = marked
    for d in (impossible, outside, covered, bad, doubled):
        out = out.unionByName(d)
    return out


def warnings(entries: DataFrame, versification: DataFrame, starts: DataFrame) -> DataFrame:
    """(archive, project_root, code, args): layout and content warnings that never block. The entries are read once."""
    roots = stored(rooted(entries), "entries")
    about = stored(_manifests(roots), "manifests")
    m = about.select("archive", "project_root", "book")
    c = stored(_chunks(roots).join(m, ["archive", "project_root"]), "chunks")
    counts = versification.select("book", "chapter", "max_verse")
    row = lambda d, code, **args: d.select("archive", "project_root", F.lit(code).alias("code"), F.create_map(*[x for k, v in args.items() for x in (F.lit(k), F.col(v).cast("string"))]).alias("args"))
    mapped = c.join(starts.select("book").distinct(), "book", "left_semi").join(counts, ["book", "chapter"]).where("start between 1 and max_verse")
    odd = row(mapped.join(starts.select("book", "chapter", "start").distinct(), ["book", "chapter", "start"], "left_anti"), "NONCANONICAL_CHUNK_PATH", path="rel_path")
    holes = row(sequences.missing_between(c, ["archive", "project_root"], "chapter"), "MISSING_CHAPTER_DIRECTORY", chapter="missing")
    v = stored(chunk_verses(c).drop("text"), "verses")
    twice = row(sequences.duplicates(v, ["archive", "project_root", "rel_path", "verse"]), "DUPLICATE_VERSE_IN_CHUNK", path="rel_path", verse="verse")
    beyond = row(v.join(counts, ["book", "chapter"]).where("verse not between 1 and max_verse").select("archive", "project_root", "rel_path", "verse").distinct(), "VERSE_MARKER_OUT_OF_RANGE", path="rel_path", verse="verse")
    finished = about.select("archive", "project_root", "book", "finished").join(starts.select("book").distinct(), "book", "left_semi")
    done = finished.select("archive", "project_root", "book", F.explode("finished").alias("chunk")).where("lower(chunk) not like '%-title'").select("*", F.regexp_extract("chunk", r"^-*(\d+)-+\d+-*$", 1).try_cast("int").alias("chapter"), F.regexp_extract("chunk", r"^-*\d+-+(\d+)-*$", 1).try_cast("int").alias("start")).where("start is not null")
    stray = row(done.join(starts.select("book", "chapter", "start").distinct(), ["book", "chapter", "start"], "left_anti"), "NONCANONICAL_FINISHED_CHUNK", chunk="chunk")
    return odd.unionByName(holes).unionByName(twice).unionByName(beyond).unionByName(stray)


def verification(entries: DataFrame, versification: DataFrame) -> DataFrame:
    """(archive, project_root, code, path): what cleaning left behind in a project's text files."""
    d = rooted(entries).where("project_root is not null and lower(rel_path) like '%.txt'")
    raw = F.expr("make_valid_utf8(cast(content as string))")
    d = d.select("archive", "project_root", F.col("rel_path").alias("path"), raw.alias("text"), (F.hex(F.substring("content", 1, 3)) == "EFBBBF").alias("bom"))
    ch, st = chunk_path(F.col("path"))
    chunk = ch.isNotNull() & st.isNotNull()
    left = F.concat(
        F.when(F.col("bom"), F.array(F.lit("BOM"))).otherwise(F.array().cast("array<string>")), F.filter(T.residues(F.col("text")), lambda x: x != "BOM"),
        F.when(chunk & F.col("text").rlike(r"(?U)(?<!\S)\\c\s+\d+"), F.array(F.lit("LITERAL_CHAPTER_MARKER"))).otherwise(F.array().cast("array<string>")),
        F.when(chunk & T.empty_body(F.col("text")), F.array(F.lit("EMPTY_CHUNK"))).otherwise(F.array().cast("array<string>")),
    )
    return d.select("archive", "project_root", F.explode(left).alias("code"), "path")


def notes(entries: DataFrame, versification: DataFrame) -> DataFrame:
    """(archive, project_root, note): whether a project's structure could be checked; nothing is ever deleted."""
    known = versification.select("book").distinct().withColumn("known", F.lit(True))
    m = manifests(entries).join(known, "book", "left")
    skipped = F.concat(F.lit("Structural check skipped for "), "book", F.lit(": no verse-count table for selected canon."))
    checked = F.concat(F.lit("Validated project structure without deleting scripture chunks: "), "book", F.lit("."))
    return m.select("archive", "project_root", F.when(F.col("known"), checked).otherwise(skipped).alias("note"))


def target_language(entries: DataFrame) -> DataFrame:
    """(archive, language): of the deepest manifest that names one, the first by path among equals."""
    m = entries.where(F.col("path").rlike(r"(^|/)manifest\.json$")).select("archive", "path", F.size(F.split("path", "/")).alias("depth"), F.get_json_object(F.expr("make_valid_utf8(cast(content as string))"), "$.target_language.id").alias("language"))
    m = m.where(F.trim("language") != "")
    return m.groupBy("archive").agg(F.min(F.struct((-F.col("depth")).alias("d"), "path", "language"))["language"].alias("language"))


def identity(entries: DataFrame) -> DataFrame:
    """(archive, book, title): of the first manifest with a project; the title is the front title beside it, else the project's name."""
    text = F.expr("make_valid_utf8(cast(content as string))")
    m = entries.where(F.col("path").rlike(r"(^|/)manifest\.json$")).select("archive", "path", F.from_json(text, MANIFEST).alias("m")).where("m.project is not null")
    m = m.groupBy("archive").agg(F.min(F.struct("path", "m"))["path"].alias("path"), F.min_by("m", "path").alias("m"))
    front = entries.where(F.col("path").rlike(r"(^|/)front/title\.txt$")).select("archive", F.regexp_replace("path", r"front/title\.txt$", "manifest.json").alias("path"), F.trim(text).alias("front"))
    d = m.join(front, ["archive", "path"], "left")
    return d.select("archive", F.upper("m.project.id").alias("book"), F.coalesce(F.when(F.col("front") != "", F.col("front")), F.col("m.project.name"), F.upper("m.project.id")).alias("title"))


def stamped(manifest: str) -> tuple[str, str | None]:
    """A manifest's text with the generator's name and build, and what it had before; None if it had both already."""
    import json

    try:
        doc = json.loads(manifest.lstrip("\ufeff"))
    except ValueError:
        return manifest, None
    if not isinstance(doc, dict):
        return manifest, None
    have = doc.get("generator") if isinstance(doc.get("generator"), dict) else {}
    if (have.get("name"), have.get("build")) == (P.GENERATOR_NAME, P.GENERATOR_BUILD):
        return manifest, None
    before = " ".join(str(have.get(k) or "(missing)") for k in ("name", "build"))
    doc["generator"] = have | {"name": P.GENERATOR_NAME, "build": P.GENERATOR_BUILD}
    return json.dumps(doc, ensure_ascii=False, indent=2), before


def cleaned(entries: DataFrame, sources: DataFrame | None = None, words: dict[str, str] | None = None) -> DataFrame:
    """(archive, path, content, before, after, had_bom) of every entry that stays: the cleaner over a project's files.

    Text files go through all stages: the text, a stray first marker, direct speech against sources(archive,
    project_root, book, chapter, verse, text), chunk and title clean-up, and whole words where the language is Urdu.
    Manifests at the root and of projects get the generator's stamp. Finder files are gone; all else stays byte for
    byte. before and after are the texts of text files, null for others.
    """
    text = F.expr("make_valid_utf8(cast(content as string))")
    d = rooted(entries).where(~F.col("path").rlike(r"(^|/)\.DS_Store$"))
    lang = manifests(entries).select("archive", "project_root", F.col("language").alias("lang"), "book")
    is_text = F.lower("path").rlike(r"\.(txt|usfm)$")
    d = d.join(lang, ["archive", "project_root"], "left").withColumn("had_bom", F.hex(F.substring("content", 1, 3)) == "EFBBBF")
    others, d = d.where(~is_text), d.where(is_text)
    d = d.withColumn("before", F.when(F.col("had_bom"), F.regexp_replace(text, "^\ufeff", "")).otherwise(text))
    known = F.when(F.col("lang") != "unknown", F.col("lang"))
    ch, st = loose_reference(F.col("path"))
    d = T.clean_text(d.withColumn("lang", known), "before", "lang", "after").withColumn("chapter", ch).withColumn("start", st)
    d = d.withColumn("after", F.when(F.col("start").isNotNull(), T.without_leading_marker(F.col("after"), F.col("start"))).otherwise(F.col("after")))
    if sources is not None:
        from .documents import direct_speech, source_text

        spoken = source_text(d.where("chapter is not null and start is not null").select("archive", "path", "project_root", "book", "chapter", "start", F.col("after").alias("text")), sources)
        d = d.join(spoken.select("archive", "path", "source"), ["archive", "path"], "left").withColumn("after", direct_speech(F.col("after"), F.col("source"))).drop("source")
    for rule in T.chunk_rules(F.col("start")):
        d = d.withColumn("after", F.when(F.col("start").isNotNull() & F.col("chapter").isNotNull(), rule.apply(F.col("after"))).otherwise(F.col("after")))
    title, front = F.lower("path").rlike(r"(^|/)title\.txt$"), F.lower("path").rlike(r"(^|/)front/title\.txt$")
    d = d.withColumn("after", F.when(title, T.chapter_title(F.col("after"), front)).otherwise(F.col("after")))
    if words:
        urdu = F.coalesce(F.lower(F.trim("lang")).isin("ur", "urd"), F.lit(False)) & F.col("path").rlike(r"/(?:\d+|front)/[^/]+\.txt$")
        d = d.withColumn("after", F.when(urdu, T.words_replaced(F.col("after"), words)).otherwise(F.col("after")))

    @F.pandas_udf("string")
    def stamp(s: pd.Series) -> pd.Series:
        return s.map(lambda t: stamped(t)[0], na_action="ignore")

    changed = F.col("had_bom") | ~F.col("after").eqNullSafe(F.col("before"))
    texts = d.select("archive", "path", F.when(changed, F.encode("after", "UTF-8")).otherwise(F.col("content")).alias("content"), "before", "after", "had_bom")
    none = F.lit(None).cast("string")
    manifest = (F.col("path") == "manifest.json") | F.coalesce(F.col("rel_path") == "manifest.json", F.lit(False))
    rest = others.select("archive", "path", F.coalesce(F.encode(stamp(F.when(manifest, text)), "UTF-8"), F.col("content")).alias("content"), none.alias("before"), none.alias("after"), "had_bom")
    return texts.unionByName(rest)


def clean(entries: DataFrame, versification: DataFrame, starts: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """(cleaned entries of archives without a blocking issue, blocking issues): one blocked project keeps its whole archive back."""
    issues = blocking(entries, versification, starts)
    return cleaned(entries.join(issues.select("archive").distinct(), "archive", "left_anti"), **how), issues


def exported(entries: DataFrame) -> DataFrame:
    """(archive, project_root, line_no, line): a project as marked-up lines: seven header lines, then chapters and chunks in
    the order of their numbers; a chunk without a verse marker gets one. Chapters without chunks are left out."""
    text = F.expr("make_valid_utf8(cast(content as string))")
    d = rooted(entries).where("project_root is not null")
    m = d.where("rel_path = 'manifest.json'").select("archive", "project_root", F.from_json(text, MANIFEST).alias("m"))
    front = d.where("rel_path = 'front/title.txt'").select("archive", "project_root", F.trim(text).alias("front"))
    h = m.join(front, ["archive", "project_root"], "left")
    book = F.coalesce(F.upper("m.project.id"), F.lit("UNK"))
    title = F.coalesce(F.when(F.col("front") != "", F.col("front")), F.col("m.project.name"), book)
    resource = F.coalesce("m.resource.name", "m.resource.id", F.lit(""))
    line = lambda k, c: F.concat(F.lit(f"\\{k} "), c)
    head = F.array(line("id", F.when(F.trim(resource) == "", book).otherwise(F.concat(book, F.lit(" "), resource))), line("ide", F.coalesce("m.format", F.lit("usfm"))), line("h", title), line("toc1", title), line("toc2", title), line("toc3", book), line("mt", title))
    heads = h.select("archive", "project_root", F.lit(-1).alias("chapter"), F.lit(-1).alias("start"), F.posexplode(head).alias("no", "line"))
    c = chunks(entries).withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))
    marks = c.select("archive", "project_root", "chapter").distinct().select("archive", "project_root", "chapter", F.lit(-1).alias("start"), F.lit(0).alias("no"), line("c", F.col("chapter").cast("string")).alias("line"))
    has = F.col("text").rlike(r"(?i)\\v\s*\d")
    body = c.where("text <> ''").select("archive", "project_root", "chapter", "start", F.lit(0).alias("no"), F.when((F.col("start") > 0) & ~has, F.concat(F.lit("\\v "), F.col("start").cast("string"), F.lit(" "), "text")).otherwise(F.col("text")).alias("line"))
    w = Window.partitionBy("archive", "project_root").orderBy("chapter", "start", "no", "line")
    return heads.unionByName(marks).unionByName(body).select("archive", "project_root", F.row_number().over(w).cast("long").alias("line_no"), "line")
