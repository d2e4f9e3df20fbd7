"""Bibliography files and documents as sources and sinks: Zotero JSON, BibTeX, RIS, Word documents, plain paragraphs."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import names, text as tx
from . import files as named

ZOTERO = "array<struct<key:string,title:string,creators:array<struct<creatorType:string,lastName:string,firstName:string>>,date:string,publicationTitle:string,volume:string,issue:string,pages:string,DOI:string,extra:string>>"
_ZOTERO_FIELDS = ("key", "title", "creators", "date", "publicationTitle", "volume", "issue", "pages", "DOI", "extra")
_REF = ("lib_id", "item", "ref_id", "authors", "title", "year", "journal", "volume", "issue", "pages", "doi")


def read_library(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Reader by kind, or by the manager that writes it: zotero, bibtex (mendeley) or ris (endnote); one row an entry, one
    lib_id a file. Other kinds are a ValueError."""
    readers = {"zotero": zotero, "bibtex": bibtex, "mendeley": bibtex}
    if kind in ("ris", "endnote"):
        return read_ris(spark, path)
    if kind not in readers:
        raise ValueError(f"unsupported library kind: {kind}")
    return readers[kind](library_files(spark, path))


def library_files(spark: SparkSession, path: str) -> DataFrame:
    """(lib_id, content) of whole files."""
    return spark.read.text(path, wholetext=True).select(_lib_id().alias("lib_id"), F.col("value").alias("content"))


def _lib_id() -> Column:
    return F.xxhash64(F.col("_metadata.file_path"))


def unread(files: DataFrame, entries: DataFrame, kind: str) -> DataFrame:
    """(lib_id, reason) of library files (lib_id, content) that are not blank and gave no entry: they stop nothing else."""
    some = files.where(tx.filled(tx.strip(F.col("content")))).select("lib_id")
    return some.join(entries.select("lib_id").distinct(), "lib_id", "left_anti").withColumn("reason", F.lit(f"no {kind} entry"))


def _free_year(c: Column) -> Column:
    return F.regexp_extract(c, "((?:19|20)[0-9]{2})", 1).try_cast("int")


def zotero(files: DataFrame) -> DataFrame:
    """Entries of (lib_id, content): an array, an object with items, or one object. Authors only; DOI also from extra.
    What has no known field, as text that is no JSON, is no entry."""
    c = F.col("content")
    item = ZOTERO.removeprefix("array<").removesuffix(">")
    boxed = F.from_json(c, "struct<items:array<string>>")["items"]
    texts = F.when(tx.strip(c).startswith("["), F.from_json(c, "array<string>")).when(boxed.isNotNull(), boxed).otherwise(F.array(c))
    items = F.transform(texts, lambda t: F.from_json(t, item))  # each by itself: one that cannot be read spoils no other
    z = files.select("lib_id", F.posexplode(items).alias("i", "z")).where(F.coalesce(*[F.col(f"z.{c}").cast("string") for c in _ZOTERO_FIELDS]).isNotNull())
    people = F.filter("z.creators", lambda p: (F.coalesce(p["creatorType"], F.lit("author")) == "author") & tx.filled(p["lastName"]))
    authors = F.transform(people, lambda p: F.concat_ws(", ", p["lastName"], F.nullif(p["firstName"], F.lit(""))))
    doi = F.coalesce(F.nullif("z.DOI", F.lit("")), F.nullif(F.regexp_extract("z.extra", r"DOI:\s*(\S+)", 1), F.lit("")))
    key = F.coalesce(F.nullif("z.key", F.lit("")), F.concat(F.lit("zotero_"), F.col("i").cast("string")))
    return z.select("lib_id", (F.col("i") + 1).alias("item"), key.alias("ref_id"), F.coalesce(authors, F.array().cast("array<string>")).alias("authors"), "z.title", _free_year(F.col("z.date")).alias("year"), F.col("z.publicationTitle").alias("journal"), "z.volume", "z.issue", "z.pages", doi.alias("doi"))


def bibtex(files: DataFrame) -> DataFrame:
    """Entries of (lib_id, content). Values in braces nest; braces are taken from titles; number is the issue."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(lib, i, key, fields) for lib, content in zip(pdf["lib_id"], pdf["content"]) for i, (key, fields) in enumerate(_bibtex_entries(content or ""), 1)]
            yield pd.DataFrame(rows, columns=["lib_id", "item", "ref_id", "f"])

    e = files.select("lib_id", "content").mapInPandas(run, "lib_id long, item int, ref_id string, f map<string,string>")
    f = lambda n: F.nullif(F.col("f")[n], F.lit(""))
    authors = F.filter(F.transform(F.split(f("author"), r"\s+and\s+"), tx.strip), lambda a: a != "")
    return e.select("lib_id", "item", "ref_id", F.coalesce(authors, F.array().cast("array<string>")).alias("authors"), F.regexp_replace(F.coalesce(F.col("f")["title"], F.lit("")), "[{}]", "").alias("title"), _free_year(f("year")).alias("year"), f("journal").alias("journal"), f("volume").alias("volume"), f("number").alias("issue"), F.replace(f("pages"), F.lit("--"), F.lit("-")).alias("pages"), f("doi").alias("doi"))


def _bibtex_entries(content: str) -> Iterator[tuple[str, dict[str, str]]]:
    """Key and fields of each entry, by brace depth; comment, string and preamble blocks are passed over."""
    for head in re.finditer(r"@(\w+)\s*\{\s*([^,\s{}]*)\s*,", content):
        if head[1].lower() in ("comment", "string", "preamble"):
            continue
        at, depth, fields, name, value = head.end(), 1, {}, "", ""
        in_value = quoted = False
        while at < len(content) and depth:
            c = content[at]
            if c == '"' and depth == 1 and in_value:
                quoted = not quoted
            elif c == "{":
                depth += 1
                value += c if in_value and depth > 2 else ""
            elif c == "}":
                depth -= 1
                value += c if in_value and depth > 1 else ""
            elif c == "=" and depth == 1 and not in_value:
                in_value = True
            elif c == "," and depth == 1 and not quoted:
                if name.strip():
                    fields[name.strip().lower()] = " ".join(value.split())
                name, value, in_value = "", "", False
            elif in_value:
                value += c
            else:
                name += c
            at += 1
        if name.strip():
            fields[name.strip().lower()] = " ".join(value.split())
        yield head[2], fields


#: A line of a RIS file: tag and value; and where a record begins.
_RIS_LINE, _RIS_BEGIN = r"^\s*([A-Z][A-Z0-9])\s{2}-\s?(.*)$", r"(?m)^(?=[ \t]*TY  -)"


def _ris_records(rows: DataFrame, text: str) -> DataFrame:
    """A row a record, in the column record with its number in the text, from 0, as i; what stands before the first goes."""
    parts = rows.select(*[c for c in rows.columns if c != text], F.posexplode_outer(F.split(text, _RIS_BEGIN)).alias("i", "record"))
    return parts.where(F.col("record").rlike(r"^[ \t]*TY  -"))


def _ris_fields(records: DataFrame) -> DataFrame:
    """Entries of (lib_id, item, record), each record folded in its row: of other tags than AU and A1 the last value wins."""
    lines = F.transform(F.split("record", r"\r?\n"), lambda t: F.struct(F.regexp_extract(t, _RIS_LINE, 1).alias("tag"), tx.strip(F.regexp_extract(t, _RIS_LINE, 2)).alias("v")))
    told = F.filter(lines, lambda x: (x["tag"] != "") & (x["v"] != ""))
    # exploded, so that no later step computes the lines once more (outer: Spark tests the size of others first); the last line comes first
    r = records.select("lib_id", "item", F.explode_outer(F.array(F.reverse(told))).alias("t")).where(F.size("t") > 0)
    of = lambda *tags: F.filter(F.reverse("t"), lambda x: x["tag"].isin(*tags))
    last = lambda *tags: F.coalesce(*[F.get("t.v", (F.array_position("t.tag", F.lit(tag)) - 1).cast("int")) for tag in tags])
    pages = F.when(last("SP").isNotNull(), F.concat_ws("-", last("SP"), last("EP")))
    return r.select(
        "lib_id", "item", F.concat(F.lit("ris_"), F.col("item").cast("string")).alias("ref_id"), F.transform(of("AU", "A1"), lambda x: x["v"]).alias("authors"),
        last("TI", "T1").alias("title"), _free_year(last("PY", "Y1", "DA")).alias("year"), last("JO", "T2", "JF", "JA").alias("journal"), last("VL").alias("volume"),
        last("IS").alias("issue"), pages.alias("pages"), last("DO").alias("doi"))


def ris(files: DataFrame) -> DataFrame:
    """Entries of (lib_id, content): a record is begun by its TY line. No shuffle: a text is cut and folded in its row."""
    r = _ris_records(files.withColumn("first", F.col("content").rlike(r"\A[ \t]*TY  -")), "content")
    return _ris_fields(r.select("lib_id", (F.col("i") + F.col("first").cast("int")).alias("item"), "record"))


def read_ris(spark: SparkSession, path: str) -> DataFrame:
    """Entries of RIS files, cut at their end tags while they are read, so that many tasks read one file.

    Numbers follow from counts: records before the block that a task reads, then the place in that block. No window holds
    more than a block's records.
    """
    read = spark.read.text(path, lineSep="\nER  -").select(_lib_id().alias("lib_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    r = _ris_records(read, "value")
    own = F.row_number().over(Window.partitionBy("lib_id", "block").orderBy("place", "i"))
    sizes = r.groupBy("lib_id", "block").agg(F.count("*").alias("n"))  # one row a block of a file
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lib_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = r.withColumn("own", own).join(sizes.select("lib_id", "block", before.alias("before")), ["lib_id", "block"])
    return _ris_fields(r.select("lib_id", (F.col("before") + F.col("own")).cast("int").alias("item"), "record"))


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, text): the paragraphs of Word documents, blank ones left out; other suffixes are not read.

    Tabs and breaks are kept as such. A file that is no Word document gives one row without ord and text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"]):
                try:
                    found, _ = named.word_paragraphs(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
                except (zipfile.BadZipFile, KeyError, ValueError, expat.ExpatError):
                    rows.append((name, None, None))
                    continue
                rows += [(name, i, text) for i, text in enumerate(p.text for p in found if p.text)]
            yield pd.DataFrame(rows, columns=["path", "ord", "text"]).astype({"ord": "Int32"})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content").mapInPandas(run, "path string, ord int, text string")


# Header lines of the reference section, lines that end it, and how an entry begins.
HEADER = r"(?i)^\s*(references?|bibliography|works?\s+cited|literature\s+cited|sources?|citations?)\s*$"
END = r"(?i)^(Figure\s*\d|Fig\.\s*\d|Figure\s+Captions?|Table\s*\d|Table\s+Captions?|Appendix|Supplementary|Supporting\s+Information|Acknowledgements?|Author\s+Contributions?|Conflict\s+of\s+Interest|Data\s+Availability|Funding)"
START = r"^(\[\d+\]|\d+\.\s+|(?:[a-z]+\s+)*[A-Z][a-zA-Z'\-\u2010\u2011\u2012\u2013\u2014]*,?\s+[A-Z]|[A-Z]\s+[A-Z][a-z]+\s+)"


def sections(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, ord, text) with the part of each: body before the first header line, references until an end line, rest."""
    w = Window.partitionBy("doc_id")
    first = F.min(F.when(F.col("text").rlike(HEADER), F.col("ord"))).over(w)
    p = paragraphs.withColumn("header", first)
    end = F.min(F.when((F.col("ord") > F.col("header")) & tx.strip(F.col("text")).rlike(END), F.col("ord"))).over(w)
    part = F.when(F.col("header").isNull() | (F.col("ord") < F.col("header")), "body").when(F.col("ord") == F.col("header"), "header").when(end.isNull() | (F.col("ord") < end), "references").otherwise("rest")
    return p.withColumn("part", part).drop("header")


def entries(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, ref_ord, raw_text): a paragraph that looks like a beginning begins an entry, others continue it; blank ones count for nothing."""
    p = sections(paragraphs).where("part = 'references'").withColumn("text", tx.strip(F.col("text"))).where("text <> ''")
    run = F.count_if(F.col("text").rlike(START)).over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    g = p.withColumn("run", run).groupBy("doc_id", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", tx.strip(F.col("text")).alias("t")))), lambda s: s["t"]), " ").alias("raw_text"))
    return g.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("run")).alias("ref_ord"), "raw_text")


def bodies(paragraphs: DataFrame) -> DataFrame:
    p = sections(paragraphs).where("part = 'body'")
    return p.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]), "\n\n").alias("body"))


def offsets(paragraphs: DataFrame, gap: int = 2) -> DataFrame:
    """(doc_id, ord, start_pos, end_pos) of each paragraph in the joined text."""
    before = F.coalesce(F.sum(F.length("text") + gap).over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return paragraphs.select("doc_id", "ord", before.cast("int").alias("start_pos"), (before + F.length("text")).cast("int").alias("end_pos"))


def bibtex_entries(refs: DataFrame) -> DataFrame:
    """(doc_id, ref_ord, key, entry, warnings): keys are unique in a document, by letters after repeated ones."""
    first = F.get("authors", F.lit(0))
    last = F.when(F.contains(first, F.lit(",")), F.split(first, ",")[0]).otherwise(F.element_at(F.nullif(tx.split_words(first), F.array().cast("array<string>")), -1))
    base = F.lower(F.concat(F.regexp_replace(F.coalesce(last, F.lit("")), "[^a-zA-Z]", ""), F.coalesce(F.when(F.col("year") != 0, F.col("year").cast("string")), F.lit(""))))
    n = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("ref_ord"))
    r = refs.withColumn("base", base).withColumn("n", n).withColumn("key", F.when(F.col("n") > 1, F.concat("base", F.char(95 + F.col("n")))).otherwise(F.col("base")))
    line = lambda name, v, test: F.when(test, F.concat(F.lit(f"  {name} = {{"), v, F.lit("},")))
    plain = lambda name, c, v=None: line(name, F.col(c) if v is None else v, tx.filled(F.col(c)))
    who = F.array_join(F.transform("authors", names.bibtex_author), " and ")
    pages = F.regexp_replace("pages", "-+", "--")
    entry = F.concat_ws("\n", F.concat(F.lit("@article{"), "key", F.lit(",")), line("author", who, F.size("authors") > 0), plain("title", "title", F.concat(F.lit("{"), tx.escape_latex(F.col("title")), F.lit("}"))), line("year", F.col("year").cast("string"), F.col("year") != 0), plain("journal", "journal", tx.escape_latex(F.col("journal"))), plain("volume", "volume"), plain("number", "issue"), plain("pages", "pages", pages), plain("doi", "doi"), F.lit("}"))
    return r.select("doc_id", "ref_ord", "key", entry.alias("entry"), _warnings(F.col("key")).alias("warnings"))


def _warnings(key: Column) -> Column:
    lacks = [F.when(F.coalesce(F.size("authors") == 0, F.lit(True)), "authors"), F.when(~tx.filled(F.col("title")), "title"), F.when(F.coalesce(F.col("year") == 0, F.lit(True)), "year")]
    return F.array_join(F.transform(F.filter(F.array(*lacks), lambda x: x.isNotNull()), lambda x: F.concat(key, F.lit(": missing "), x)), "; ")


def ris_entries(refs: DataFrame) -> DataFrame:
    """(doc_id, ref_ord, entry, warnings)."""
    tag = lambda t, v, test: F.when(test, F.concat(F.lit(f"{t}  - "), v))
    plain = lambda t, c: tag(t, F.col(c), tx.filled(F.col(c)))
    pages = F.translate("pages", "–—", "--")
    start, end = tx.strip(F.split(pages, "-", 2)[0]), tx.strip(F.get(F.split(pages, "-", 2), F.lit(1)))
    who = F.when(F.size("authors") > 0, F.array_join(F.transform("authors", lambda a: F.concat(F.lit("AU  - "), a)), "\n"))
    entry = F.concat_ws("\n", F.lit("TY  - JOUR"), who, plain("TI", "title"), tag("PY", F.col("year").cast("string"), F.col("year") != 0), plain("JO", "journal"), plain("VL", "volume"), plain("IS", "issue"), tag("SP", start, tx.filled(F.col("pages"))), tag("EP", end, tx.filled(end)), plain("DO", "doi"), plain("UR", "doi_url"), F.lit("ER  - "), F.lit(""))
    return refs.select("doc_id", "ref_ord", entry.alias("entry"), _warnings(F.col("ref_id")).alias("warnings"))


def exported(rows: DataFrame) -> DataFrame:
    """(doc_id, content, entry_count): a document's entries in order, a blank line between."""
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ref_ord", "entry"))), lambda s: s["entry"]), "\n\n").alias("content"), F.count("*").alias("entry_count"))


def write_library(rows: DataFrame, path: str, suffix: str, mode: str = "append") -> None:
    """One library file a document, <doc_id>.bib or .ris, all or none of them."""
    named.write_libraries(exported(rows), path, suffix, mode)


def write_docx(spark: SparkSession, path: str, out: str, formatted: DataFrame, mode: str = "append") -> None:
    """Copies of the Word documents below a path with their reference lists replaced, all or none of them."""
    named.write_docx(spark, path, out, formatted, HEADER, mode)


def rewritten(paragraphs: DataFrame, formatted: DataFrame) -> DataFrame:
    """(doc_id, ord, text) of documents with their reference lists replaced: all after the header goes, new entries follow;
    without a header, one is added."""
    p = sections(paragraphs)
    kept = p.where("part in ('body', 'header')").select("doc_id", F.lit(0).alias("k"), "ord", "text")
    none = p.groupBy("doc_id").agg(F.max((F.col("part") == "header").cast("int")).alias("h")).where("h = 0").select("doc_id", F.lit(1).alias("k"), F.lit(0).alias("ord"), F.lit("References").alias("text"))
    new = formatted.select("doc_id", F.lit(2).alias("k"), F.col("ref_ord").alias("ord"), F.col("formatted").alias("text"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("k", "ord"))
    return kept.unionByName(none).unionByName(new).select("doc_id", (order - 1).alias("ord"), "text")
