"""Named files, one a row, as a sink that commits: library files and rewritten Word documents.

Tasks write into a staging folder, each attempt into one of its own; only a successful job moves what its tasks have
reported to the target, and a failed one removes the staging folder, so that nothing of it is seen: a task that outlives
its failed job can leave no more than a hidden folder, _staging-<job>.
"""

from __future__ import annotations

import io
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.parsers import expat
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: The namespace of Word's text.
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


@dataclass
class Staged(WriterCommitMessage):
    """The folder of a task's attempt and the names of the files in it."""

    folder: str
    names: list[str]


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def _at(self, path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def write(self, iterator: Iterator) -> Staged:
        context = TaskContext.get()
        folder = f"{self.staging}/{context.partitionId()}-{context.taskAttemptId()}"
        system, at = self._at(folder)
        system.create_dir(at, recursive=True)
        names: set[str] = set()
        for name, content in iterator:
            if not name or "/" in name or name.startswith(("_", ".")) or name in names:
                raise ValueError(f"not the name of a file of its own: {name!r}")
            with system.open_output_stream(f"{at}/{name}") as out:
                out.write(content or b"")
            names.add(name)
        return Staged(folder, sorted(names))

    def commit(self, messages: list[Staged | None]) -> None:
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError("two rows have one file name")
        system, at = self._at(self.path)
        system.create_dir(at, recursive=True)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(at)):
                if old.type == fs.FileType.File and old.base_name not in names:
                    system.delete_file(old.path)
        for m in done:
            for name in m.names:
                system.move(f"{self._at(m.folder)[1]}/{name}", f"{at}/{name}")
        self.abort(messages)  # the staging folder is empty now
        with system.open_output_stream(f"{at}/_SUCCESS"):
            pass

    def abort(self, messages: list[Staged | None]) -> None:
        system, at = self._at(self.staging)
        if system.get_file_info(at).type != fs.FileType.NotFound:
            system.delete_dir(at)


class NamedFiles(DataSource):
    """df.write.format("named_files"): rows (name, content binary) as files below the path."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return NamedFilesWriter(self.options["path"], overwrite)


def write_named(rows: DataFrame, path: str, mode: str = "append") -> None:
    """rows: (name, content binary). overwrite: files of other names go."""
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select("name", "content").write.format("named_files").mode(mode).save(path)


def write_libraries(exported: DataFrame, path: str, suffix: str, mode: str = "append") -> None:
    """One library file a document, <doc_id>.bib or .ris, of (doc_id, content)."""
    name = F.concat(F.col("doc_id").cast("string"), F.lit(f".{suffix}"))
    write_named(exported.select(name.alias("name"), F.encode("content", "utf-8").alias("content")), path, mode)


@dataclass
class Paragraph:
    """A paragraph of a document's body: its text, and where its element begins and ends in the bytes of the part."""

    text: str
    begin: int
    end: int


def word_paragraphs(part: bytes) -> tuple[list[Paragraph], int]:
    """The paragraphs right below the body, and where one more may be put: before the section's properties at the end."""
    parser = expat.ParserCreate(namespace_separator=" ")
    path: list[str] = []
    found: list[Paragraph] = []
    last: list[int] = []
    text: list[str] = []
    body, paragraph = [f"{WORD} document", f"{WORD} body"], f"{WORD} p"
    marks = {f"{WORD} tab": "\t", f"{WORD} br": "\n", f"{WORD} cr": "\n"}

    def start(name: str, _: dict) -> None:
        path.append(name)
        if path[:-1] == body:
            text.clear()
            begins.append(parser.CurrentByteIndex)
        elif name in marks and path[:2] == body:
            text.append(marks[name])

    def end(name: str) -> None:
        path.pop()
        at = parser.CurrentByteIndex
        if path == body:
            if name == paragraph:
                found.append(Paragraph("".join(text).strip(), begins[-1], part.index(b">", at) + 1))
            elif name == f"{WORD} sectPr":
                last.append(begins[-1])
        elif path == body[:1] and not last:
            last.append(at)

    def characters(data: str) -> None:
        if path[-1:] == [f"{WORD} t"]:
            text.append(data)

    begins: list[int] = []
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters
    parser.Parse(part, True)
    if not last:
        raise ValueError("no body")
    return found, last[-1]


def rewritten_docx(content: bytes, entries: list[str], header: str) -> bytes:
    """The archive with the paragraphs after the first header line replaced by these; without one, "References" is added.

    Only the bytes of those paragraphs change: all else of the document, tables and styles too, stays as it is.
    """
    source = zipfile.ZipFile(io.BytesIO(content))
    part = source.read("word/document.xml")
    paragraphs, at = word_paragraphs(part)
    first = next((i for i, p in enumerate(paragraphs) if re.match(header, p.text)), None)
    texts = entries if first is not None else ["References", *entries]
    new = "".join(f'<w:p xmlns:w="{WORD}"><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>' for t in texts)
    pieces, begin = [], 0
    for p in paragraphs[first + 1 :] if first is not None else []:
        pieces.append(part[begin : p.begin])
        begin = p.end
    changed = b"".join([*pieces, part[begin:at], new.encode(), part[at:]])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for item in source.infolist():
            archive.writestr(item, changed if item.filename == "word/document.xml" else source.read(item))
    return out.getvalue()


def write_docx(spark: SparkSession, path: str, out: str, formatted: DataFrame, header: str, mode: str = "append") -> None:
    """Copies of the Word documents below a path, under their own names, with the entries of (doc_id, ref_ord, formatted)
    as their reference lists; doc_id is the hash of a file's path. Without entries, and where it is no Word document, a
    file is copied as it is."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select(F.xxhash64("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    listed = formatted.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ref_ord", "formatted"))), lambda s: s["formatted"]).alias("entries"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content, entries in zip(pdf["name"], pdf["content"], pdf["entries"]):
                if entries is not None:
                    try:
                        content = rewritten_docx(content, list(entries), header)
                    except (zipfile.BadZipFile, KeyError, ValueError, expat.ExpatError):
                        pass
                yield pd.DataFrame({"name": [name], "content": [content]})

    rows = files.join(listed, "doc_id", "left").select("name", "content", "entries")
    write_named(rows.mapInPandas(run, "name string, content binary"), out, mode)
