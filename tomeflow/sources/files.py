"""Files of novels as DataFrames, and novels as files.

Readers give (file_path, title, content, toc, parts). Suffixes are told apart without regard to case;
an unknown one is an error.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "file_path string, title string, content string, toc array<string>, parts array<string>"


def parse_txt(raw: bytes) -> tuple:
    """UTF-8, bytes that aren't are left out; no title."""
    return "", raw.decode("utf-8", "ignore"), None, None


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _plain(raw: bytes) -> str:
    import html

    text = html.unescape(re.sub(r"<[^>]+>", " ", raw.decode("utf-8", "ignore")))
    return re.sub(r"\s+", " ", text).strip()


def parse_epub(raw: bytes) -> tuple:
    """Title, text of each document of the manifest, and the top-level titles of the table of contents. Broken files give nothing."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            container = ElementTree.fromstring(z.read("META-INF/container.xml"))
            opf = next(e.attrib["full-path"] for e in container.iter() if _local(e.tag) == "rootfile")
            package, base = ElementTree.fromstring(z.read(opf)), posixpath.dirname(opf)
            title = next((e.text or "" for e in package.iter() if _local(e.tag) == "title"), "")
            items = [e.attrib for e in package.iter() if _local(e.tag) == "item"]
            at = lambda href: posixpath.normpath(posixpath.join(base, href))
            names = set(z.namelist())
            parts = [_plain(z.read(at(i["href"]))) for i in items if i.get("media-type") == "application/xhtml+xml" and "nav" not in i.get("properties", "") and at(i["href"]) in names]
            toc: list[str] = []
            for i in items:
                if i.get("media-type") == "application/x-dtbncx+xml" and at(i["href"]) in names:
                    for nav in (e for e in ElementTree.fromstring(z.read(at(i["href"]))).iter() if _local(e.tag) == "navMap"):
                        for point in nav:
                            # a point with points inside is a section, which has no title of its own here
                            if _local(point.tag) == "navPoint" and not any(_local(c.tag) == "navPoint" for c in point):
                                text = "".join(e.text or "" for e in point.iter() if _local(e.tag) == "text")
                                toc += [text] if text else []
            return title, "\n".join(parts), toc, parts
    except (KeyError, StopIteration, zipfile.BadZipFile, ElementTree.ParseError):
        return None, None, None, None


PARSERS = {".txt": parse_txt, ".epub": parse_epub}


def suffix(path: str) -> str:
    return posixpath.splitext(path)[1].lower()


def read_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """All files under the paths; file_path is the full one. Each file is parsed in the task that reads it."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")

    def parse(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"]):
                if suffix(path) not in PARSERS:
                    raise ValueError(f"no parser for {path}")
                rows.append((path, *PARSERS[suffix(path)](raw)))
            yield pd.DataFrame(rows, columns=["file_path", "title", "content", "toc", "parts"])

    return files.mapInPandas(parse, SCHEMA)


def novel_title(df: DataFrame, given: str | None = None) -> F.Column:
    """The given title, else the document's, else the file's name."""
    stem = F.regexp_extract("file_path", r"([^/]*?)(\.[^./]*)?$", 1)
    return F.coalesce(F.nullif(F.lit(given).cast("string"), F.lit("")), F.nullif(F.col("title"), F.lit("")), stem)


NOVEL = (
    "novel_id string, title string, summary string, features array<string>, characters array<struct<name:string,role:string,relationships:string>>, "
    "chapters array<struct<chapter_id:string,title:string,content:string,metadata:map<string,string>,embedding:array<double>>>, summary_embedding array<double>, "
    "metadata struct<source_path:string,summaries:struct<chapters:array<struct<chapter_id:string,title:string,summary:string,summary_status:string>>,"
    "plots:array<struct<volume_title:string,start_chapter:string,end_chapter:string,summary:string>>,overall:string>>, created_at string"
)


def read_novels(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """Novels kept as JSON, one in a file, in the folder itself or in a novel's own folder as ``write_novels`` makes it.
    Files of progress aren't novels; unreadable ones are left out."""
    df = spark.read.schema(NOVEL).json(folder, multiLine=True, mode="DROPMALFORMED", recursiveFileLookup=True, pathGlobFilter="*.json").where(~F.col("_metadata.file_name").endswith(".progress.json"))
    df = df.where("novel_id IS NOT NULL")
    return df.select(*columns) if columns else df


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return read_novels(spark, folder, ["novel_id", "title", "created_at"])


def folder_name(novel_id: F.Column | str) -> F.Column:
    return F.replace(F.col(novel_id) if isinstance(novel_id, str) else novel_id, F.lit("/"), F.lit("_"))


def write_novels(df: DataFrame, folder: str) -> None:
    """One folder for each novel, with its JSON; only the novels that ``df`` has are replaced, when all is written.
    Of several rows of a novel the one created last is kept."""
    last = df.where("novel_id IS NOT NULL").groupBy("novel_id").agg(F.max_by(F.struct(*[c for c in df.columns if c != "novel_id"]), F.coalesce("created_at", F.lit(""))).alias("r"))
    rows = last.select("novel_id", "r.*").select(*df.columns).withColumn("key", folder_name("novel_id"))
    # a novel is one row, so it is one file wherever it is written
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 1).partitionBy("key").json(folder)


def nested_chapters(novels: DataFrame) -> DataFrame:
    return novels.select("novel_id", F.posexplode("chapters").alias("chapter_index", "c")).select("novel_id", "chapter_index", "c.*")


def nested_summaries(novels: DataFrame) -> DataFrame:
    return novels.select("novel_id", F.posexplode("metadata.summaries.chapters").alias("item_pos", "s")).select("novel_id", "item_pos", "s.*")


def nested_plots(novels: DataFrame) -> DataFrame:
    return novels.select("novel_id", F.posexplode("metadata.summaries.plots").alias("plot_index", "p")).select("novel_id", "plot_index", "p.*")


def write_epub(path: str, title: str, pages: list[tuple[str, str]]) -> None:
    """One EPUB of (title, XHTML) pages, with style, table of contents and reading order."""
    from xml.sax.saxutils import escape

    ids = [f"c{i}" for i in range(len(pages))]
    manifest = "".join(f'<item id="{i}" href="{i}.xhtml" media-type="application/xhtml+xml"/>' for i in ids)
    points = "".join(f'<navPoint id="n{n}" playOrder="{n + 1}"><navLabel><text>{escape(t)}</text></navLabel><content src="{i}.xhtml"/></navPoint>' for n, (i, (t, _)) in enumerate(zip(ids, pages)))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        z.writestr("OEBPS/content.opf", f'<package version="2.0" xmlns="http://www.idpf.org/2007/opf" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(title)}</dc:title><dc:identifier id="id">{escape(title)}</dc:identifier></metadata><manifest><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="css" href="style/default.css" media-type="text/css"/>{manifest}</manifest><spine toc="ncx">' + "".join(f'<itemref idref="{i}"/>' for i in ids) + "</spine></package>")
        z.writestr("OEBPS/toc.ncx", f'<ncx version="2005-1" xmlns="http://www.daisy.org/z3986/2005/ncx/"><head/><docTitle><text>{escape(title)}</text></docTitle><navMap>{points}</navMap></ncx>')
        z.writestr("OEBPS/style/default.css", "body { font-size: 1em; line-height: 1.6; } p { text-indent: 2em; }")
        for i, (_, page) in zip(ids, pages):
            z.writestr(f"OEBPS/{i}.xhtml", page)


def write_cleaned_epubs(pages: DataFrame, folder: str) -> DataFrame:
    """(novel_id, path, n): an EPUB ``<novel>_cleaned.epub`` of each novel's pages (novel_id, title, chapter_no, chapter_title, page), written by the task that has the novel.

    A file is one novel, so its pages meet in one task; the folder must be one that all workers see.
    """
    def write(group):
        import pandas as pd

        group = group.sort_values("chapter_no")
        name = f"{folder}/{str(group['novel_id'].iloc[0]).replace('/', '_')}_cleaned.epub"
        write_epub(name, str(group["title"].iloc[0]), list(zip(group["chapter_title"], group["page"])))
        return pd.DataFrame({"novel_id": [group["novel_id"].iloc[0]], "path": [name], "n": [len(group)]})

    return pages.groupBy("novel_id").applyInPandas(write, "novel_id string, path string, n bigint")
