"""Readers: JSON corpora, HTML sections, image and page metadata."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as tx


def json_rows(spark: SparkSession, path: str, subset: int = 0, schema: str | None = None, order: str | None = None) -> DataFrame:
    """A JSON array or JSON lines; ``subset`` > 0 takes that many rows, in the order of ``order`` if given."""
    reader = spark.read.option("multiLine", True)
    rows = (reader.schema(schema) if schema else reader).json(path)
    if subset:
        rows = (rows.orderBy(order) if order else rows).limit(subset)
    return rows


QA_SCHEMA = "_id string, type string, question string, context string, supporting_facts string, answer string"


def qa_rows(spark: SparkSession, path: str) -> DataFrame:
    """QA samples: question, answer, evidence array<struct<title, idx>> and context array<struct<title, sentences>>.

    Their pairs hold values of two kinds, so they are read as text and projected.
    """
    raw = json_rows(spark, path, schema=QA_SCHEMA)
    facts = F.from_json("supporting_facts", "array<array<string>>")
    pairs = F.from_json("context", "array<array<string>>")
    return raw.select(
        "question",
        "answer",
        F.transform(facts, lambda p: F.struct(p[0].alias("title"), p[1].cast("int").alias("idx"))).alias("evidence"),
        F.transform(pairs, lambda p: F.struct(p[0].alias("title"), F.from_json(p[1], "array<string>").alias("sentences"))).alias("context"),
    )


def passages(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """(title, text, seq) of distinct texts: sentences joined by newlines; the last title wins, the first place stays."""
    each = rows.select(F.col(seq).alias("_row"), F.posexplode("context").alias("_pos", "_c"))
    place = F.struct("_row", "_pos")
    text = F.array_join(F.col("_c.sentences"), "\n")
    return each.groupBy(text.alias("text")).agg(F.max_by(F.col("_c.title"), place).alias("title"), F.min(place).alias("seq")).select("title", "text", "seq")


def documents(rows: DataFrame, content: str = "full_content", title: str = "original_filename") -> DataFrame:
    """Flow corpus: content and title, missing ones as empty text."""
    return rows.select(F.coalesce(F.col(content), F.lit("")).alias("content"), F.create_map(F.lit("title"), F.coalesce(F.col(title), F.lit(""))).alias("metadata"))


def existing_images(spark: SparkSession, metadata: DataFrame, folder: str) -> DataFrame:
    """Image rows whose file ``<file_name>.png`` is there: (path, caption, image_url)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder).select("path", F.regexp_extract("path", r"([^/]+)\.png$", 1).alias("file_name"))
    return metadata.join(files, "file_name").select("path", "caption", "image_url")


def caption(figcaption: Column, url: Column) -> Column:
    """The caption, or what the image's file is called, underscores as spaces."""
    stem = F.element_at(F.split(F.element_at(F.split(url, "/"), -1), r"\."), 1)
    return F.coalesce(F.nullif(tx.strip(figcaption), F.lit("")), F.translate(stem, "_", " "))


def html_files(spark: SparkSession, folder: str) -> DataFrame:
    """(source, html) of all ``*.html`` below a folder."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").text(folder)
    return rows.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source"), F.col("value").alias("html"))


_HEADERS = frozenset(f"h{i}" for i in range(1, 5))


class _Sections(HTMLParser):
    """Headers h1-h4 open a section; text of p, span and a is a line each, pre is fenced; images are listed."""

    def __init__(self, tag: str, attrs: dict[str, str]):
        super().__init__(convert_charrefs=True)
        self.want, self.attrs = tag, attrs
        self.depth, self.found = 0, False
        self.open: list[tuple[str, list[str]]] = []
        self.items: list[tuple[str, str]] = []
        self.images: list[list] = []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if not self.depth and not self.found and tag == self.want and all(v in (given.get(k) or "").split() or given.get(k) == v for k, v in self.attrs.items()):
            self.depth, self.found = 1, True
            return
        if self.depth and tag == self.want:
            self.depth += 1
        if self.depth and tag == "img":
            self.images.append([given.get("src") or "", None])
            self.items.append(("img", given.get("src") or ""))
        elif self.depth and (tag in _HEADERS or tag in ("p", "span", "a", "pre", "figcaption")):
            at = len(self.items)
            self.items.append((tag, ""))
            self.open.append((tag, [at, []]))

    def handle_endtag(self, tag):
        if self.depth and tag == self.want:
            self.depth -= 1
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                at, parts = self.open.pop(i)[1]
                self.items[at] = (tag, "".join(parts))
                if tag == "figcaption":
                    for im in self.images:
                        im[1] = im[1] if im[1] is not None else "".join(parts)
                break

    def handle_data(self, data):
        if self.depth:
            for _, (_, parts) in self.open:
                parts.append(data)


def split_html(html: str | None, tag: str = "article", attrs: dict[str, str] | None = None) -> list[dict]:
    """Sections of the body element: header, content, images. No body, or no header, gives none."""
    p = _Sections(tag, attrs or {})
    p.feed(html or "")
    p.close()
    out: list[dict] = []
    for kind, text in p.items:
        if kind in _HEADERS:
            out.append({"header": text, "content": "", "images": []})
        elif out and kind == "pre":
            out[-1]["content"] += f"```{text.strip()}```\n"
        elif out and kind == "img":
            out[-1]["images"].append(text)
        elif out and kind in ("p", "span", "a"):
            out[-1]["content"] += text.strip() + "\n"
    return [s for s in out if s["content"].strip()]


def html_sections(pages: DataFrame, source: str = "url", html: str = "html", tag: str = "article", attrs: dict[str, str] | None = None) -> DataFrame:
    """(source, pos, header, content, images) for every section of every page."""

    def run(batches):
        for pdf in batches:
            rows = [(s, i, x["header"], x["content"], x["images"]) for s, h in zip(pdf["source"], pdf["html"]) for i, x in enumerate(split_html(h, tag, attrs))]
            yield pd.DataFrame(rows, columns=["source", "pos", "header", "content", "images"])

    narrow = pages.select(F.col(source).cast("string").alias("source"), F.col(html).alias("html"))
    return narrow.mapInPandas(run, "source string, pos int, header string, content string, images array<string>")


def headings(html: Column) -> Column:
    """Texts of h1-h4, without markup, as a Column."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h[1-4][^>]*>(.*?)</h[1-4]>"), 1), lambda h: tx.strip(F.regexp_replace(h, "<[^>]+>", "")))


def articles(sections: DataFrame) -> DataFrame:
    """(source, text): a page's sections in order, header and text on lines of their own."""
    part = F.struct("pos", F.concat_ws("\n", "header", "content").alias("t"))
    return sections.groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda s: s["t"]), "\n").alias("text"))


def page_slice(pages: DataFrame, start: int = 0, end: int | None = None, page: str = "page_no") -> DataFrame:
    """Pages from start to end inclusive; an end that is negative or past the last page is the last."""
    out = pages.filter(F.col(page) >= start)
    return out if end is None or end < 0 else out.filter(F.col(page) <= end)


def parse_inputs(files: DataFrame, default: str = "ch") -> DataFrame:
    """Inputs of a page parser: a path is needed, the language defaults."""
    return files.withColumn("lang", F.coalesce("lang", F.lit(default))).withColumn("path", F.when(F.assert_true(F.col("path").isNotNull(), "a file has no path").isNull(), F.col("path")))
