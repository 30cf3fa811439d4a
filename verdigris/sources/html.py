"""Articles and links from HTML pages, and text headers, in Arrow batches with the standard parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEPT = {"p", "h2", "h3", "h4", "li", "blockquote"}
VOID = {"br", "img", "hr", "meta", "link", "input", "source", "area", "base", "col", "embed", "wbr"}
SKIPPED = {"script", "style", "noscript"}


class _Article(HTMLParser):
    """Blocks of text inside the best container: article, then main, then the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.title, self.date = "", ""
        self.blocks: list[tuple[int, str, str]] = []
        self.open: list[tuple[str, list[str], int]] = []
        self.heading: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "time" and not self.date:
            self.date = attrs.get("datetime") or ""
        if tag == "meta" and attrs.get("property") == "article:published_time":
            self.date = attrs.get("content") or self.date
        if tag in VOID:
            return
        self.stack.append(tag)
        if tag == "h1" and not self.title:
            self.heading = []
        if tag in KEPT:
            self.open.append((tag, [], 2 if "article" in self.stack else 1 if "main" in self.stack else 0))

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack and self.stack.pop() != tag:
                pass
        if tag == "h1" and self.heading is not None:
            self.title, self.heading = " ".join("".join(self.heading).split()), None
        if self.open and self.open[-1][0] == tag:
            _, parts, rank = self.open.pop()
            text = " ".join("".join(parts).split())
            if len(text) > 10:
                self.blocks.append((rank, tag, text))

    def handle_data(self, data):
        if SKIPPED.intersection(self.stack):
            return
        if self.heading is not None:
            self.heading.append(data)
        if self.open:
            self.open[-1][1].append(data)

    def body(self) -> str:
        best = max((r for r, _, _ in self.blocks), default=0)
        out = []
        for rank, tag, text in self.blocks:
            if rank == best:
                out.append(f"\n## {text}\n" if tag[0] == "h" else f"> {text}" if tag == "blockquote" else text)
        return "\n\n".join(out)


class _Links(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        href = dict(attrs).get("href")
        if tag == "a" and href:
            self.found.append(href)


def parse(html: str | None) -> tuple[str, str, str]:
    """(title, date, body) of a page."""
    p = _Article()
    p.feed(html or "")
    p.close()
    return p.title, p.date, p.body()


def articles(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, title, date, body) of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [parse(x) for x in b["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["key"], *(pa.array([r[i] for r in rows], pa.string()) for i in range(3))], names=["key", "title", "date", "body"])

    rows = pages.select(F.col(key).alias("key"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(run, "key long, title string, date string, body string").withColumnRenamed("key", key)


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, target): absolute links of each page, once each, in no order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for base, text in zip(b["url"].to_pylist(), b["html"].to_pylist(), strict=True):
                p = _Links()
                p.feed(text or "")
                out += [(base, urljoin(base or "", x)) for x in dict.fromkeys(p.found)]
            yield pa.RecordBatch.from_pydict({"url": pa.array([u for u, _ in out], pa.string()), "target": pa.array([t for _, t in out], pa.string())})

    return pages.select(F.col(url).alias("url"), F.col(html).cast("string").alias("html")).mapInArrow(run, "url string, target string")


def article_links(found: DataFrame, pattern: str, excluded: list[str]) -> DataFrame:
    """(target): links that match and hold none of ``excluded``, once each, from the smallest page url."""
    bad = F.lit(False)
    for x in excluded:
        bad = bad | F.col("target").contains(x)
    rows = found.where(F.col("target").rlike(pattern) & ~bad)
    return rows.withColumn("n", F.row_number().over(W.partitionBy("target").orderBy("url"))).where("n = 1").select("target", "url")


#: What ends a line of a text file.
LINE_ENDS = "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]"


def _opening(lines: Column) -> tuple[Column, Column]:
    """Lines before the one that ends the headers, and the number of the body's first line: after a rule of ten marks, or a first line that is neither blank nor begins with ``#``; without either the first of all."""
    bare = lambda x: F.regexp_replace(x, "^\\s+|\\s+$", "")
    found = F.transform(lines, lambda x, i: F.when(x.rlike("^(?:={10}|-{10})"), F.struct(i.alias("i"), (i + 1).alias("body"))).when(~x.startswith("#") & (bare(x) != ""), F.struct(i.alias("i"), i.alias("body"))))
    first = F.get(F.filter(found, lambda f: f.isNotNull()), F.lit(0))
    return F.when(first.isNull(), lines).otherwise(F.slice(lines, F.lit(1), first["i"])), F.coalesce(first["body"], F.lit(0))


def headers(text: Column | str, names: list[str]) -> Column:
    """Map of ``# Name: value`` lines before the body, by lower-case names; of several the last."""
    x = F.col(text) if isinstance(text, str) else text
    lines, _ = _opening(F.split(x, LINE_ENDS))

    def value(name: str) -> Column:
        own = F.filter(lines, lambda line: line.startswith(f"# {name}:"))
        last = F.get(own, F.size(own) - 1)
        return F.regexp_replace(F.replace(last, F.lit(f"# {name}:"), F.lit("")), "^\\s+|\\s+$", "")

    pairs = [F.struct(F.lit(n.lower()).alias("k"), value(n).alias("v")) for n in names]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull()))


def body_after_headers(text: Column | str) -> Column:
    """The lines from the body's first on, without white space around them."""
    x = F.col(text) if isinstance(text, str) else text
    lines = F.split(x, LINE_ENDS)
    _, start = _opening(lines)
    return F.regexp_replace(F.array_join(F.slice(lines, start + 1, F.greatest(F.size(lines) - start, F.lit(0))), "\n"), "^\\s+|\\s+$", "")


def documents(spark, path: str) -> DataFrame:
    """(source_file, text): whole text files below a folder, without NUL characters."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text"))
    return rows.withColumn("text", F.translate("text", "\x00", ""))


def playlist(lines: DataFrame, column: str = "value") -> DataFrame:
    """(id, title, index) from ``id|||title|||index`` lines."""
    parts = F.split(F.col(column), "\\|\\|\\|")
    return lines.where(F.size(parts) == 3).select(parts[0].alias("id"), parts[1].alias("title"), F.expr(f"try_cast(split({column}, '\\\\|\\\\|\\\\|')[2] as int)").alias("index"))


def transcript(rows: DataFrame) -> DataFrame:
    """(id, text): the manual captions of a video, else the generated ones, joined; from (id, kind, seq, text)."""
    best = rows.groupBy("id").agg(F.min(F.when(F.col("kind") == "manual", 0).otherwise(1)).alias("best"))
    kept = rows.join(best, "id").where(F.when(F.col("kind") == "manual", 0).otherwise(1) == F.col("best"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda r: r["text"]), " ")
    return kept.groupBy("id").agg(F.regexp_replace(text, "\\s+", " ").alias("text"))


def paged_text(rows: DataFrame) -> DataFrame:
    """(doc, text): non-blank pages under page marks, from (doc, page, text)."""
    line = F.concat(F.lit("--- PAGE "), F.col("page"), F.lit(" ---\n"), F.col("text"))
    kept = rows.where(F.trim("text") != "")
    return kept.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", line.alias("l")))), lambda r: r["l"]), "\n\n").alias("text"))
