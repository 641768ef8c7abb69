"""Document loaders: each returns rows (id, content, source, loader, created_at, ...).

ids are made from the source and the place in it, so loading twice gives equal ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx


def _finish(df: DataFrame, loader: str, place: Column | None = None) -> DataFrame:
    key = F.concat_ws("\u0001", F.col("source"), place.cast("string") if place is not None else F.lit("0"))
    return df.withColumns({"id": F.sha2(key, 256), "loader": F.lit(loader), "created_at": F.current_timestamp()})


def _whole(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    if encoding.lower().replace("-", "") == "utf8":
        return spark.read.text(path, wholetext=True).select(F.col("value").alias("content"), F.input_file_name().alias("source"))
    return spark.read.format("binaryFile").load(path).select(F.decode("content", encoding).alias("content"), F.col("path").alias("source"))


def load_text(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """A document a file."""
    return _finish(_whole(spark, path, encoding), "text")


def split_markdown(df: DataFrame, level: int = 1, content: str = "content") -> DataFrame:
    """Rows cut at headings of exactly `level`: heading, section_index, content.

    Text before the first heading has the heading (preamble), a text without any (full).
    """
    mark = f"(?m)(?=^#{{{level}}}\\s+\\S)"
    parts = F.filter(F.split(F.col(content), mark), lambda x: F.length(tx.trim(x)) > 0)
    d = df.withColumn("_parts", F.when(F.size(parts) > 0, parts).otherwise(F.array(F.col(content))))
    d = d.select("*", F.posexplode("_parts").alias("section_index", "_part"))
    # by \n alone: other line ends are part of a heading's text
    own = F.regexp_extract("_part", f"^#{{{level}}}\\s+([^\\n]+)", 1)
    heading = F.when(F.length(own) > 0, tx.trim(own)).when(F.size("_parts") > 1, "(preamble)").otherwise("(full)")
    body = F.when(F.length(own) > 0, F.regexp_replace("_part", "^[^\\n]*\\n?", "")).otherwise(F.col("_part"))
    return d.withColumn("heading", heading).withColumn(content, tx.trim(body)).drop("_parts", "_part")


def load_markdown(spark: SparkSession, path: str, split_by_heading: bool = False, heading_level: int = 1) -> DataFrame:
    d = _whole(spark, path, "utf-8")
    if not split_by_heading:
        return _finish(d, "markdown")
    d = split_markdown(d, heading_level)
    return _finish(d, "markdown", F.col("section_index"))


def split_pages(df: DataFrame, content: str = "content") -> DataFrame:
    """Rows cut at form feeds, blank pages dropped: page_number (from 1), total_pages."""
    pages = F.filter(F.split(F.col(content), "\f"), lambda x: F.length(tx.trim(x)) > 0)
    d = df.withColumn("_pages", pages).withColumn("total_pages", F.size("_pages"))
    d = d.select("*", F.posexplode("_pages").alias("_i", "_page"))
    return d.withColumn("page_number", F.col("_i") + 1).withColumn(content, tx.trim(F.col("_page"))).drop("_pages", "_i", "_page")


def load_pdf(spark: SparkSession, path: str, split_by_page: bool = True) -> DataFrame:
    """Text of PDF files, a row a page or a file. Needs the optional package pypdf."""
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise RuntimeError("load_pdf needs the package pypdf") from e

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pypdf

        for pdf in batches:
            rows = []
            for source, body in zip(pdf["path"], pdf["content"]):
                r = pypdf.PdfReader(io.BytesIO(body))
                info = r.metadata or {}
                rows.append(("\f".join(p.extract_text() or "" for p in r.pages), source, info.get("/Title"), info.get("/Author"), len(r.pages)))
            yield pd.DataFrame(rows, columns=["content", "source", "title", "author", "page_count"])

    d = spark.read.format("binaryFile").load(path).select("path", "content")
    d = d.mapInPandas(run, "content string, source string, title string, author string, page_count int")
    return _finish(split_pages(d), "pdf", F.col("page_number")) if split_by_page else _finish(d, "pdf")


def _at(value, path: str):
    for key in filter(None, path.split(".")):
        if isinstance(value, list) and key.isdigit() and int(key) < len(value):
            value = value[int(key)]
        elif isinstance(value, dict) and key in value:
            value = value[key]
        else:
            return None, False
    return value, True


def extract_json(df: DataFrame, content_path: str = "", metadata_paths: tuple[str, ...] = (), content: str = "content") -> DataFrame:
    """JSON texts -> rows (source, item_index, content, metadata as JSON).

    A list at `content_path` gives a row an element; values that are not strings are printed with two
    blanks of indent. Metadata has the paths that exist in the element, else in the document.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for source, body in zip(pdf["source"], pdf["content"]):
                whole = json.loads(body)
                value, found = _at(whole, content_path)
                if not found:
                    continue
                for i, x in enumerate(value if isinstance(value, list) else [value]):
                    meta = {}
                    for p in metadata_paths:
                        for root in (x, whole):
                            v, ok = _at(root, p)
                            if ok:
                                meta[p] = v
                                break
                    rows.append((source, i, x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, indent=2), json.dumps(meta, ensure_ascii=False)))
            yield pd.DataFrame(rows, columns=["source", "item_index", "content", "metadata"])

    return df.select("source", F.col(content).alias("content")).mapInPandas(run, "source string, item_index int, content string, metadata string")


def load_json(spark: SparkSession, path: str, content_path: str = "", metadata_paths: tuple[str, ...] = ()) -> DataFrame:
    return _finish(extract_json(_whole(spark, path, "utf-8"), content_path, metadata_paths), "json", F.col("item_index"))


def load_csv(spark: SparkSession, path: str, delimiter: str = ",", content_columns: tuple[str, ...] = (), header: bool = True) -> DataFrame:
    """A row a record; content: the chosen (or all) columns, a line each; `metadata` maps every
    column. Without a header columns are col_0, col_1, ... Line ends inside quotes are kept."""
    d = spark.read.csv(
        path, sep=delimiter, header=header, escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, nullValue="\u0000"
    )
    if not header:
        d = d.toDF(*[f"col_{i}" for i in range(len(d.columns))])
    names = list(d.columns)
    chosen = list(content_columns) or names
    quoted = [F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in names]
    meta = F.create_map(*[x for n, c in zip(names, quoted) for x in (F.lit(n), c)])
    body = F.concat_ws("\n", *[F.col(f"`{n}`") for n in chosen if n in names])
    d = d.select(body.alias("content"), meta.alias("metadata"), F.input_file_name().alias("source"))
    return _finish(d, "csv", F.concat_ws("\u0001", "content", F.map_values("metadata")))


#: Elements whose text is no content, fixed values.
DROPPED = ("script", "style", "nav", "footer", "header", "aside")
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


class _Page(HTMLParser):
    def __init__(self, selector: str):
        super().__init__(convert_charrefs=True)
        self.selector, self.stack, self.text, self.alts = selector, [], [], []
        self.title, self.h1, self.meta = "", None, {}

    def _inside(self) -> bool:
        s = self.selector
        hit = any(t == s or s[:1] == "#" and i == s[1:] or s[:1] == "." and s[1:] in c for t, i, c in self.stack)
        return hit and not any(t in DROPPED for t, _, _ in self.stack)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and a.get("name", "").lower() in ("description", "keywords"):
            self.meta[a["name"].lower()] = a.get("content", "")
        if tag == "img" and a.get("alt") and self._inside():
            self.alts.append(a["alt"])
        if tag not in _VOID:
            self.stack.append((tag, a.get("id", ""), a.get("class", "").split()))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        tags = [t for t, _, _ in self.stack]
        if "title" in tags:
            self.title += data
        elif self._inside():
            self.text.append(data)
            if "h1" in tags and self.h1 is None:
                self.h1 = data


def extract_html(df: DataFrame, selector: str = "body", include_image_alt: bool = False, html: str = "html") -> DataFrame:
    """Adds title, content, description, keywords of an HTML column.

    content: text under the elements of `selector` (a tag, #id or .class) without scripts, styles
    and page furniture, white space collapsed; title: <title>, else the first h1.
    """

    @F.pandas_udf("title string, content string, description string, keywords string")
    def run(pages: pd.Series) -> pd.DataFrame:
        rows = []
        for body in pages:
            p = _Page(selector)
            p.feed(body or "")
            p.close()
            text = " ".join(" ".join([*p.text, *(p.alts if include_image_alt else [])]).split())
            rows.append((" ".join((p.title or p.h1 or "").split()), text, p.meta.get("description"), p.meta.get("keywords")))
        return pd.DataFrame(rows, columns=["title", "content", "description", "keywords"])

    return df.withColumn("_p", run(html)).select("*", "_p.*").drop("_p")


def html_text(c: Column) -> Column:
    """The same text by patterns alone, for pages without nested furniture."""
    for tag in DROPPED:
        c = F.regexp_replace(c, f"(?is)<{tag}\\b.*?</{tag}\\s*>", " ")
    body = F.regexp_extract(c, "(?is)<body[^>]*>(.*)</body>", 1)
    body = F.when(F.length(body) > 0, body).otherwise(c)
    plain = F.regexp_replace(body, "<[^>]+>", " ")
    for entity, text in tx.ENTITIES:
        plain = F.replace(plain, F.lit(entity), F.lit(text))
    return tx.collapse(plain)


def html_title(c: Column) -> Column:
    own = F.regexp_extract(c, "(?is)<title[^>]*>(.*?)</title>", 1)
    return tx.collapse(F.when(F.length(own) > 0, own).otherwise(F.regexp_extract(c, "(?is)<h1[^>]*>(.*?)</h1>", 1)))


def load_web(spark: SparkSession, urls: list[str], selector: str = "body", include_image_alt: bool = False, timeout: float = 30.0) -> DataFrame:
    """Pages fetched by the executors, a row a URL; `extract_html` takes stored pages instead.

    A page that cannot be had is a row with `error` set and null title and content; the others are not touched by it.
    """

    @F.pandas_udf("html string, error string")
    def fetch(u: pd.Series) -> pd.DataFrame:
        import urllib.request

        def one(x: str) -> tuple[str | None, str | None]:
            try:
                return urllib.request.urlopen(x, timeout=timeout).read().decode("utf-8", "replace"), None
            except (OSError, ValueError) as e:
                return None, f"{type(e).__name__}: {e}"

        return pd.DataFrame([one(x) for x in u], columns=["html", "error"])

    d = spark.createDataFrame([(u,) for u in urls], "source string").withColumn("_f", fetch("source")).select("source", "_f.*")
    d = extract_html(d, selector, include_image_alt).drop("html")
    for c in ("title", "content"):
        d = d.withColumn(c, F.when(F.col("error").isNull(), F.col(c)))
    return _finish(d, "web")
