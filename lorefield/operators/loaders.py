"""Loaders: files, rows, pages, dumps, issues and transcripts become document records."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REQUIRED = ("id", "url", "title", "docAuthor", "description", "docSource", "chunkSource", "published", "wordCount", "token_count_estimate")
DOCUMENT = ", ".join(f"{c} string" for c in (*REQUIRED[:8], "pageContent")) + ", wordCount long, token_count_estimate long"
#: Converters by file extension; other extensions are read as text only if they look like text.
CONVERTERS = {".txt": "text", ".md": "text", ".org": "text", ".adoc": "text", ".rst": "text", ".csv": "text", ".json": "text", ".html": "text", ".mbox": "mbox"}


def listed_documents(spark: SparkSession, path: str, many: bool = False) -> DataFrame:
    """Document files under path/<folder>/*.json without their contents; files that miss a required key are left out. many: a file holds a document on each line."""
    rows = spark.read.schema(DOCUMENT).option("multiLine", not many).json(f"{path}/*/*.json")
    complete = F.lit(True)
    for c in REQUIRED:
        complete = complete & F.col(c).isNotNull()
    return rows.where(complete).withColumn("folder", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)).drop("pageContent")


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """One document for each non-empty text file, with its folder."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    return files.where(F.length("text") > 0).select(F.concat(F.lit("file://"), name).alias("url"), name.alias("title"), F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("folder"), "text")


def looks_like_text(content: Column) -> Column:
    """Fewer than a tenth of the first 1,024 bytes are control characters; NUL counts twice. content: binary."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    n = F.length(head)
    odd = F.regexp_count(head, F.lit(r"[\x00-\x08\x0E-\x1F]")) + F.regexp_count(head, F.lit(r"\x00"))
    return (n > 0) & (odd < 0.1 * n)


def routed(files: DataFrame) -> DataFrame:
    """files (name, content) with converter, or a reason for rejection."""
    ext = F.lower(F.regexp_extract("name", r"(\.[^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in CONVERTERS.items() for x in kv])
    converter = F.coalesce(known[ext], F.when(looks_like_text(F.col("content")), "text"))
    reason = F.when(ext == "", "no extension").when(converter.isNull(), F.concat(F.lit("extension "), ext, F.lit(" is not supported")))
    return files.withColumn("converter", F.when(ext != "", converter)).withColumn("reason", reason)


def raw_text_documents(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with defaulted metadata, and the rows rejected for an empty text or title with their reason."""
    reason = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "text is empty").when(F.coalesce(F.trim("title"), F.lit("")) == "", "title is missing")
    judged = rows.withColumn("reason", reason)
    good = judged.where("reason is null").drop("reason").withColumns({"docAuthor": F.coalesce("author", F.lit("no author specified")), "description": F.coalesce("about", F.lit("no description found"))})
    return good, judged.where("reason is not null")


def csv_cell_of_sheet(value: Column, escape: bool = True) -> Column:
    """A cell, quoted if it holds a comma; null is empty. Quotes inside are doubled unless escape is off."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')) if escape else text, F.lit('"'))
    return F.when(text.contains(","), quoted).otherwise(text)


def sheet_documents(rows: DataFrame, sheet: str, order: str, columns: list[str]) -> DataFrame:
    """sheet, text: the rows of each sheet as CSV lines in order. A sheet is one document, which has to be whole in a row."""
    lines = rows.select(F.col(sheet).alias("sheet"), F.struct(F.col(order).alias("n"), F.concat_ws(",", *[csv_cell_of_sheet(F.col(c)) for c in columns]).alias("line")).alias("row"))
    folded = lines.groupBy("sheet").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return folded.select("sheet", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text")).where(F.length("text") > 0)


def combined_sheets(sheets: DataFrame, book: str) -> DataFrame:
    """All sheets of a book as one document under headers, with the sheets in its title."""
    folded = sheets.groupBy(book).agg(F.array_sort(F.collect_list(F.struct("sheet", "text"))).alias("s"))
    body = F.array_join(F.transform("s", lambda x: F.concat(F.lit("Sheet: "), x["sheet"].cast("string"), F.lit("\n"), x["text"])), "\n\n")
    return folded.select(F.col(book), F.concat(F.lit("Sheets: "), F.array_join(F.transform("s", lambda x: x["sheet"].cast("string")), ", ")).alias("title"), body.alias("text"))


def mail_messages(spark: SparkSession, path: str) -> DataFrame:
    """file, n, title, author, text: one document for each message with a body in mail archives; quoted From lines are unquoted."""
    parts = spark.read.text(path, lineSep="\nFrom ").select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), F.col("value"))
    head, body = F.split_part("value", F.lit("\n\n"), F.lit(1)), F.regexp_replace(F.regexp_replace("value", r"(?s)^.*?\n\n", ""), "(?m)^>From ", "From ")
    rows = parts.select("file", "at", head.alias("head"), F.trim(F.regexp_replace(body, r"\s+$", "")).alias("text")).where(F.col("value").contains("\n\n") & (F.col("text") != ""))
    from .membership import running_place

    numbered = running_place(rows, "file", "at").withColumnRenamed("place", "n")
    subject = F.regexp_extract("head", r"(?m)^Subject: (.*)$", 1)
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    return numbered.select(name.alias("file"), "n", F.when(subject != "", subject).otherwise(F.concat(F.lit("msg_"), "n", F.lit("-"), name)).alias("title"), F.regexp_extract("head", r"(?m)^From: (.*)$", 1).alias("author"), "text")


class _Text(HTMLParser):
    """Visible text of a page: scripts and styles skipped, blocks on lines of their own."""

    BLOCKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article header footer nav blockquote pre".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "template", "noscript", "head"):
            self.skip += tag != "noscript"
        elif tag == "body":
            self.skip = 0
        elif tag in self.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "template", "head"):
            self.skip = max(0, self.skip - 1)
        elif tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def _visible(page: str | None) -> str:
    parser = _Text()
    parser.feed(page or "")
    parser.close()
    lines = (" ".join(x.split()) for x in "".join(parser.out).split("\n"))
    return "\n".join(x for x in lines if x)


def html_to_text(page: Column) -> Column:
    @F.pandas_udf("string")
    def visible(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield batch.map(_visible)
    return visible(page)


def selected_html(page: Column, selector: str) -> Column:
    """Inner HTML of the elements that a tag, .class or #id selector names, joined by line ends; null if there are none. For elements without
    others of their tag inside."""
    name = selector.lstrip(".#")
    mark = rf'\bclass="[^"]*\b{name}\b[^"]*"' if selector[0] == "." else rf'\bid="{name}"' if selector[0] == "#" else ""
    tag = "[a-z][a-z0-9]*" if mark else name
    found = F.regexp_extract_all(page, F.lit(rf"(?s)<({tag})\b[^>]*{mark}[^>]*>(.*?)</\1>"), F.lit(2))
    return F.when(F.size(found) > 0, F.array_join(found, "\n"))


def page_documents(pages: DataFrame) -> DataFrame:
    """Web pages as documents: visible text, title from the URL, and the link; empty ones are left out."""
    from ..functions.text import slug, url_file_name

    made = pages.select("page_id", F.concat(slug(url_file_name(F.col("url"))), F.lit(".html")).alias("title"), F.concat(F.lit("link://"), "url").alias("chunk_source"), html_to_text(F.col("html")).alias("text"))
    return made.where(F.length("text") > 0)


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, link: distinct links of each page, resolved against its URL."""
    href = pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return href.select("page_id", resolved(F.col("url"), F.col("href")).alias("link")).distinct()


def discovered(edges: DataFrame, start: int, max_depth: int, max_links: int) -> DataFrame:
    """node, depth: breadth-first from start over edges (src, dst), up to a depth and a number of links in order of discovery."""
    spark = edges.sparkSession
    seen = frontier = spark.range(1).select(F.lit(start).cast("long").alias("node"), F.lit(0).alias("depth"))
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        frontier = step.withColumn("depth", F.lit(depth)).checkpoint()
        if not frontier.head(1):
            break
        seen = seen.unionByName(frontier)
    return seen.orderBy("depth", "node").limit(max_links)


def site_discovered(pages: DataFrame, start: str, max_depth: int = 1, max_links: int = 20) -> DataFrame:
    """link, depth, place: what a walk over the links of pages (url, html) finds from a start URL, in order of discovery: level by level, pages in the order in which they were found, links in
    their order on the page. Links are resolved against the start, and stay on its origin and in its folder; the start is the first of at most max_links. Each level is one
    join of the frontier with the pages, and a set of seen links is kept by anti-join; a level keeps max_links rows at most, as that is the walk's limit."""
    spark = pages.sparkSession
    links = pages.select("url", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    links = within_site(links.select(F.col("url").alias("page"), "pos", resolved(F.lit(start), F.col("href")).alias("link")), F.lit(start)).select("page", "pos", "link")
    seen = frontier = spark.range(1).select(F.lit(start).alias("link"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("place"))
    count = 1
    for depth in range(1, max_depth + 1):
        found = frontier.select(F.col("link").alias("page"), "place").join(links, "page").groupBy("link").agg(F.min(F.struct("place", "pos")).alias("at"))
        new = found.join(seen.select("link"), "link", "left_anti").orderBy("at").limit(max_links - count)
        order = Window.orderBy("at")  # max_links rows at most
        frontier = new.select("link", F.lit(depth).alias("depth"), (F.row_number().over(order) + count - 1).cast("long").alias("place")).checkpoint()
        more = frontier.count()
        seen, count = seen.unionByName(frontier), count + more
        if not more or count >= max_links:
            break
    return seen


#: What a wiki body's scanner stops at: CDATA sections, which hide whatever they hold, parameters, and the ends of macros.
_MACRO = re.compile(r'<!\[CDATA\[(?P<data>.*?)\]\]>|<ac:parameter\b[^>]*ac:name="(?P<parameter>[^"]*)"[^>]*>(?P<value>[^<]*)</ac:parameter>|(?P<open><ac:structured-macro\b[^>]*>)|(?P<close></ac:structured-macro\s*>)', re.S)


def wiki_text(body: str | None) -> str:
    """Text of a wiki body: code macros fenced with their language and code as it is, wherever they are nested; everything else as visible text, parameters of
    macros left out; three newlines or more become two."""
    out, html, open_macros, at = [], [], [], 0  # open_macros: [is code, language, code] from the outermost
    body = body or ""

    def flush() -> None:
        if seen := _visible("".join(html)):
            out.append(seen)
        html.clear()

    for m in _MACRO.finditer(body):
        inside = open_macros and open_macros[-1][0]
        if not inside:
            html.append(body[at : m.start()])
        at = m.end()
        if m["open"]:
            closed = m["open"].rstrip().endswith("/>")
            if not closed:
                open_macros.append([bool(re.search(r'ac:name="code"', m["open"])), "", ""])
        elif m["close"]:
            code, language, text = open_macros.pop() if open_macros else (False, "", "")
            if code:
                flush()
                out.append(f"```{language}\n{text.strip()}\n```")
        elif m["parameter"] is not None:
            if inside and m["parameter"] == "language":
                open_macros[-1][1] = m["value"].strip()
        elif inside:
            open_macros[-1][2] += m["data"]
        else:
            html.append(escape(m["data"]))
    html.append(body[at:])
    flush()
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def wiki_documents(pages: DataFrame) -> DataFrame:
    """Dump pages (host, space, page_id, modified, title, body) as documents with wiki_text's text; an empty body falls
    back to the title; ids repeat only for unchanged pages, which are kept once."""
    @F.pandas_udf("string")
    def text(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in bodies:
            yield batch.map(wiki_text)

    made = pages.select(F.concat_ws(".", "host", "space", "page_id", "modified").alias("id"), "title", text("body").alias("t"))
    return made.select("id", "title", F.when(F.col("t") != "", F.col("t")).otherwise(F.col("title")).alias("text")).dropDuplicates(["id"])


def vault_notes(files: DataFrame, blank: bool = False) -> DataFrame:
    """files (path, text) with the vault's root folder, if there is a single one, taken off, and a status; blank notes are skipped, with blank on only those without a text."""
    root = files.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("root")).agg(F.when(F.count_distinct("root") == 1, F.max("root")).alias("root"))
    empty = F.col("text").isNull() if blank else F.trim(F.coalesce("text", F.lit(""))) == ""
    status = F.when(empty, "skipped").otherwise("loaded")
    bare = F.when(F.col("root").isNotNull(), F.regexp_replace("path", "^[^/]+/", "")).otherwise(F.col("path"))
    return files.join(F.broadcast(root), F.lit(True)).select(bare.alias("path"), status.alias("status"), F.length("text").alias("chars"))


def without_ignored(files: DataFrame, patterns: list[str]) -> DataFrame:
    return files.where(~F.col("path").rlike("|".join(patterns))) if patterns else files


def issue_documents(issues: DataFrame, notes: DataFrame) -> DataFrame:
    """iid, text: issues (iid, title, description, state, created, labels) with their notes (iid, n, note) as Markdown; bullets without a value are left out."""
    talk = notes.groupBy("iid").agg(F.array_sort(F.collect_list(F.struct("n", "note"))).alias("notes"))
    bullet = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"- {name}: "), value))
    nested = F.when(F.size("labels") > 0, F.concat(F.lit("- labels:\n"), F.array_join(F.transform("labels", lambda x: F.concat(F.lit("  - "), x)), "\n")))
    meta = F.concat_ws("\n", bullet("state", F.col("state")), bullet("created at", F.col("created")), nested)
    head = F.concat(F.lit("# "), "title", F.lit(" ("), F.col("iid").cast("string"), F.lit(")\n\n"), "description", F.lit("\n\n## Metadata\n\n"), meta)
    activity = F.when(F.col("notes").isNotNull(), F.concat(F.lit("\n\n## Activity\n\n"), F.array_join(F.transform("notes", lambda x: x["note"]), "\n\n"), F.lit("\n"))).otherwise("")
    return issues.join(talk, "iid", "left").select("iid", F.concat(head, activity).alias("text"))


def transcripts(segments: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """key, text: each recording's segments in order, empty ones dropped, white space collapsed."""
    folded = segments.where(F.trim(text) != "").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("s"))
    return folded.select(key, F.trim(F.regexp_replace(F.array_join(F.transform("s", lambda x: x[text]), " "), r"\s+", " ")).alias("text"))


def tagged(content: Column, fields: dict[str, Column]) -> Column:
    return F.concat(content, *[F.when(v.isNotNull(), F.concat(F.lit(f"\n<{k}>"), v, F.lit(f"</{k}>"))).otherwise("") for k, v in fields.items()])


def result_rows(results: DataFrame) -> DataFrame:
    """Rows of search-result pages (page_id, html): title, link and snippet of the first ten entries; an entry that lacks one of them is dropped. The snippet is the text
    after the entry's link."""
    entry = results.select("page_id", F.posexplode(F.slice(F.regexp_extract_all("html", F.lit(r"(?s)<li>(.*?)</li>"), F.lit(1)), 1, 10)).alias("pos", "item"))
    snippet = F.trim(F.regexp_replace(F.regexp_replace("item", r"(?s)^.*?</a>", ""), "<[^>]*>", ""))
    made = entry.select("page_id", "pos", F.regexp_extract("item", 'href="([^"]+)"', 1).alias("link"), F.regexp_extract("item", r">([^<]+)</a>", 1).alias("title"), snippet.alias("snippet"))
    return made.where("link <> '' and title <> '' and snippet <> ''")


def within_site(links: DataFrame, start: str | Column) -> DataFrame:
    """links (url, link) that stay on the origin and under the path of a column of start URLs."""
    origin = F.regexp_extract(start, r"^(https?://[^/]+)", 1)
    prefix = F.regexp_replace(F.regexp_extract(start, r"^https?://[^/]+([^?#]*)", 1), "[^/]*$", "")
    return links.where(F.startswith("link", F.concat(origin, F.when(prefix == "", F.lit("/")).otherwise(prefix))) | (F.col("link") == origin))


def resolved(url: Column, href: Column) -> Column:
    """A link against the URL of its page: absolute, from the root, or beside the page; fragments are cut."""
    bare = F.regexp_replace(href, "#.*$", "")
    origin, folder = F.regexp_extract(url, r"^(https?://[^/]+)", 1), F.regexp_extract(url, r"^(https?://[^/]+(?:/[^?#]*/|/)?)", 1)
    beside = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    return F.when(bare.rlike("^https?://"), bare).when(F.startswith(bare, F.lit("//")), F.concat(F.regexp_extract(url, "^(https?:)", 1), bare)).when(F.startswith(bare, F.lit("/")), F.concat(origin, bare)).otherwise(F.concat(beside, bare))


def archive_documents(rows: DataFrame) -> DataFrame:
    """Documents of an archive (id, title, content, tags, correspondent, created) as records: HTML to text, tags and correspondent as metadata, empty ones dropped."""
    text = F.trim(F.when(F.col("content").contains("<"), html_to_text(F.col("content"))).otherwise(F.col("content")))
    made = rows.select("id", "title", text.alias("text"), F.array_join("tags", ", ").alias("tags"), F.coalesce("correspondent", F.lit("Unknown")).alias("docAuthor"), F.col("created").alias("published"))
    return made.where(F.length("text") > 0)


def repository_documents(issues: DataFrame, pages: DataFrame, files: DataFrame) -> DataFrame:
    """Issues (iid, text), wiki pages (slug, content) and files (path, content) of a repository in one shape: kind, source, text; empty ones dropped."""
    one = lambda df, kind, source, text: df.select(F.lit(kind).alias("kind"), F.concat(F.lit(f"{kind}-"), F.col(source).cast("string")).alias("source"), F.col(text).alias("text"))
    return one(issues, "issue", "iid", "text").unionByName(one(pages, "wiki", "slug", "content")).unionByName(one(files, "file", "path", "content")).where(F.length(F.trim("text")) > 0)


def run_query(spark: SparkSession, sql: str) -> tuple[DataFrame | None, int, str | None]:
    """The rows of a query over registered views, their number, and the error if it has one."""
    try:
        rows = spark.sql(sql)
        return rows, rows.count(), None
    except Exception as error:  # the caller reports any engine's error
        return None, 0, str(error).split("\n")[0]


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """table, place, column, kind, rows, nulls: the columns of tables."""
    out = None
    for name, df in tables.items():
        counts = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])  # one row
        kind = {c: "number" if k in ("bigint", "int", "double", "float") else "time" if k.startswith("timestamp") else "text" if k == "string" else "other" for c, k in df.dtypes}
        columns = F.array(*[F.struct(F.lit(name).alias("table"), F.lit(i + 1).cast("long").alias("place"), F.lit(c).alias("column"), F.lit(kind[c]).alias("kind"), F.col("rows"), F.col(c).alias("nulls")) for i, c in enumerate(df.columns)])
        made = counts.select(F.inline(columns))
        out = made if out is None else out.unionByName(made)
    return out


def declared_columns(spark: SparkSession, table: str) -> DataFrame:
    """place, column, type, default, nullable of a table as the catalogue has them; default is the declared expression's text, null without one."""
    described = spark.sql(f"describe table extended {table} as json")  # one row
    kind = "columns array<struct<name string, type struct<name string>, nullable boolean, default string>>"
    rows = described.select(F.posexplode(F.from_json("json_metadata", kind)["columns"]).alias("n", "c"))
    return rows.select((F.col("n") + 1).cast("long").alias("place"), F.col("c.name").alias("column"), F.col("c.type.name").alias("type"), F.col("c.default").alias("default"), F.col("c.nullable").alias("nullable"))
