"""Text, name, URL and format functions on columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

SEPARATORS = ("\n\n", "\n", " ", "")


def pieces(text: Column) -> Column:
    """Pieces between single spaces; empty ones count, and an empty text has one."""
    return F.size(F.split(text, " ", -1)).cast("long")


def split_text(text: str, size: int = 1000, overlap: int = 20, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most size characters that overlap by about overlap: cut at the first separator that occurs, pieces that are still too
    long at the next ones, then neighbours joined while they fit. A separator stays at the start of the piece after it."""
    if overlap > size:
        raise ValueError(f"overlap {overlap} is larger than size {size}")
    k = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    sep, rest = separators[k], separators[k + 1 :]
    parts = list(text) if not sep else [p if i == 0 else sep + p for i, p in enumerate(text.split(sep))]
    out: list[str] = []
    short: list[str] = []

    def join() -> None:
        window: list[str] = []
        total = 0
        for p in short:
            if window and total + len(p) > size:
                if chunk := "".join(window).strip():
                    out.append(chunk)
                while window and (total > overlap or total + len(p) > size):
                    total -= len(window.pop(0))
            window.append(p)
            total += len(p)
        if chunk := "".join(window).strip():
            out.append(chunk)
        short.clear()

    for p in filter(None, parts):
        if len(p) < size:
            short.append(p)
            continue
        join()
        if rest:
            out.extend(split_text(p, size, overlap, rest))
        else:
            out.append(p)
    join()
    return out


def chunks(text: Column, size: int = 1000, overlap: int = 20, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """Chunks of a text as an array; Arrow batches, one call for each text."""
    if overlap > size:
        raise ValueError(f"overlap {overlap} is larger than size {size}")

    @F.pandas_udf("array<string>")
    def split(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda x: split_text(x, size, overlap, separators) if x else [])
    return split(text)


class TextChunks:
    """Table function: chunk_index and chunk of a text, one row after the other, so that no list of a text's chunks is held in a row."""

    def eval(self, text: str, size: int = 1000, overlap: int = 20, separators: list | None = None) -> Iterator[tuple[int, str]]:
        yield from enumerate(split_text(text, size, overlap, tuple(separators or SEPARATORS)) if text else [])


def register_chunks(spark: SparkSession, name: str = "text_chunks") -> None:
    """Makes the table function known to SQL: select doc_id, c.* from docs, lateral text_chunks(text, 1000, 20) c."""
    spark.udtf.register(name, F.udtf(TextChunks, returnType="chunk_index bigint, chunk string", useArrow=True))


def chunk_header(title: Column, published: Column, chunk_source: Column) -> Column:
    """Metadata block that leads a chunk: null parts are left out; a source only for link:// and youtube://."""
    source = F.when(chunk_source.rlike("^(link|youtube)://"), F.regexp_replace(chunk_source, "^(link|youtube)://", ""))
    lines = F.concat_ws("\n", F.concat(F.lit("sourceDocument: "), title), F.concat(F.lit("published: "), published), F.concat(F.lit("source: "), source))
    return F.when(lines != "", F.concat(F.lit("<document_metadata>\n"), lines, F.lit("\n</document_metadata>\n\n"))).otherwise("")


def without_header(chunk: Column) -> Column:
    return F.when(chunk.contains("<document_metadata>"), F.trim(F.regexp_replace(F.split_part(chunk, F.lit("</document_metadata>"), F.lit(2)), r"^\s+|\s+$", ""))).otherwise(chunk)


def middle_truncated(text: Column, n: int) -> Column:
    """The first and last n characters, with dots between, of texts longer than n."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.left(text, F.lit(n)), F.lit("..."), F.right(text, F.lit(n))))


def slug(text: Column) -> Column:
    """Lower-case words joined by hyphens; + @ . and & become words."""
    for sign, word in (("+", " plus "), ("@", " at "), (".", " dot "), ("&", " and ")):
        text = F.replace(text, F.lit(sign), F.lit(word))
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def store_name(text: Column, prefix: str = "ns") -> Column:
    """Collection name: letters, digits, - and _, 3 to 63 characters, alphanumeric at both ends, no IPv4 address."""
    clean = F.regexp_replace(text, "[^a-zA-Z0-9_-]", "-")
    clean = F.when(clean.rlike("^[^a-zA-Z0-9]"), F.concat(F.lit(f"{prefix}-"), F.substring(clean, 2, 1000))).otherwise(clean)
    clean = F.regexp_replace(F.left(clean, F.lit(63)), "[^a-zA-Z0-9]$", "")
    clean = F.when(F.length(clean) < 3, F.concat(F.lit(f"{prefix}-"), clean)).otherwise(clean)
    return F.when(clean.rlike(r"^\d+\.\d+\.\d+\.\d+$"), F.concat(F.lit("-"), F.substring(clean, 2, 100))).otherwise(clean)


def underscored(text: Column) -> Column:
    """Namespace of letters, digits and underscores, led by ns_."""
    return F.when(text.startswith("ns_"), text).otherwise(F.concat(F.lit("ns_"), F.regexp_replace(text, "[^a-zA-Z0-9_]", "_")))


def without_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r'[<>:"/\\|?*]', "")


def percent(value: Column, decimals: int = 0) -> Column:
    whole = F.floor(value * 100 + 0.5)
    return F.when(value.isNull() | F.isnan(value), "").otherwise(F.concat(F.format_string(f"%.{decimals}f", whole.cast("double")), F.lit("%")))


def file_size(size: Column, units: tuple[str, ...] = ("KiB", "MiB", "GiB", "TiB", "PiB", "EiB", "ZiB", "YiB"), rounded: bool = True) -> Column:
    """Bytes as text: whole below 1,024, else with one decimal in the smallest binary unit in which the rounded number stays below 1,024. With rounded off the number
    itself has to, so that 1,048,575 bytes are 1024.0 KiB."""
    out = None
    for k in reversed(range(len(units))):
        number = F.abs(size) / 1024.0 ** (k + 1)
        tenths = F.floor(number * 10 + 0.5) / 10
        text = F.concat(F.when(size < 0, "-").otherwise(""), F.format_string("%.1f", tenths), F.lit(f" {units[k]}"))
        out = text if out is None else F.when((tenths if rounded else number) < 1024, text).otherwise(out)
    return F.when(F.abs(size) < 1024, F.concat(size.cast("long").cast("string"), F.lit(" B"))).otherwise(out)


def compact(n: Column) -> Column:
    """A whole number in short form: two digits, or all before the decimal point, and K, M, B or T, whichever keeps the rounded number below 1,000."""
    out = None
    for k in reversed(range(5)):
        value = F.abs(n) / 1000.0**k
        rounded = F.when(value < 9.95, F.floor(value * 10 + 0.5) / 10).otherwise(F.floor(value + 0.5).cast("double"))
        digits = F.when(rounded >= 10_000, with_commas(rounded)).otherwise(F.regexp_replace(F.format_string("%.1f", rounded), r"\.0$", ""))
        text = F.concat(F.when(n < 0, "-").otherwise(""), digits, F.lit(("", "K", "M", "B", "T")[k]))
        out = text if out is None else F.when(rounded < 1000, text).otherwise(out)
    return out


def with_commas(n: Column) -> Column:
    return F.regexp_replace(n.cast("long").cast("string"), r"\B(?=(\d{3})+(?!\d))", ",")


def duration(ms: Column) -> Column:
    """Milliseconds as hours, minutes and seconds; parts that are zero are left out."""
    h, m, s = F.floor(ms / 3_600_000), F.floor(ms % 3_600_000 / 60_000), ms % 60_000 / 1000.0
    return F.concat(F.when(h >= 1, F.concat(h.cast("string"), F.lit("h "))).otherwise(""), F.when(m >= 1, F.concat(m.cast("string"), F.lit("m "))).otherwise(""), F.when(s >= 0.01, F.concat(F.format_string("%.2f", s), F.lit("s"))).otherwise(""))


def expanded(template: Column, variables: dict[str, Column]) -> Column:
    """{key} replaced in one pass, so that braces in a value stay: known keys by their values, user.* and workspace.* without a value by a placeholder, others left alone."""
    def one(piece: Column) -> Column:
        out = F.regexp_replace(piece, r"^\{user\.([^}.]+)[^}]*\}$", "[User $1]")
        out = F.regexp_replace(out, r"^\{workspace\.([^}.]+)[^}]*\}$", "[Workspace $1]")
        for key, value in variables.items():
            out = F.when((piece == F.lit("{" + key + "}")) & value.isNotNull(), value).otherwise(out)
        return out

    return F.array_join(F.transform(F.regexp_extract_all(template, F.lit(r"(?s)(\{[^{}]*\}|[^{]+|\{)")), one), "")


def commands_expanded(message: Column, presets: dict[str, str]) -> Column:
    """/reset if the message starts with it; else preset commands that stand as words give way to their prompts, whatever characters either has."""
    out = message
    for command, prompt in presets.items():
        out = F.regexp_replace(out, rf"(?:\b\s|^){re.escape(command)}(?:\b\s|$)", prompt.replace("\\", "\\\\").replace("$", "\\$"))
    return F.when(F.lower(message).startswith("/reset"), "/reset").otherwise(out)


def mentions(message: Column) -> Column:
    """Words that start with @, of messages that start with @agent."""
    return F.when(message.startswith("@agent"), F.filter(F.split(message, r"\s+"), lambda w: w.startswith("@"))).otherwise(F.array().cast("array<string>"))


def json_path(json: Column, path: Column) -> Column:
    """Value at a path such as a.b[0]['key']; empty for an empty path or text."""
    dotted = F.regexp_replace(path, r"\['([^']+)'\]", ".$1")
    return F.when((F.length(path) == 0) | (F.length(json) == 0), "").otherwise(F.call_function("get_json_object", json, F.concat(F.lit("$."), dotted)))


def batches(array: Column, n: int) -> Column:
    """The array in slices of n."""
    return F.when(F.size(array) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / n).cast("int")), lambda i: F.slice(array, i * n + 1, F.lit(n))))


# ---- URLs ----

def valid_url(url: Column) -> Column:
    """http(s) URLs whose host isn't a private IPv4 address; 127.0.0.1 and 0.0.0.0 are allowed."""
    host = F.regexp_extract(url, r"^https?://([^/:?#]+)", 1)
    private = host.rlike(r"^(192|172|10|127)\.\d+\.\d+\.\d+$") & ~host.isin("127.0.0.1", "0.0.0.0")
    return F.coalesce((host != "") & ~private, F.lit(False))


def normal_url(url: Column) -> Column:
    """Trimmed, with https:// if there is no scheme, without one trailing slash."""
    url = F.trim(url)
    url = F.when(url.rlike("^[a-zA-Z]+://"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.regexp_replace(url, "/$", "")


def url_file_name(url: Column) -> Column:
    host, path = F.regexp_extract(url, r"^https?://([^/?#]+)", 1), F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)
    return F.concat(host, F.replace(F.coalesce(F.try_url_decode(path), path), F.lit("/"), F.lit("_")))


def video_id(url: Column) -> Column:
    return F.regexp_extract(url, r"(?:youtu\.be/|youtube\.com/(?:watch\?(?:.*&)?v=|embed/|v/|shorts/))([A-Za-z0-9_-]{11})", 1)


def link_kind(url: Column, mime: Column) -> Column:
    return F.when(video_id(url) != "", "youtube").when(mime.isNull() | mime.startswith("text/html"), "web").otherwise("file")


def source_parts(chunk_source: Column) -> tuple[Column, Column]:
    """Type and source at the first ://; queries are stripped for confluence and github."""
    at = F.instr(chunk_source, "://")
    kind = F.when(at > 0, F.left(chunk_source, at - 1))
    source = F.when(at > 0, F.substr(chunk_source, at + 3)).otherwise(chunk_source)
    return kind, F.when(kind.isin("confluence", "github"), F.regexp_replace(source, r"\?.*$", "")).otherwise(source)


def deep_without_controls(value: Column, kind: ST.DataType) -> Column:
    """without_controls for all texts inside a nested value of the given type; other values stay."""
    if isinstance(kind, ST.StringType):
        return without_controls(value)
    if isinstance(kind, ST.ArrayType):
        return F.transform(value, lambda x: deep_without_controls(x, kind.elementType))
    if isinstance(kind, ST.MapType):
        return F.transform_values(value, lambda k, x: deep_without_controls(x, kind.valueType))
    if isinstance(kind, ST.StructType):
        return F.when(value.isNotNull(), F.struct(*[deep_without_controls(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return value


def normal_path(path: Column) -> Column:
    """A path without empty and single-dot parts; two dots take the part before them, and none above the root."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & (x != "."))
    up = lambda kept, x: F.when(x != "..", F.concat(kept, F.array(x))).otherwise(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")


def is_within(folder: Column, path: Column) -> Column:
    """Whether a normal path lies inside a folder (the folder itself doesn't)."""
    return F.startswith(path, F.concat(folder, F.lit("/")))


def time_variables(at: Column | None = None) -> dict[str, Column]:
    """The time variables of a prompt, at the current time unless another is given."""
    at = F.current_timestamp() if at is None else at
    day = F.date_format(at, "MMMM d, yyyy")
    return {"time": F.date_format(at, "h:mm:ss a"), "date": day, "datetime": F.concat(F.date_format(at, "EEEE"), F.lit(", "), day, F.lit(" "), F.date_format(at, "h:mm a"))}


def filled(template: Column, values: Column) -> Column:
    """A template (or a configuration as JSON text) whose ${path} places are filled from a JSON value; paths that lead nowhere stay."""
    pieces_ = F.split(template, r"(?=\$\{)", -1)
    one = lambda x: F.regexp_extract(x, r"^\$\{([^}]+)\}", 1)
    at = lambda x: F.nullif(json_path(values, one(x)), F.lit(""))
    fill = lambda x: F.when(one(x) == "", x).otherwise(F.coalesce(F.concat(at(x), F.regexp_replace(x, r"^\$\{[^}]+\}", "")), x))
    return F.array_join(F.transform(pieces_, fill), "")


def citation_link(title: Column, chunk_source: Column) -> tuple[Column, Column, Column]:
    """Text, address and icon of a citation's link: the host for web links, the title for other services, nothing for files."""
    kind, source = source_parts(chunk_source)
    web = F.when(source.rlike("^https?://"), source).otherwise(F.concat(F.lit("https://"), source))
    host = F.regexp_replace(F.regexp_extract(web, "^https?://([^/?#]+)", 1), r"^www\.", "")
    return F.when(kind.isNull(), F.lit("")).when(kind == "link", host).otherwise(title), F.when(kind.isNotNull(), web), F.coalesce(kind, F.lit("file"))
