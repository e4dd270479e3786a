"""Captured web pages to download items and schema tables.

A page is one row and stays one row until its items are exploded, so these operators
need no shuffle. Attribute calls are matched with JVM regular expressions. Nested markup
is read by the standard library's parser, a bounded part of an Arrow batch at a time; only
the labelled values and tables of a page are returned.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Sequence
from html.parser import HTMLParser
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import (
    DESCRIBE_CALL,
    DOWNLOAD_CALL,
    HEADER_MARKER,
    PROVIDER_LABEL,
    SERVICE_LABEL,
    category_lookup,
    clean_dataset_name,
)

# Attribute calls ---------------------------------------------------------------------


ONCLICK = r"""(?i)\bonclick\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+)"""

QUOTES = r"""\A["']|["']\z"""


def click_values(html: Column) -> Column:
    """`onclick` values in document order, quoted either way or not: one pass over the page."""
    return F.transform(F.regexp_extract_all(html, F.lit(ONCLICK), F.lit(1)), lambda v: _unescape(F.regexp_replace(v, QUOTES, "")))


def calls_of(values: Column, fn: str) -> Column:
    """The values that name a function."""
    return F.filter(values, lambda v: F.contains(v, F.lit(fn)))


def call_arg(call: Column, fn: str, i: int, arity: int, closed: bool = True) -> Column:
    """Argument i of `fn('a','b',...)`; empty where the value holds no such call."""
    args = ",".join(["'([^']+)'"] * arity)
    return F.regexp_extract(call, rf"{fn}\({args}" + (r"\)" if closed else ""), i)


def extract_call_args(pages: DataFrame, fn: str = DOWNLOAD_CALL, arity: int = 3) -> DataFrame:
    """(page_id, button, arg1..argN) of every call in a page."""
    calls = pages.select("page_id", F.posexplode(calls_of(click_values(F.col("html")), fn)).alias("button", "call"))
    args = [call_arg(F.col("call"), fn, i, arity).alias(f"arg{i}") for i in range(1, arity + 1)]
    return calls.select("page_id", "button", *args).filter("arg1 <> ''")


def pair_by_position(left: Column, right: Column) -> Column:
    """Array of (left, right) structs by position, as long as `left`."""
    # Both are zipped once; looking the partner up by its number would build `right` anew for every item.
    zipped = F.arrays_zip(left.alias("left"), right.alias("right"))
    return F.slice(zipped, F.lit(1), F.size(left))


def download_items(pages: DataFrame, category: str = "cat_name") -> DataFrame:
    """Download items of result pages; the i-th download button goes with the i-th
    description button, also where a button in between does not match."""
    cat_name = F.col(category) if category in pages.columns else category_lookup(F.col("cat_val"))
    keep = [category] if category in pages.columns else []
    # The values of a page are found once; both lists are taken from them.
    lists = pages.select("page_id", *keep, click_values(F.col("html")).alias("values")).select(
        "page_id", *keep, calls_of(F.col("values"), DOWNLOAD_CALL).alias("downloads"), calls_of(F.col("values"), DESCRIBE_CALL).alias("descriptions")
    )
    buttons = pair_by_position(F.col("downloads"), F.col("descriptions"))
    items = lists.select("page_id", *keep, F.posexplode(buttons).alias("button", "pair")).select(
        "page_id", "button", *keep,
        *(call_arg(F.col("pair.left"), DOWNLOAD_CALL, i, 3).alias(n) for i, n in enumerate(("cat_val", "task_code", "opn_code"), 1)),
        F.coalesce(call_arg(F.col("pair.right"), DESCRIBE_CALL, 3, 3, closed=False), F.lit("")).alias("service_name"),
    )
    return items.filter("cat_val <> ''").select(
        "page_id", "button", "cat_val", cat_name.alias("cat_name"), "task_code", "opn_code", "service_name"
    )


def _unescape(text: Column) -> Column:
    """Numbered character references, then the named ones of markup; the ampersand last.

    The text is split at its references' ends, so that each piece holds one at most."""
    pieces = F.transform(F.split(text, r"(?<=&#[0-9xX][0-9a-fA-F]{0,6};)"), _without_number)
    plain = F.when(F.contains(text, F.lit("&#")), F.array_join(pieces, "")).otherwise(text)
    for entity, char in (("&apos;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.when(F.contains(text, F.lit("&")), plain).otherwise(text)


def _without_number(piece: Column) -> Column:
    """A piece of text with the reference at its end, if there is one, as a character."""
    ref = F.regexp_extract(piece, r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});\z", 0)
    digits = F.regexp_replace(ref, "[&#xX;]", "")
    code = F.when(F.lower(ref).startswith("&#x"), F.upper(digits)).otherwise(F.conv(digits, 10, 16))
    inside = F.conv(code, 16, 10).cast("long").between(1, 0x10FFFF)
    char = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
    return F.when((ref != "") & inside, F.concat(F.substring(piece.cast("binary"), F.lit(1), F.octet_length(piece) - F.octet_length(ref)).cast("string"), char)).otherwise(piece)


# Nested markup -----------------------------------------------------------------------

PARSED = "labels array<struct<label:string,value:string>>, tables array<struct<heads:array<string>,rows:array<array<string>>>>"
LABELS = pa.list_(pa.struct({"label": pa.string(), "value": pa.string()}))
TABLES = pa.list_(pa.struct({"heads": pa.list_(pa.string()), "rows": pa.list_(pa.list_(pa.string()))}))

# Bytes of markup parsed at once; a longer page is parsed by itself.
PART_BYTES = 1 << 20

# Elements without content, and elements whose content is not text.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset(("script", "style", "template"))


class _Outline(HTMLParser):
    """Spans of divs, tables, rows and cells over the running text of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.size = 0
        self.open: list[tuple[str, dict | None]] = []
        self.found: dict[str, list[dict]] = {"div": [], "table": [], "tr": [], "th": [], "td": []}
        self.order = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID_TAGS:
            return
        span = None
        if tag in self.found:
            span = {"tag": tag, "at": self.size, "end": None, "order": self.order, "last": None}
            self.found[tag].append(span)
            self.order += 1
        self.open.append((tag, span))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if any(name == tag for name, _ in self.open):
            while self.open:
                name, span = self.open.pop()
                self._end(span)
                if name == tag:
                    break

    def handle_data(self, data: str) -> None:
        if not any(name in SILENT_TAGS for name, _ in self.open):
            self.text.append(data)
            self.size += len(data)

    def finish(self, html: str) -> str:
        self.feed(html)
        self.close()
        for _, span in self.open:
            self._end(span)
        return "".join(self.text)

    def _end(self, span: dict | None) -> None:
        if span is not None:
            span["end"], span["last"] = self.size, self.order


def _parse(html: str | None, labels: Sequence[str]) -> dict:
    outline = _Outline()
    text = outline.finish(html or "")
    cells = sorted(outline.found["th"] + outline.found["td"], key=itemgetter("order"))

    def read(span: dict) -> str:
        return text[span["at"] : span["end"]].strip()

    def inside(outer: dict, spans: list[dict]) -> list[dict]:
        first = bisect_right(spans, outer["order"], key=itemgetter("order"))
        return spans[first : bisect_left(spans, outer["last"], key=itemgetter("order"))]

    divs = outline.found["div"]
    named = [
        {"label": label, "value": read(after)}
        for div, after in zip(divs, divs[1:])
        if (label := read(div)) in labels
    ]
    tables = [
        {
            "heads": [read(th) for th in inside(table, outline.found["th"])],
            "rows": [
                row
                for tr in inside(table, outline.found["tr"])
                if (row := [read(cell).replace("\n", " ") for cell in inside(tr, cells)])
            ],
        }
        for table in outline.found["table"]
    ]
    return {"labels": named, "tables": tables}


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch whose markup, the last column, is of about PART_BYTES."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0)
    ends = pc.cumulative_sum(sizes.cast(pa.int64())).to_pylist()
    at = 0
    while at < len(ends):
        to = max(bisect_right(ends, PART_BYTES + (ends[at - 1] if at else 0)), at + 1)
        yield batch.slice(at, to - at)
        at = to


def _parse_batches(batches: Iterable[pa.RecordBatch], labels: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The columns of the batches, with labels and tables in place of the markup at their end."""
    for batch in batches:
        for part in _parts(batch):
            *kept, html = part.columns
            parsed = [_parse(page, labels) for page in html.to_pylist()]
            found = [pa.array([page["labels"] for page in parsed], LABELS), pa.array([page["tables"] for page in parsed], TABLES)]
            yield pa.RecordBatch.from_arrays([*kept, *found], [*part.schema.names[:-1], "labels", "tables"])


def parse_pages(pages: DataFrame, labels: Iterable[str] = (SERVICE_LABEL, PROVIDER_LABEL), keep: Sequence[str] = ()) -> DataFrame:
    """(page_id, keep.., labels, tables): labelled values and tables of each page, parsed once."""
    wanted = tuple(labels)
    rows = pages.select("page_id", *keep, "html")
    schema = StructType([*rows.schema.fields[:-1], *StructType.fromDDL(PARSED)])
    return rows.mapInArrow(lambda batches: _parse_batches(batches, wanted), schema)


def labelled_value(parsed: DataFrame, label: str) -> Column:
    """Text of the div after the one that says `label`; the last such pair counts, '' if none."""
    hits = F.filter("labels", lambda item: item["label"] == label)
    return F.coalesce(F.try_element_at(hits, F.lit(-1))["value"], F.lit(""))


def schema_table(marker: str = HEADER_MARKER) -> Column:
    """Tab-joined rows, header row included, of the first table with a `th` that is the marker."""
    fitting = F.filter("tables", lambda t: F.array_contains(t["heads"], marker))
    rows = F.coalesce(F.get(fitting, F.lit(0))["rows"], F.array().cast("array<array<string>>"))
    return F.transform(rows, lambda row: F.array_join(row, "\t"))


def schema_pages(pages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(page_id, keep.., service_name, provider, dataset_name, schema_rows) of each page that has
    a name and a schema table."""
    parsed = parse_pages(pages, keep=keep)
    rows = parsed.select(
        "page_id", *keep,
        labelled_value(parsed, SERVICE_LABEL).alias("service_name"),
        labelled_value(parsed, PROVIDER_LABEL).alias("provider"),
        schema_table().alias("schema_rows"),
    )
    return drop_incomplete(rows).withColumn("dataset_name", clean_dataset_name(F.col("service_name")))


def drop_incomplete(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("service_name") != "") & (F.size("schema_rows") > 0))
