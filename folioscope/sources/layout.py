"""From raw layout primitives (spans, table cells, drawings, images) to page columns.

A parser only has to emit primitives; the rules that turn them into blocks, tables, charts
and image references are column expressions and small equi-joins.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.geometry import covered_fraction
from folioscope.functions.text import squeeze, strip

# Smallest chart region, fewest drawing primitives, largest table share.
MIN_WIDTH, MIN_HEIGHT, MIN_PRIMITIVES, MAX_TABLE_SHARE = 120, 80, 10, 0.6
BOLD_FLAG = 16

SPAN = "STRUCT<text: STRING, size: DOUBLE, flags: INT>"
RAW_BLOCK = f"STRUCT<type: INT, bbox: ARRAY<DOUBLE>, lines: ARRAY<STRUCT<spans: ARRAY<{SPAN}>>>>"


def text_blocks(raw_blocks: Column) -> Column:
    """Text blocks with joined span text, largest size and any-bold; blank blocks vanish."""

    def spans(block: Column) -> Column:
        every = F.flatten(F.transform(block["lines"], lambda line: line["spans"]))
        return F.filter(every, lambda s: squeeze(s["text"]) != "")

    kept = F.filter(raw_blocks, lambda b: (b["type"] == 0) & (F.size(spans(b)) > 0))
    return F.transform(
        kept,
        lambda b: F.struct(
            F.array_join(F.transform(spans(b), lambda s: strip(s["text"])), " ").alias("text"),
            b["bbox"].alias("bbox"),
            F.array_max(F.transform(spans(b), lambda s: s["size"])).alias("font_size"),
            F.exists(spans(b), lambda s: s["flags"].bitwiseAND(BOLD_FLAG) != 0).alias("bold"),
        ),
    )


def clean_rows(cells: Column) -> Column:
    """Drop rows without any filled cell; NULL cells become empty, whitespace collapses."""
    filled = F.filter(cells, lambda row: F.exists(row, lambda c: c.isNotNull() & (c != "")))
    return F.transform(filled, lambda row: F.transform(row, lambda c: squeeze(c)))


def tables(raw_tables: Column) -> Column:
    """Tables with at least two rows after cleaning."""
    cleaned = F.transform(
        raw_tables, lambda t: F.struct(t["bbox"].alias("bbox"), clean_rows(t["rows"]).alias("rows"))
    )
    return F.filter(cleaned, lambda t: F.size(t["rows"]) > 1)


def chart_rows(decoded: Column) -> Column:
    """Rows of a decoded chart: pipe-separated lines, title lines left out."""
    lines = F.split(F.replace(decoded, F.lit("<0x0A>"), F.lit("\n")), r"\r\n|\n|\r")
    kept = F.filter(lines, lambda x: x.contains("|") & ~x.startswith("TITLE"))
    return F.transform(kept, lambda x: F.transform(F.split(x, r"\|"), lambda c: F.trim(c)))


def rows_text(rows: Column) -> Column:
    """Cells joined by `` | ``, rows by line breaks."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ", "")), "\n")


def text_for_rag(text: Column, page_tables: Column, page_charts: Column) -> Column:
    """Page text followed by every table and chart, blank-line separated and stripped."""
    parts = F.concat(
        F.array(text),
        F.transform(page_tables, lambda t: rows_text(t["rows"])),
        F.transform(page_charts, lambda c: rows_text(c["rows"])),
    )
    joined = F.array_join(parts, "\n\n", "")
    return strip(joined)


def image_references(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct image objects per document, and per page the path of each reference.

    Input ``document, page, position, xref, ext, data``. Bytes go only to the first output;
    the second carries paths and keeps repeated references on a page.
    """
    path = F.concat_ws(
        "/", F.lit("images"), F.regexp_replace("document", r"\.[^.]*$", ""),
        F.concat_ws(".", F.col("xref").cast("string"), F.col("ext")),
    )
    objects = (
        images.groupBy("document", "xref")
        .agg(F.min_by(F.struct("ext", "data"), F.struct("page", "position")).alias("first"))
        .select("document", "xref", "first.ext", "first.data")
        .withColumn("path", path)
    )
    references = images.select("document", "page", "position", "xref").join(
        objects.select("document", "xref", "path"), ["document", "xref"]
    )
    pages = references.groupBy("document", "page").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "path"))), lambda s: s["path"]
        ).alias("images")
    )
    return objects, pages


def chart_regions(regions: Column, drawings: Column, page_tables: Column) -> Column:
    """Drawing clusters that look like charts: large, dense and not mostly a table.

    ``regions`` are boxes; ``drawings`` have ``rect`` and the number of primitive ``items``.
    Everything sits in the page row, so no join is needed.
    """

    def touches(rect: Column, box: Column) -> Column:
        return (
            (F.greatest(rect[0], box[0]) < F.least(rect[2], box[2]))
            & (F.greatest(rect[1], box[1]) < F.least(rect[3], box[3]))
        )

    def primitives(box: Column) -> Column:
        return F.aggregate(
            F.filter(drawings, lambda d: touches(d["rect"], box)),
            F.lit(0).cast("long"),
            lambda n, d: n + d["items"].cast("long"),
        )

    def mostly_table(box: Column) -> Column:
        return F.exists(page_tables, lambda t: covered_fraction(box, t["bbox"]) > MAX_TABLE_SHARE)

    indexed = F.transform(regions, lambda box, i: F.struct(box.alias("bbox"), (i + 1).alias("index")))
    return F.filter(
        indexed,
        lambda r: (r["bbox"][2] - r["bbox"][0] >= MIN_WIDTH)
        & (r["bbox"][3] - r["bbox"][1] >= MIN_HEIGHT)
        & (primitives(r["bbox"]) >= MIN_PRIMITIVES)
        & ~mostly_table(r["bbox"]),
    )


ChartDecoder = Callable[[], Callable[[bytes], str]]


def decode_charts(charts: DataFrame, load_decoder: ChartDecoder) -> DataFrame:
    """Decode chart images to rows; the decoder loads once per worker, on first use.

    Input ``document, page, index, bbox, image, png``; charts that decode to fewer than two
    rows are dropped. Returns one ``charts`` array per page.
    """
    state: dict = {}

    @F.arrow_udf(T.StringType())
    def decode(images: pa.Array) -> pa.Array:
        if "decoder" not in state:
            state["decoder"] = load_decoder()
        return pa.array([state["decoder"](b) for b in images.to_pylist()], pa.string())

    rows = charts.withColumn("rows", chart_rows(decode(F.col("png")))).filter(F.size("rows") > 1)
    return rows.groupBy("document", "page").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("index", "bbox", "image", "rows"))),
            lambda c: F.struct(c["bbox"].alias("bbox"), c["image"].alias("image"), c["rows"].alias("rows")),
        ).alias("charts")
    )


def assemble_pages(raw: DataFrame, charts: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """Page rows from raw layout ``document, page, text, raw_blocks, raw_tables``."""
    pages = raw.select(
        "document", "page", strip("text").alias("text"),
        text_blocks(F.col("raw_blocks")).alias("text_blocks"),
        tables(F.col("raw_tables")).alias("tables"),
    )
    empty_charts = F.array().cast("ARRAY<STRUCT<bbox: ARRAY<DOUBLE>, image: STRING, rows: ARRAY<ARRAY<STRING>>>>")
    empty_images = F.array().cast("ARRAY<STRING>")
    if charts is not None:
        pages = pages.join(charts, ["document", "page"], "left")
    else:
        pages = pages.withColumn("charts", empty_charts)
    if images is not None:
        pages = pages.join(images, ["document", "page"], "left")
    else:
        pages = pages.withColumn("images", empty_images)
    pages = pages.withColumn("charts", F.coalesce("charts", empty_charts)).withColumn(
        "images", F.coalesce("images", empty_images)
    )
    rag = text_for_rag(F.col("text"), F.col("tables"), F.col("charts"))
    return pages.withColumn("text_for_rag", rag).select(
        "document", "page", "text", "text_blocks", "tables", "charts", "images", "text_for_rag"
    )
