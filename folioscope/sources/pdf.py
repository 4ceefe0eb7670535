"""PDF primitives through PyMuPDF, when that package is installed on the workers.

The parser only reports what is on a page (spans, cells, drawings, images). All rules live in
``layout``. Pages of one file stream out one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.sources import layout
from folioscope.sources.files import binary_pages

RAW_PAGE = (
    f"document STRING, page INT, text STRING, raw_blocks ARRAY<{layout.RAW_BLOCK}>, "
    "raw_tables ARRAY<STRUCT<bbox: ARRAY<DOUBLE>, rows: ARRAY<ARRAY<STRING>>>>, "
    "images ARRAY<STRUCT<position: INT, xref: INT, ext: STRING, data: BINARY>>, "
    "regions ARRAY<ARRAY<DOUBLE>>, drawings ARRAY<STRUCT<rect: ARRAY<DOUBLE>, items: INT>>, "
    "pictures ARRAY<STRUCT<index: INT, png: BINARY>>"
)


def read_pages(path: str, content: bytes) -> Iterator[dict]:
    try:
        import pymupdf
    except ImportError as exc:
        raise ImportError("PDF input needs the pymupdf package on the workers") from exc

    name = path.rsplit("/", 1)[-1]
    with pymupdf.open(stream=content, filetype="pdf") as pdf:
        for number, page in enumerate(pdf, start=1):
            regions = [list(map(float, r)) for r in page.cluster_drawings()]
            images = []
            for position, (xref, *_rest) in enumerate(page.get_images(full=True)):
                found = pdf.extract_image(xref)
                images.append({"position": position, "xref": xref, "ext": found["ext"], "data": found["image"]})
            yield {
                "document": name,
                "page": number,
                "text": page.get_text("text", sort=True),
                "raw_blocks": [
                    {
                        "type": b["type"], "bbox": list(b["bbox"]),
                        "lines": [
                            {"spans": [{"text": s["text"], "size": s["size"], "flags": s["flags"]} for s in line["spans"]]}
                            for line in b.get("lines", [])
                        ],
                    }
                    for b in page.get_text("dict", sort=True)["blocks"]
                ],
                "raw_tables": [{"bbox": list(t.bbox), "rows": t.extract()} for t in page.find_tables().tables],
                "images": images,
                "regions": regions,
                "drawings": [{"rect": list(d["rect"]), "items": len(d["items"])} for d in page.get_drawings()],
                "pictures": [
                    {
                        "index": i,
                        "png": page.get_pixmap(
                            matrix=pymupdf.Matrix(3, 3), clip=pymupdf.Rect(r), alpha=False
                        ).tobytes("png"),
                    }
                    for i, r in enumerate(regions, start=1)
                    if r[2] - r[0] >= layout.MIN_WIDTH and r[3] - r[1] >= layout.MIN_HEIGHT
                ],
            }


def pdf_pages(files: DataFrame, load_decoder: layout.ChartDecoder | None = None) -> DataFrame:
    """Page rows of the PDF files; without a chart decoder no chart is kept."""
    raw = binary_pages(files, read_pages, RAW_PAGE)
    images = raw.select("document", "page", F.inline("images"))
    _, references = layout.image_references(images)
    charts = None
    if load_decoder is not None:
        tables = layout.tables(F.col("raw_tables"))
        regions = raw.select(
            "document", "page", "pictures",
            F.explode(layout.chart_regions(F.col("regions"), F.col("drawings"), tables)).alias("r"),
        ).select("document", "page", "r.bbox", "r.index", "pictures")
        pictured = regions.withColumn(
            "png", F.get(F.filter("pictures", lambda p: p["index"] == F.col("index")), F.lit(0))["png"]
        ).withColumn("image", F.format_string("charts/%s/page_%d_%d.png", F.regexp_replace("document", r"\.[^.]*$", ""), "page", "index"))
        charts = layout.decode_charts(pictured.drop("pictures"), load_decoder)
    return layout.assemble_pages(raw, charts, references)
