"""Explicit schemas of every stage table (DDL strings)."""

BBOX = "ARRAY<DOUBLE>"
ROWS = "ARRAY<ARRAY<STRING>>"
TEXT_BLOCK = f"STRUCT<text: STRING, bbox: {BBOX}, font_size: DOUBLE, bold: BOOLEAN>"
TABLE = f"STRUCT<bbox: {BBOX}, rows: {ROWS}>"
CHART = f"STRUCT<bbox: {BBOX}, image: STRING, rows: {ROWS}>"

PAGE_FIELDS = (
    f"page INT, text STRING, text_blocks ARRAY<{TEXT_BLOCK}>, tables ARRAY<{TABLE}>, "
    f"charts ARRAY<{CHART}>, images ARRAY<STRING>, text_for_rag STRING"
)
#: one row per (document, page): the layout every operator works on
PAGES = f"document STRING, {PAGE_FIELDS}"
#: one row per document with nested pages: the JSON artifact
DOCUMENTS = (
    "document STRING, pages ARRAY<STRUCT<page: INT, text: STRING, "
    f"text_blocks: ARRAY<{TEXT_BLOCK}>, tables: ARRAY<{TABLE}>, charts: ARRAY<{CHART}>, "
    "images: ARRAY<STRING>, text_for_rag: STRING>>"
)

CANDIDATES = "name STRING, document STRING, page INT, method STRING, evidence STRING, seq BIGINT"
REGISTRY = "canonical_name STRING, aliases ARRAY<STRING>, evidence_count BIGINT"
CLASSIFICATIONS = (
    "document STRING, document_type STRING, primary_fund STRING, mentioned_funds ARRAY<STRING>"
)
ANCHORS = (
    "document STRING, page INT, block_index INT, fund STRING, segment_type STRING, source STRING"
)
SEGMENTS = (
    "document STRING, segment_index INT, fund STRING, segment_type STRING, start_page INT, "
    "start_block INT, end_page INT, end_block INT, scope STRING, related_funds ARRAY<STRING>"
)
CHUNKS = (
    "chunk_id STRING, document STRING, fund STRING, segment_type STRING, segment_index INT, "
    "section STRING, page_start INT, page_end INT, word_count INT, source_types ARRAY<STRING>, "
    "text STRING"
)
