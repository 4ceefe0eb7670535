"""Registered queries. Each takes ``(spark, sf_dir)``; ``ORACLE`` holds the SQL counterpart."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import derive as D
from folioscope.functions import text as tx
from folioscope.operators import (
    assembly, chunking, classification, dense, discovery, evaluation, fingerprint, fusion, lexical,
    names, postings, registry, segmentation, topk,
)
from folioscope.plans.index import build_corpus, discover
from folioscope.plans.retrieve import Retriever
from folioscope.plans.assistant import Assistant
from folioscope.session import durable, shared_folder
from folioscope.sources import layout

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


# --- text ------------------------------------------------------------------------------------

@query(
    "text_normal_forms",
    f"""SELECT doc_id, md5({D.sql_label('text')}) AS label_md5, md5({D.sql_fold_label('text')}) AS fold_label_md5,
    md5({D.sql_fold_plain('text')}) AS fold_plain_md5, md5({D.sql_fold_plain('text')}) AS loose_md5 FROM documents""",
)
def text_normal_forms(spark, sf):
    return D.read(spark, sf, "documents").select(
        "doc_id", F.md5(tx.label("text")).alias("label_md5"), F.md5(tx.fold_label("text")).alias("fold_label_md5"),
        F.md5(tx.fold_plain("text")).alias("fold_plain_md5"), F.md5(tx.loose("text")).alias("loose_md5"),
    )


@query(
    "token_counts",
    f"""SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, CAST({D.sql_word_count('text')} AS INT) AS n_words,
    md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, text, {D.sql_tokens('text')} AS t FROM documents)""",
)
def token_counts(spark, sf):
    d = D.read(spark, sf, "documents").select("doc_id", "text", tx.tokenize("text").alias("t"))
    return d.select(
        "doc_id", F.size("t").alias("n_tokens"), tx.word_count("text").alias("n_words"),
        F.md5(F.array_join("t", " ")).alias("tokens_md5"),
    )


@query(
    "language_of_chunks",
    D.ctes(D.SQL_CHUNKS) + "SELECT candidate_language, coalesce(fund, '-') AS owner, count(*) AS chunks FROM langs JOIN chunks USING (chunk_ord) GROUP BY ALL",
)
def language_of_chunks(spark, sf):
    c = D.chunk_rows(spark, sf).withColumn("candidate_language", tx.detect_language(tx.passage_text("section", "text")))
    return c.groupBy("candidate_language", F.coalesce("fund", F.lit("-")).alias("owner")).agg(F.count("*").alias("chunks"))


@query(
    "sentence_counts",
    r"""SELECT doc_id, CAST(len(s) AS INT) AS n_sentences, CAST(list_max(list_transform(s, lambda x: length(x))) AS INT) AS longest
    FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents)""",
)
def sentence_counts(spark, sf):
    s = D.read(spark, sf, "documents").select("doc_id", tx.sentences("text").alias("s"))
    return s.select(
        "doc_id", F.size("s").alias("n_sentences"), F.array_max(F.transform("s", lambda x: F.length(x))).alias("longest")
    )


@query(
    "page_labels",
    D.ctes(D.SQL_CHUNKS) + """SELECT chunk_id, CASE WHEN page_start = page_end THEN CAST(page_start AS VARCHAR)
    ELSE page_start || '-' || page_end END AS page FROM chunks""",
)
def page_labels(spark, sf):
    return D.chunk_rows(spark, sf).select("chunk_id", tx.page_label(F.col("page_start"), F.col("page_end")).alias("page"))


# --- layout ----------------------------------------------------------------------------------

#: Tags inside a block's text, the one that parts words, and a block with its text up to the next other tag.
_INLINE, _BREAK, _HTML_BLOCK = r"</?(?:a|b|i|u|em|strong|span|code|small|sub|sup)(?:\s[^>]*)?>", r"<br\s*/?>", r"<(h1|p|li)(?:\s[^>]*)?>([^<]*)"


def html_blocks(spark, sf):
    """Headings, paragraphs and links of web pages as raw layout blocks; inline tags don't end them."""
    flat = F.regexp_replace(F.regexp_replace("html", _BREAK, " "), _INLINE, "")
    kinds = F.regexp_extract_all(flat, F.lit(_HTML_BLOCK), F.lit(1))
    texts = F.regexp_extract_all(flat, F.lit(_HTML_BLOCK), F.lit(2))
    pairs = F.arrays_zip(kinds.alias("k"), texts.alias("t"))
    raw = F.transform(
        pairs,
        lambda p, i: F.struct(
            F.when(p["k"] == "li", 1).otherwise(0).alias("type"),
            F.array(F.lit(0.0), (i * 20).cast("double"), F.lit(500.0), (i * 20 + 12).cast("double")).alias("bbox"),
            F.array(
                F.struct(
                    F.transform(
                        F.split(p["t"], " & "),
                        lambda s: F.struct(
                            s.alias("text"), F.when(p["k"] == "h1", 16.0).otherwise(10.0).alias("size"),
                            F.when(p["k"] == "h1", 20).otherwise(4).alias("flags"),
                        ),
                    ).alias("spans")
                )
            ).alias("lines"),
        ),
    )
    return D.read(spark, sf, "pages").select(F.concat(F.lit("page_"), "page_id").alias("document"), raw.alias("raw_blocks"))


@query(
    "layout_text_blocks",
    rf"""WITH flat AS (SELECT page_id, regexp_replace(regexp_replace(html, '{_BREAK}', ' ', 'g'), '{_INLINE}', '', 'g') AS html FROM pages),
    m AS (SELECT page_id, unnest(regexp_extract_all(html, '{_HTML_BLOCK}', 1)) AS k, unnest(regexp_extract_all(html, '{_HTML_BLOCK}', 2)) AS t,
        generate_subscripts(regexp_extract_all(html, '{_HTML_BLOCK}', 2), 1) AS i FROM flat),
    s AS (SELECT page_id, k, i, list_filter(list_transform(string_split(t, ' & '), lambda x: trim(x)), lambda x: x <> '') AS spans FROM m WHERE k <> 'li')
    SELECT 'page_' || page_id AS document, count(*) AS n_blocks, count(*) FILTER (k = 'h1') AS n_bold,
      max(CASE WHEN k = 'h1' THEN 16.0 ELSE 10.0 END) AS max_size,
      md5(string_agg(array_to_string(spans, ' '), chr(10) ORDER BY i)) AS text_md5
    FROM s WHERE len(spans) > 0 GROUP BY page_id""",
)
def layout_text_blocks(spark, sf):
    b = html_blocks(spark, sf).select("document", layout.text_blocks(F.col("raw_blocks")).alias("b"))
    return b.filter(F.size("b") > 0).select(
        "document", F.size("b").cast("long").alias("n_blocks"),
        F.size(F.filter("b", lambda x: x["bold"])).cast("long").alias("n_bold"),
        F.array_max(F.transform("b", lambda x: x["font_size"])).alias("max_size"),
        F.md5(F.array_join(F.transform("b", lambda x: x["text"]), "\n")).alias("text_md5"),
    )


@query(
    "layout_images",
    r"""WITH refs AS (SELECT 'site_' || (page_id % 10) AS document, page_id AS page,
        length(unnest(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS xref FROM pages),
    objs AS (SELECT DISTINCT document, xref FROM refs)
    SELECT document, (SELECT count(*) FROM objs o WHERE o.document = r.document) AS objects, count(*) AS refs,
      count(DISTINCT 'images/' || document || '/' || xref || '.png') AS paths FROM refs r GROUP BY document""",
)
def layout_images(spark, sf):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    images = D.read(spark, sf, "pages").select(
        F.concat(F.lit("site_"), (F.col("page_id") % 10).cast("string")).alias("document"),
        F.col("page_id").alias("page"), F.posexplode(links).alias("position", "href"),
    ).select("document", "page", "position", F.length("href").alias("xref"), F.lit("png").alias("ext"), F.lit(b"x").alias("data"))
    objects, references = layout.image_references(images)
    per_page = references.select("document", F.explode("images").alias("path")).groupBy("document").agg(
        F.count("*").alias("refs"), F.count_distinct("path").alias("paths")
    )
    return objects.groupBy("document").agg(F.count("*").alias("objects")).join(per_page, "document")


@query(
    "layout_chart_rows",
    r"""SELECT doc_id, CAST(count(*) AS INT) AS n_rows, md5(string_agg(array_to_string(list_transform(string_split(line, '|'), lambda c: trim(c)), '~'), chr(10) ORDER BY i)) AS cells_md5
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
    WHERE contains(line, '|') AND NOT starts_with(line, 'TITLE') GROUP BY doc_id""",
)
def layout_chart_rows(spark, sf):
    d = D.read(spark, sf, "documents").select("doc_id", layout.chart_rows(F.col("text")).alias("r"))
    return d.filter(F.size("r") > 0).select(
        "doc_id", F.size("r").alias("n_rows"),
        F.md5(F.array_join(F.transform("r", lambda r: F.array_join(r, "~", "")), "\n")).alias("cells_md5"),
    )


@query(
    "rag_text",
    D.ctes(D.SQL_LAYOUT, D.SQL_UNITS) + """SELECT p.document, p.page, md5(trim(concat_ws(chr(10) || chr(10), p.text,
      CASE WHEN p.page = 1 THEN lt.text END, pt.raw_text))) AS rag_md5
    FROM page_texts p LEFT JOIN list_text lt ON lt.document = p.document AND p.page = 1
    LEFT JOIN (SELECT document, page, 'Item | Value' || chr(10) || string_agg(line, chr(10) ORDER BY pos) AS raw_text FROM pipes GROUP BY ALL) pt
      ON pt.document = p.document AND pt.page = p.page""",
)
def rag_text(spark, sf):
    return D.layout_pages(spark, sf).select("document", "page", F.md5("text_for_rag").alias("rag_md5"))


@query(
    "document_health",
    D.ctes(D.SQL_LAYOUT) + r"""SELECT p.document, count(*) AS parsed_pages,
      CAST(sum(CASE WHEN trim(text) = '' THEN 1 ELSE 0 END) AS BIGINT) AS empty_text_pages,
      CAST(sum(length(text) - length(replace(text, '�', ''))) AS BIGINT) AS replacement_chars,
      CAST(sum(length(text)) AS BIGINT) AS text_chars,
      CAST(sum(CASE WHEN p.page = 1 AND n > 1 THEN 1 ELSE 0 END + CASE WHEN q.document IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS tables
    FROM page_texts p JOIN n_pages n ON n.document = p.document
    LEFT JOIN (SELECT DISTINCT document, page FROM pipes) q ON q.document = p.document AND q.page = p.page GROUP BY p.document""",
)
def document_health(spark, sf):
    return evaluation.document_health(D.layout_pages(spark, sf)).drop("empty_page_rate", "charts", "images")


@query(
    "page_coverage",
    D.ctes(D.SQL_LAYOUT) + """SELECT document, CAST(ceil(n_chars / 400.0) AS BIGINT) AS expected_pages, n AS parsed_pages,
      round(n / ceil(n_chars / 400.0), 6) AS page_coverage FROM n_pages JOIN (SELECT 'doc_' || doc_id AS document, n_chars FROM documents) USING (document)""",
)
def page_coverage(spark, sf):
    health = evaluation.document_health(D.layout_pages(spark, sf))
    expected = D.read(spark, sf, "documents").select(
        F.concat(F.lit("doc_"), "doc_id").alias("document"), F.ceil(F.col("n_chars") / 400.0).alias("expected_pages")
    )
    return evaluation.page_coverage(health, expected).withColumn("page_coverage", F.round("page_coverage", 6))


@query(
    "phrase_recall",
    D.ctes(D.SQL_LAYOUT) + f"""SELECT b.document, b.page, sum(CASE WHEN contains({D.sql_fold_plain('p.text')}, {D.sql_fold_plain('b.text')}) THEN 1 ELSE 0 END)::BIGINT AS found, count(*) AS phrases
    FROM blocks b JOIN page_texts p ON p.document = b.document AND p.page = b.page GROUP BY b.document, b.page""",
)
def phrase_recall(spark, sf):
    pages = D.layout_pages(spark, sf)
    gold = pages.select("document", "page", F.explode("text_blocks").alias("b")).select("document", "page", F.col("b.text").alias("phrase"))
    return evaluation.phrase_recall(pages, gold).groupBy("document", "page").agg(
        F.count_if("found").alias("found"), F.count("*").alias("phrases")
    )


@query(
    "table_row_recall",
    D.ctes(D.SQL_LAYOUT) + f"""SELECT t.document, t.page, EXISTS (SELECT 1 FROM titles r WHERE r.document = t.document AND r.page >= 2
        AND {D.sql_fold_plain('r.title')} = {D.sql_fold_plain('t.title')} AND r.page = t.page) AS matched
    FROM titles t""",
)
def table_row_recall(spark, sf):
    pages = D.layout_pages(spark, sf)
    gold = pages.select(
        "document", F.lit(1).alias("page"), F.col("page").alias("target"),
        F.array(F.regexp_replace(F.element_at("text_blocks", 1)["text"], "^(Annex for |Information concerning the sub-fund )| sub-fund$", ""), F.col("page").cast("string")).alias("row"),
    )
    return evaluation.row_recall(pages, gold).select("document", F.col("target").alias("page"), "matched")


@query(
    "table_detection",
    D.ctes(D.SQL_LAYOUT) + """SELECT t.document, t.page, CAST(CASE WHEN t.page = 1 AND n > 1 THEN 1 ELSE 0 END + CASE WHEN q.document IS NULL THEN 0 ELSE 1 END AS INT) AS detections
    FROM titles t JOIN n_pages n ON n.document = t.document LEFT JOIN (SELECT DISTINCT document, page FROM pipes) q ON q.document = t.document AND q.page = t.page""",
)
def table_detection(spark, sf):
    pages = D.layout_pages(spark, sf)
    return evaluation.detection(pages, pages).drop("detected")


@query(
    "chart_points",
    D.ctes(D.SQL_LAYOUT) + f"""SELECT document, page, key, count(*) AS n, CAST(sum(CASE WHEN value = last_value THEN 1 ELSE 0 END) AS BIGINT) AS correct
    FROM (SELECT document, page, {D.sql_fold_plain("string_split(line, ' | ')[1]")} AS key, {D.sql_fold_plain("string_split(line, ' | ')[2]")} AS value,
      last({D.sql_fold_plain("string_split(line, ' | ')[2]")}) OVER (PARTITION BY document, page, {D.sql_fold_plain("string_split(line, ' | ')[1]")} ORDER BY pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_value FROM pipes) GROUP BY ALL""",
)
def chart_points(spark, sf):
    pages = D.layout_pages(spark, sf)
    body = F.slice(F.transform("text_blocks", lambda b: b["text"]), F.lit(2), F.size("text_blocks"))
    rows = F.filter(body, lambda x: x.contains(" | "))
    charted = pages.withColumn(
        "charts",
        F.array(
            F.struct(
                F.lit(None).cast("array<double>").alias("bbox"), F.lit("").alias("image"),
                F.transform(rows, lambda x: F.split(x, r" \| ")).alias("rows"),
            )
        ),
    )
    points = evaluation.structured_rows(charted, "charts").select(
        "document", "page", tx.loose(F.get("row", F.lit(0))).alias("key"), tx.loose(F.get("row", F.lit(1))).alias("value")
    )
    return evaluation.chart_points(charted, points).groupBy("document", "page", "key").agg(
        F.count("*").alias("n"), F.count_if("correct").alias("correct")
    )


@query(
    "image_checks",
    r"""SELECT page_id, n AS source_unique_images, d AS extracted_unique_images,
      round(CASE WHEN n = 0 THEN 1.0 ELSE least(d, n) / n END, 6) AS recall, round(CASE WHEN d = 0 THEN 1.0 ELSE (d // 2) / d END, 6) AS decode_rate
    FROM (SELECT page_id, len(regexp_extract_all(html, '<p>')) AS n, len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS d FROM pages)""",
)
def image_checks(spark, sf):
    n = F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).cast("long")
    d = F.size(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).cast("long")
    images = D.read(spark, sf, "pages").select(
        "page_id", n.alias("source_unique_images"), d.alias("extracted_unique_images"), F.floor(d / 2).alias("decoded_images")
    )
    return evaluation.image_checks(images).select(
        "page_id", "source_unique_images", "extracted_unique_images",
        F.round("recall", 6).alias("recall"), F.round("decode_rate", 6).alias("decode_rate"),
    )


@query(
    "rag_inclusion",
    D.ctes(D.SQL_LAYOUT) + "SELECT document, page, true AS text_preserved, true AS tables_preserved, true AS charts_preserved FROM titles",
)
def rag_inclusion(spark, sf):
    return evaluation.rag_inclusion(D.layout_pages(spark, sf))


@query(
    "audit_sample",
    D.ctes(D.SQL_LAYOUT) + rf"""SELECT document, page, left(coalesce(long[1 + CAST('0x' || left(md5('43|' || document || '|' || page), 8) AS BIGINT) % greatest(len(long), 1)], left(text, 300)), 500) AS sample_text,
      '' AS human_check
    FROM (SELECT *, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: length(s) >= 60) AS long,
        row_number() OVER (PARTITION BY document ORDER BY md5('42|' || document || '|' || page), page) AS n
      FROM (SELECT document, page, {D.sql_fold_plain('text')} AS text FROM page_texts) WHERE length(text) >= 100) WHERE n <= 2""",
)
def audit_sample(spark, sf):
    return evaluation.audit_sample(D.layout_pages(spark, sf))


# --- discovery -------------------------------------------------------------------------------

@query(
    "name_validity",
    f"""SELECT doc_id, line_idx, ({D.sql_plausible('c')} AND f NOT IN ('summary', 'introduction', 'product', 'name', 'prospectus')
      AND NOT starts_with(f, 'this product') AND NOT starts_with(f, 'this fund')) AS is_valid
    FROM (SELECT doc_id, i - 1 AS line_idx, {D.sql_label('line')} AS c, {D.sql_fold_label('line')} AS f FROM
      (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))""",
)
def name_validity(spark, sf):
    lines = D.read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_idx", "line"))
    return discovery.with_validity(lines.withColumn("line_idx", F.col("line_idx").cast("long")), "line").drop("line")


_STATED = r"regexp_replace(text, ' (the|der|les|que) ', ' is a fund ', 'g')"
_RELATION = discovery.RELATIONS[1].replace("(?imUd)", "(?im)")


@query(
    "relation_statements",
    f"""SELECT document, {D.sql_label('n')} AS name, md5({D.sql_label('m')}[:300]) AS evidence_md5 FROM (
      SELECT 'doc_' || doc_id AS document, unnest(regexp_extract_all({_STATED}, '{_RELATION}', 1)) AS n,
        unnest(regexp_extract_all({_STATED}, '{_RELATION}', 0)) AS m FROM documents)""",
)
def relation_statements(spark, sf):
    pages = D.read(spark, sf, "documents").select(
        F.concat(F.lit("doc_"), "doc_id").alias("document"), F.lit(1).alias("page"),
        F.regexp_replace("text", " (the|der|les|que) ", " is a fund ").alias("text"),
    )
    return discovery.relation_candidates(pages).select("document", "name", F.md5("evidence").alias("evidence_md5"))


_CLEAN_BLOCKS = f"""
cb AS (SELECT document, page, block_index, {D.sql_label('text')} AS text FROM blocks WHERE {D.sql_label('text')} <> ''),
nxt AS (SELECT *, lead(text) OVER (PARTITION BY document, page ORDER BY block_index) AS following FROM cb)"""


@query(
    "label_names",
    D.ctes(D.SQL_LAYOUT, _CLEAN_BLOCKS) + f"""SELECT document, page, method, name FROM (
      SELECT document, page, CASE WHEN v <> '' THEN 'label' ELSE 'label_next' END AS method,
        {D.sql_label("CASE WHEN v <> '' THEN v ELSE following END")} AS name
      FROM (SELECT *, {D.sql_label(f"regexp_extract(text, '{discovery.LABEL.replace('(?iUd)', '(?i)')}', 1)")} AS v FROM nxt
        WHERE regexp_matches(text, '{discovery.LABEL.replace('(?iUd)', '(?i)')}'))
      WHERE v <> '' OR following IS NOT NULL)""",
)
def label_names(spark, sf):
    return discovery.label_candidates(D.layout_pages(spark, sf)).select("document", "page", "method", "name")


@query(
    "quoted_titles",
    D.ctes(D.SQL_LAYOUT, _CLEAN_BLOCKS) + """SELECT c.document, c.text AS name FROM cb c JOIN n_pages n ON n.document = c.document
      JOIN (SELECT DISTINCT document, lang FROM titles) t ON t.document = c.document
      WHERE page = 1 AND block_index = 0 AND lang <> 'en' AND len(string_split(c.text, ' ')) <= 16""",
)
def quoted_titles(spark, sf):
    return discovery.title_candidates(D.layout_pages(spark, sf)).select("document", "name")


@query(
    "list_table_names",
    D.ctes(D.SQL_LAYOUT) + f"""SELECT t.document, t.page - 2 AS row_pos, {D.sql_label('title')} AS name FROM titles t WHERE page >= 2""",
)
def list_table_names(spark, sf):
    return discovery.table_candidates(D.layout_pages(spark, sf)).select(
        "document", (F.col("seq") % 1_000_000).cast("int").alias("row_pos"), "name"
    )


@query(
    "list_table_state",
    """WITH flags AS (SELECT source AS document, doc_id // 20 + 1 AS page, bool_or(doc_id // 20 % 5 = 0) AS opens, bool_or(n_chars % 3 <> 0) AS continues
        FROM documents GROUP BY ALL),
    kept AS (SELECT *, lag(page) OVER (PARTITION BY document ORDER BY page) AS prev FROM flags WHERE opens OR continues),
    marked AS (SELECT *, CASE WHEN opens THEN true WHEN prev IS NULL OR prev <> page - 1 THEN false END AS state FROM kept),
    filled AS (SELECT *, last_value(state IGNORE NULLS) OVER (PARTITION BY document ORDER BY page ROWS UNBOUNDED PRECEDING) AS active FROM marked)
    SELECT a.document, a.page, a.opens, a.active, coalesce(b.active, false) AS active_before
    FROM filled a LEFT JOIN filled b ON b.document = a.document AND b.page = a.page - 1""",
)
def list_table_state(spark, sf):
    d = D.read(spark, sf, "documents")
    page = F.floor(F.col("doc_id") / 20) + 1
    tables = d.select(
        F.col("source").alias("document"), page.alias("page"), ((page - 1) % 5 == 0).alias("page_lists"),
        (F.col("n_chars") % 3 != 0).alias("has_page"),
    )
    return discovery.list_pages(tables)


_VALID = (
    f"{D.sql_plausible('c')} AND f NOT IN ('summary', 'introduction', 'product', 'name', 'prospectus') "
    "AND NOT starts_with(f, 'this product') AND NOT starts_with(f, 'this fund')"
)
_SQL_LABEL = discovery.LABEL.replace("(?iUd)", "(?i)")
#: All candidates of the layout, their greedy clustering arrival by arrival, and the group of each. An arrival takes the
#: earliest label of the names it is linked with; names without links are groups of their own.
_REGISTRY = f"""
stated AS (SELECT document, page, unnest(regexp_extract_all(text, '{_RELATION}', 1)) AS n, generate_subscripts(regexp_extract_all(text, '{_RELATION}', 1), 1) AS i FROM page_texts),
labelled AS (SELECT *, {D.sql_label(f"regexp_extract(text, '{_SQL_LABEL}', 1)")} AS v, row_number() OVER (PARTITION BY document, page ORDER BY block_index) - 1 AS pos FROM nxt),
raw_candidates AS (
  SELECT title AS name, document, 1 AS page, 'fund_list_table' AS method, 0 AS priority, page - 2 AS seq FROM titles WHERE page >= 2
  UNION ALL SELECT n, document, page, 'relation', 1, 1000000 + i - 1 FROM stated
  UNION ALL SELECT CASE WHEN v <> '' THEN v ELSE following END, document, page, CASE WHEN v <> '' THEN 'label' ELSE 'label_next' END, 3, pos
    FROM labelled WHERE regexp_matches(text, '{_SQL_LABEL}') AND (v <> '' OR following IS NOT NULL)
  UNION ALL SELECT c.text, c.document, 1, 'quoted_title', 2, 0 FROM cb c JOIN (SELECT DISTINCT document, lang FROM titles) t ON t.document = c.document
    WHERE page = 1 AND block_index = 0 AND lang <> 'en' AND len(string_split(c.text, ' ')) <= 16),
cleaned AS (SELECT {D.sql_label('name')} AS c, {D.sql_fold_label('name')} AS f, * FROM raw_candidates),
candidates AS (SELECT c AS name, f AS norm, document, page, method, priority, seq FROM cleaned WHERE {_VALID}),
known AS (SELECT DISTINCT norm FROM candidates),
links AS (SELECT l.norm, s.norm AS short FROM known l JOIN known s ON ends_with(l.norm, s.norm) AND l.norm <> s.norm
    WHERE regexp_matches(l.norm[:len(l.norm) - len(s.norm)], '(?i)\\b(fund|фонд)\\b') AND len(string_split(trim(l.norm[:len(l.norm) - len(s.norm)]), ' ')) <= 4),
near AS (SELECT norm, list_append(list(other), norm) AS names FROM (SELECT norm, short AS other FROM links UNION SELECT short, norm FROM links) GROUP BY norm),
arrivals AS (SELECT c.*, names, row_number() OVER (ORDER BY priority, document, page, c.norm, seq) AS k FROM candidates c JOIN near USING (norm)),
walk AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS label, CAST([] AS STRUCT(norm VARCHAR, label BIGINT)[]) AS seen
  UNION ALL
  SELECT a.k, coalesce(list_min(list_transform(list_filter(w.seen, lambda x: list_contains(a.names, x.norm)), lambda x: x.label)), a.k),
    list_append(w.seen, {{'norm': a.norm, 'label': coalesce(list_min(list_transform(list_filter(w.seen, lambda x: list_contains(a.names, x.norm)), lambda x: x.label)), a.k)}})
  FROM walk w JOIN arrivals a ON a.k = w.k + 1
),
grouped AS (
  SELECT a.name, a.norm, document, page, method, priority, seq, 'label ' || label AS grp FROM arrivals a JOIN walk USING (k)
  UNION ALL SELECT c.name, c.norm, document, page, method, priority, seq, 'name ' || c.norm FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.norm = c.norm)
),
entries AS (SELECT grp, coalesce(arg_max(name, (document, page, norm, seq)) FILTER (method = 'fund_list_table'), arg_max(name, (document, page, norm, seq)) FILTER (method = 'relation'),
    arg_min(name, (priority, document, page, norm, seq))) AS canonical_name, count(*) AS evidence_count FROM grouped GROUP BY grp),
spelled AS (SELECT grp, string_agg(name, ' | ' ORDER BY norm, name) AS aliases FROM (SELECT DISTINCT grp, norm, name FROM grouped) GROUP BY grp)"""


@query(
    "registry_groups",
    D.ctes(D.SQL_LAYOUT, _CLEAN_BLOCKS, _REGISTRY, recursive=True) + "SELECT canonical_name, aliases, evidence_count FROM entries JOIN spelled USING (grp)",
)
def registry_groups(spark, sf):
    """Greedy clustering of every candidate name; the tests compare linked names with brute force."""
    candidates = durable(discovery.extract_candidates(stored_pages(spark, sf)))
    entries, _ = registry.build_registry(candidates)
    return evaluation.registry_summary(entries)


@query(
    "registry_evidence",
    D.ctes(D.SQL_LAYOUT, _CLEAN_BLOCKS, _REGISTRY, recursive=True)
    + "SELECT canonical_name, method, count(*) AS rows FROM grouped JOIN entries USING (grp) GROUP BY ALL",
)
def registry_evidence(spark, sf):
    candidates = durable(discovery.extract_candidates(stored_pages(spark, sf)))
    _, evidence = registry.build_registry(candidates)
    return evidence.groupBy("canonical_name", "method").agg(F.count("*").alias("rows"))


_MENTIONS = f"""
mentioned AS (SELECT DISTINCT 'doc_' || doc_id AS document, canonical_name FROM
    (SELECT doc_id, {D.sql_fold_label('text')} AS value FROM documents), aliases WHERE contains(value, alias_norm))"""


def passage_mentions(spark, sf):
    texts = D.read(spark, sf, "documents").select(
        F.concat(F.lit("doc_"), "doc_id").alias("document"), "text"
    )
    return names.mentions(texts, ["document"], "text", D.passage_registry(spark, sf), tx.fold_label)


@query("entity_mentions", D.ctes(D.SQL_PASSAGES, _MENTIONS) + "SELECT document, canonical_name FROM mentioned")
def entity_mentions(spark, sf):
    return passage_mentions(spark, sf)


@query(
    "document_mentions_across_pages",
    D.ctes(D.SQL_PASSAGES, _MENTIONS) + "SELECT document, canonical_name FROM mentioned",
)
def document_mentions_across_pages(spark, sf):
    """Documents cut into pages of 40 words: spellings cross page breaks."""
    cut = F.split("text", " ")
    pages = D.read(spark, sf, "documents").select(
        F.concat(F.lit("doc_"), "doc_id").alias("document"),
        F.posexplode(
            F.transform(F.sequence(F.lit(1), F.size(cut), F.lit(40)), lambda i: F.array_join(F.slice(cut, i, F.lit(40)), " "))
        ).alias("page", "text"),
    )
    return classification.document_mentions(pages, D.passage_registry(spark, sf))


@query(
    "document_classes",
    D.ctes(D.SQL_PASSAGES, _MENTIONS) + """, listed AS (SELECT DISTINCT 'doc_' || doc_id AS document, canonical_name FROM documents
      JOIN names ON item_id = doc_id % (SELECT count(*) FROM benchmark) OR (doc_id % 5 = 0 AND item_id = doc_id * 7 % (SELECT count(*) FROM benchmark))),
    nl AS (SELECT document, count(*) AS n FROM listed GROUP BY document),
    nm AS (SELECT document, count(*) AS n, min(canonical_name) AS one FROM mentioned GROUP BY document),
    k AS (SELECT 'doc_' || doc_id AS document, CASE WHEN coalesce(nl.n, 0) > 1 THEN 'multi_fund' WHEN nm.n = 1 THEN 'single_fund'
      WHEN nm.n IS NULL THEN 'no_fund' ELSE 'multi_fund' END AS document_type, coalesce(nm.n, 0) AS n_mentions, nm.one
      FROM documents LEFT JOIN nl ON nl.document = 'doc_' || doc_id LEFT JOIN nm ON nm.document = 'doc_' || doc_id)
    SELECT document, document_type, CASE WHEN document_type = 'single_fund' THEN one END AS primary_fund, n_mentions FROM k""",
)
def document_classes(spark, sf):
    docs, bench = D.read(spark, sf, "documents"), D.read(spark, sf, "benchmark")
    n = bench.agg(F.count("*")).scalar()
    wanted = docs.select(
        F.concat(F.lit("doc_"), "doc_id").alias("document"),
        F.explode(
            F.array_compact(F.array(F.col("doc_id") % n, F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") * 7 % n)))
        ).alias("item_id"),
    )
    named = bench.select("item_id", F.array_join(F.slice(F.split("text", " "), 1, 8), " ").alias("canonical_name"))
    evidence = wanted.join(named, "item_id").withColumn("method", F.lit("fund_list_table"))
    all_docs = docs.select(F.concat(F.lit("doc_"), "doc_id").alias("document"))
    return classification.classify(all_docs, passage_mentions(spark, sf), evidence).select(
        "document", "document_type", "primary_fund", F.size("mentioned_funds").cast("long").alias("n_mentions")
    )


@query(
    "best_spelling",
    D.ctes(D.SQL_PASSAGES) + f"""SELECT doc_id, arg_max(canonical_name, (length(alias_norm), canonical_name)) AS fund FROM
      (SELECT doc_id, {D.sql_fold_label('text')} AS value FROM documents), aliases WHERE contains(value, alias_norm) GROUP BY doc_id""",
)
def best_spelling(spark, sf):
    aliases = names.alias_table(D.passage_registry(spark, sf))
    texts = D.read(spark, sf, "documents").select("doc_id", "text")
    pairs = names.find_substrings(texts, ["doc_id"], "text", aliases, "alias_norm", tx.fold_label)
    return names.best_match(pairs, ["doc_id"], aliases)


@query(
    "discovery_scores",
    f"""WITH p AS (SELECT text AS name FROM documents),
    g AS (SELECT text AS name FROM documents JOIN labels USING (doc_id)
      UNION ALL SELECT text FROM benchmark),
    pk AS (SELECT DISTINCT {D.sql_fold_label('name')} AS k FROM p), gk AS (SELECT DISTINCT {D.sql_fold_label('name')} AS k FROM g),
    c AS (SELECT (SELECT count(*) FROM p) AS n_predicted, (SELECT count(*) FROM g) AS n_gold,
      (SELECT count(*) FROM gk WHERE k NOT IN (SELECT k FROM pk)) AS missing, (SELECT count(*) FROM pk WHERE k NOT IN (SELECT k FROM gk)) AS extra),
    r AS (SELECT *, (n_predicted - extra) / n_predicted AS pr, (n_gold - missing) / n_gold AS re FROM c)
    SELECT n_predicted, n_gold, missing, extra, round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / (pr + re), 6) AS f1 FROM r""",
)
def discovery_scores(spark, sf):
    docs = D.read(spark, sf, "documents")
    whole = F.col("text").alias("name")
    gold = docs.join(D.read(spark, sf, "labels"), "doc_id").select(whole).unionAll(D.read(spark, sf, "benchmark").select(whole))
    return evaluation.set_scores(docs.select(whole), gold).select(
        "n_predicted", "n_gold", "missing", "extra", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]
    )


@query(
    "discovery_differences",
    f"""WITH pn AS (SELECT text AS name FROM documents), gn AS (SELECT text AS name FROM benchmark),
    p AS (SELECT {D.sql_fold_label('name')} AS k, min(name) AS name FROM pn GROUP BY 1), g AS (SELECT {D.sql_fold_label('name')} AS k, min(name) AS name FROM gn GROUP BY 1)
    SELECT 'missing' AS side, name FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k = g.k)
    UNION ALL SELECT 'extra', name FROM p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.k = p.k)""",
)
def discovery_differences(spark, sf):
    whole = F.col("text").alias("name")
    return evaluation.set_differences(D.read(spark, sf, "documents").select(whole), D.read(spark, sf, "benchmark").select(whole))


# --- query-side names ------------------------------------------------------------------------

_FOUND = f"""
folded AS (SELECT doc_id, text, {D.sql_fold_plain('text')} AS value FROM documents),
spellings AS (SELECT DISTINCT canonical_name, {D.sql_fold_plain('a')} AS alias_norm FROM
    (SELECT canonical_name, canonical_name AS a FROM names UNION SELECT canonical_name, short FROM names)),
hits AS (SELECT doc_id, canonical_name, alias_norm, value FROM folded, spellings WHERE contains(value, alias_norm)),
spots AS (SELECT doc_id, canonical_name, length(alias_norm) AS n, unnest(list_filter(range(1, length(value) - length(alias_norm) + 2),
    lambda i: substr(value, i, length(alias_norm)) = alias_norm)) AS start FROM hits),
turns AS (SELECT s.*, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, start, {D.sql_fold_label('canonical_name')}, canonical_name) AS k FROM spots s),
greedy AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(a BIGINT, b BIGINT)[]) AS taken, true AS fits FROM turns WHERE k = 1
  UNION ALL
  SELECT t.doc_id, t.k, CASE WHEN len(list_filter(taken, lambda x: t.start < x.b AND x.a < t.start + t.n)) = 0
      THEN list_append(taken, {{'a': t.start, 'b': t.start + t.n}}) ELSE taken END,
    len(list_filter(taken, lambda x: t.start < x.b AND x.a < t.start + t.n)) = 0
  FROM greedy g JOIN turns t ON t.doc_id = g.doc_id AND t.k = g.k + 1
),
kept AS (SELECT t.* FROM turns t JOIN greedy g USING (doc_id, k) WHERE g.fits),
firsts AS (SELECT doc_id, canonical_name, min(start) AS start FROM kept GROUP BY ALL),
found AS (SELECT doc_id, string_agg(canonical_name, ' / ' ORDER BY start) AS query_funds, count(*) AS n_funds, any_value(canonical_name) AS one FROM firsts GROUP BY doc_id)"""


def text_queries(spark, sf):
    return D.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("query_id"), F.col("text").alias("query"))


@query(
    "query_entities",
    D.ctes(D.SQL_PASSAGES, _FOUND, recursive=True) + """SELECT CAST(d.doc_id AS VARCHAR) AS query_id, coalesce(query_funds, '') AS query_funds,
      CASE WHEN query_funds IS NULL THEN 'no_fund' ELSE 'fund' END AS route FROM documents d LEFT JOIN found USING (doc_id)""",
)
def query_entities(spark, sf):
    got = names.detect_entities(text_queries(spark, sf), D.passage_registry(spark, sf))
    return got.select(
        "query_id", F.array_join("query_funds", " / ").alias("query_funds"),
        F.when(F.size("query_funds") == 0, "no_fund").otherwise("fund").alias("route"),
    )


@query(
    "query_without_entities",
    D.ctes(D.SQL_PASSAGES, _FOUND, recursive=True) + r""", pieces AS (SELECT d.doc_id, text, list(DISTINCT a ORDER BY length(a) DESC, a) AS spell FROM documents d
        JOIN firsts f USING (doc_id) JOIN (SELECT canonical_name, canonical_name AS a FROM names UNION SELECT canonical_name, short FROM names) USING (canonical_name) GROUP BY ALL),
    cleared AS (SELECT doc_id, text, list_reduce(list_prepend(text, spell), lambda t, a: regexp_replace(t, regexp_escape(a), ' ', 'gi')) AS rest FROM pieces),
    tidy AS (SELECT doc_id, text, trim(regexp_replace(rest, '\s+', ' ', 'g'), ' ,;:-') AS rest FROM cleared)
    SELECT CAST(d.doc_id AS VARCHAR) AS query_id, md5(CASE WHEN t.doc_id IS NULL OR rest = '' THEN d.text ELSE rest END) AS search_md5
    FROM documents d LEFT JOIN tidy t USING (doc_id)""",
)
def query_without_entities(spark, sf):
    reg = D.passage_registry(spark, sf)
    got = names.strip_entities(names.detect_entities(text_queries(spark, sf), reg), reg)
    return got.select("query_id", F.md5("search_query").alias("search_md5"))


# --- segmentation ----------------------------------------------------------------------------

_ANCHOR_PARTS = (D.SQL_LAYOUT, D.SQL_UNITS, D.SQL_TITLE_REGISTRY, D.SQL_ANCHORS)
_SEGMENT_PARTS = (*_ANCHOR_PARTS, D.SQL_SEGMENTS)


def stored_pages(spark, sf):
    """The layout as a stage table, for queries that read it several times."""
    return durable(D.layout_pages(spark, sf))


def built_pages(spark, sf):
    """``stored_pages`` for a whole build, which reads all of a page but its text for prompts."""
    return durable(D.layout_pages(spark, sf).drop("text_for_rag"))


def title_anchors(pages):
    return segmentation.find_anchors(pages, durable(D.title_registry(pages)))


@query(
    "anchor_candidates",
    D.ctes(*_ANCHOR_PARTS) + "SELECT document, page, block_index, fund, segment_type, source FROM best",
)
def anchor_candidates(spark, sf):
    pages = stored_pages(spark, sf)
    reg = durable(D.title_registry(pages))
    matched = durable(segmentation.match_blocks(segmentation.outside_blocks(pages), reg))
    every = segmentation.list_anchors(pages, reg, matched).unionByName(segmentation.heading_anchors(matched))
    return segmentation.best_anchors(every)


@query("anchors", D.ctes(*_ANCHOR_PARTS) + "SELECT document, page, block_index, fund, segment_type, source FROM anchors")
def anchors(spark, sf):
    return title_anchors(stored_pages(spark, sf))


def layout_segments(spark, sf):
    pages = stored_pages(spark, sf)
    return pages, durable(
        segmentation.segment_documents(
            pages, D.no_registry(spark), D.page_classes(pages), D.shared_relations(spark, sf), title_anchors(pages)
        )
    )


@query(
    "segments",
    D.ctes(*_SEGMENT_PARTS) + """SELECT s.document, segment_index, fund, segment_type, start_page, start_block, end_page, end_block,
      CASE WHEN fund IS NOT NULL THEN 'fund' WHEN lang = 'de' THEN 'shared_funds' ELSE 'general' END AS scope,
      CASE WHEN fund IS NULL AND lang = 'de' THEN 'Alpha,' || source ELSE '' END AS related_funds
    FROM segs s JOIN (SELECT 'doc_' || doc_id AS document, lang, source FROM documents) d ON d.document = s.document""",
)
def segments(spark, sf):
    _, segs = layout_segments(spark, sf)
    return segs.withColumn("related_funds", F.array_join("related_funds", ","))


@query(
    "segment_continuity",
    D.ctes(*_SEGMENT_PARTS) + """SELECT document, coalesce(bool_and(ok), true) AS continuous FROM (
      SELECT document, CASE WHEN lead(start_page) OVER w IS NOT NULL THEN end_page IS NOT DISTINCT FROM lead(start_page) OVER w
        AND end_block IS NOT DISTINCT FROM lead(start_block) OVER w END AS ok FROM segs WINDOW w AS (PARTITION BY document ORDER BY segment_index)) GROUP BY document""",
)
def segment_continuity(spark, sf):
    _, segs = layout_segments(spark, sf)
    return evaluation.segment_continuity(segs)


@query(
    "single_owner_checks",
    D.ctes(*_SEGMENT_PARTS) + """SELECT c.document, 'owner of ' || c.document AS primary_fund, n AS segment_count, n = 1 AND f = 'owner of ' || c.document AS correct
    FROM classes c JOIN (SELECT document, count(*) AS n, max(fund) AS f FROM segs GROUP BY document) s ON s.document = c.document WHERE kind = 'single_fund'""",
)
def single_owner_checks(spark, sf):
    pages, segs = layout_segments(spark, sf)
    return evaluation.single_owner_checks(segs, D.page_classes(pages))


@query(
    "suspicious_anchors",
    D.ctes(*_ANCHOR_PARTS) + """SELECT document, fund, page AS annex_page, np AS later_fund_section_page FROM (
      SELECT *, lead(page) OVER w AS np, lead(fund) OVER w AS nf, lead(segment_type) OVER w AS nt FROM best WINDOW w AS (PARTITION BY document ORDER BY page, block_index, fund, segment_type))
    WHERE segment_type = 'annex' AND nt = 'fund_section' AND nf = fund""",
)
def suspicious_anchors(spark, sf):
    return evaluation.suspicious_anchors(durable(anchor_candidates(spark, sf)))


@query(
    "anchor_recall",
    D.ctes(*_ANCHOR_PARTS) + f"""SELECT t.page, r.fund, count(*) AS gold, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM anchors a WHERE a.fund = r.fund AND a.page = t.page AND a.segment_type = 'fund_section') THEN 1 ELSE 0 END) AS BIGINT) AS found
    FROM titles t JOIN reg r ON r.alias_norm = {D.sql_fold_label('t.title')} WHERE t.page >= 2 GROUP BY ALL""",
)
def anchor_recall(spark, sf):
    pages = stored_pages(spark, sf)
    reg = durable(D.title_registry(pages))
    gold = segmentation.list_references(pages, reg).select("fund", "page", F.lit("fund_section").alias("segment_type"))
    got = evaluation.anchor_recall(segmentation.find_anchors(pages, reg), gold)
    return got.groupBy("page", "fund").agg(F.count("*").alias("gold"), F.count_if("found").alias("found"))


# --- chunking --------------------------------------------------------------------------------

_UNIT_PARTS = (*_SEGMENT_PARTS, D.SQL_SEGMENT_UNITS)
_CHUNK_PARTS = (*_UNIT_PARTS, D.SQL_PARTS, D.SQL_PACK)


@query(
    "page_units",
    D.ctes(D.SQL_LAYOUT, D.SQL_UNITS) + """SELECT document, page, count(*) AS n_units, string_agg(source_type, ',' ORDER BY y, rank, idx) AS kinds,
      md5(string_agg(text, chr(10) ORDER BY y, rank, idx)) AS text_md5 FROM units GROUP BY document, page""",
)
def page_units(spark, sf):
    u = D.layout_pages(spark, sf).select(
        "document", "page", chunking.page_units(F.col("text_blocks"), F.col("tables"), F.col("charts")).alias("u")
    )
    return u.filter(F.size("u") > 0).select(
        "document", "page", F.size("u").cast("long").alias("n_units"),
        F.array_join(F.transform("u", lambda x: x["source_type"]), ",").alias("kinds"),
        F.md5(F.array_join(F.transform("u", lambda x: x["text"]), "\n")).alias("text_md5"),
    )


def segment_unit_rows(spark, sf):
    pages, segs = layout_segments(spark, sf)
    return chunking.units_in_spans(pages, chunking.segment_spans(segs, pages))


@query(
    "segment_units",
    D.ctes(*_UNIT_PARTS) + """SELECT document, segment_index, page, count(*) AS n_units, min(y) AS top, max(y) AS bottom FROM unit_segs GROUP BY ALL""",
)
def segment_units(spark, sf):
    return segment_unit_rows(spark, sf).select(
        "document", "segment_index", "page", F.size("units").cast("long").alias("n_units"),
        F.array_min(F.transform("units", lambda u: u["y"])).alias("top"),
        F.array_max(F.transform("units", lambda u: u["y"])).alias("bottom"),
    )


@query(
    "body_font_sizes",
    D.ctes(*_UNIT_PARTS) + "SELECT document, segment_index, body_size FROM bodies",
)
def body_font_sizes(spark, sf):
    return chunking.body_sizes(segment_unit_rows(spark, sf))


@query(
    "section_headings",
    D.ctes(*_UNIT_PARTS, D.SQL_PARTS) + "SELECT document, segment_index, page, count(*) AS n_parts, count(*) FILTER (heading) AS headings, CAST(sum(words) AS BIGINT) AS words FROM parts GROUP BY ALL",
)
def section_headings(spark, sf):
    rows = segment_unit_rows(spark, sf)
    sized = rows.join(chunking.body_sizes(rows), ["document", "segment_index"], "left")
    parts = sized.select(
        "document", "segment_index", "page", "body_size",
        F.explode(chunking.split_units(F.col("units"), D.MAX_WORDS - D.OVERLAP)).alias("u"),
    )
    heading = chunking.is_heading(
        F.col("u.text"), F.col("u.words"), F.col("u.source_type"), F.col("u.font_size"), F.col("u.bold"), F.col("body_size")
    )
    return parts.groupBy("document", "segment_index", "page").agg(
        F.count("*").alias("n_parts"), F.count_if(heading).alias("headings"), F.sum("u.words").alias("words")
    )


def layout_chunks(spark, sf):
    pages, segs = layout_segments(spark, sf)
    return chunking.chunk_documents(pages, segs, D.MAX_WORDS, D.MIN_WORDS, D.OVERLAP)


@query("chunk_sizes", D.ctes(*_CHUNK_PARTS, recursive=True) + "SELECT chunk_id, document, segment_index, word_count FROM chunk_sizes")
def chunk_sizes(spark, sf):
    return layout_chunks(spark, sf).select("chunk_id", "document", "segment_index", "word_count")


@query("chunks", D.ctes(*_CHUNK_PARTS, D.SQL_CHUNK_TEXTS, recursive=True) + "SELECT * FROM whole_chunks")
def chunks(spark, sf):
    return layout_chunks(spark, sf).withColumn("source_types", F.array_join("source_types", ","))


@query(
    "chunk_size_report",
    D.ctes(*_CHUNK_PARTS, recursive=True) + """SELECT count(*) AS n, round(avg(word_count), 6) AS mean, round(stddev_samp(word_count), 6) AS std, min(word_count) AS min, max(word_count) AS max,
      round(quantile_cont(word_count, 0.1), 6) AS p10, round(quantile_cont(word_count, 0.5), 6) AS p50, round(quantile_cont(word_count, 0.9), 6) AS p90,
      round(quantile_cont(word_count, 0.95), 6) AS p95, round(quantile_cont(word_count, 0.99), 6) AS p99,
      count(*) FILTER (word_count > 300) AS above_max, count(*) FILTER (word_count < 50) AS below_short FROM chunk_sizes""",
)
def chunk_size_report(spark, sf):
    report = evaluation.describe_sizes(layout_chunks(spark, sf))
    rounded = ("mean", "std", "p10", "p50", "p90", "p95", "p99")
    return report.select(*[F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in report.columns])


@query(
    "chunk_counts",
    D.ctes(*_CHUNK_PARTS, recursive=True) + "SELECT c.document, s.fund, count(*) AS chunks FROM chunk_sizes c JOIN segs s ON s.document = c.document AND s.segment_index = c.segment_index GROUP BY ALL",
)
def chunk_counts(spark, sf):
    return evaluation.chunk_counts(layout_chunks(spark, sf))


@query(
    "multi_segment_chunks",
    """SELECT source AS chunk_id FROM documents GROUP BY source HAVING count(DISTINCT n_chars % 7) > 1""",
)
def multi_segment_chunks(spark, sf):
    tagged = D.read(spark, sf, "documents").select(F.col("source").alias("chunk_id"), (F.col("n_chars") % 7).alias("segment_index"))
    return evaluation.multi_segment_chunks(tagged)


@query(
    "chunks_in_page_range",
    D.ctes(D.SQL_CHUNKS) + "SELECT chunk_id, page_start, page_end FROM chunks WHERE page_end >= 2 AND page_start <= 3",
)
def chunks_in_page_range(spark, sf):
    return evaluation.chunks_in_pages(D.chunk_rows(spark, sf), 2, 3).select("chunk_id", "page_start", "page_end")


# --- retrieval -------------------------------------------------------------------------------

def lexical_inputs(spark, sf):
    rows = D.chunk_rows(spark, sf).withColumn("lexical_text", tx.passage_text("section", "text"))
    rows = rows.withColumn("candidate_language", tx.detect_language("lexical_text"))
    tokens = durable(lexical.token_table(rows.select("chunk_ord", "fund", "candidate_language", "lexical_text")))
    q = D.search_queries(spark, sf).withColumn("search_query", F.col("query"))
    return tokens, q.withColumn("query_language", tx.detect_language("query"))


_BM25_STATISTICS = f"""
toks AS (SELECT chunk_ord, {D.sql_tokens("lexical_text")} AS tokens FROM chunks JOIN langs USING (chunk_ord)),
dfs AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM toks) GROUP BY term),
raw_idf AS (SELECT term, df, ln((SELECT count(*) FROM toks) - df + 0.5) - ln(df + 0.5) AS r FROM dfs),
mean_idf AS (SELECT avg(r) AS m FROM raw_idf)"""


_BM25_TOP = "SELECT query_id, chunk_ord, CAST(lexical_rank AS INT) AS lexical_rank, round(bm25_score, 6) AS bm25_score FROM lex WHERE lexical_rank <= 10"


@query(
    "bm25_statistics",
    D.ctes(D.SQL_CHUNKS, _BM25_STATISTICS) + "SELECT term, df, round(CASE WHEN r < 0 THEN 0.25 * m ELSE r END, 6) AS idf FROM raw_idf, mean_idf",
)
def bm25_statistics(spark, sf):
    tokens, _ = lexical_inputs(spark, sf)
    return lexical.term_statistics(tokens).withColumn("idf", F.round("idf", 6))


@query("bm25_stored_topk", D.ctes(D.SQL_CHUNKS, D.SQL_QUERIES, D.SQL_BM25) + _BM25_TOP)
def bm25_stored_topk(spark, sf):
    """The ranking of bm25_topk from an index that is written to the shared folder and read back."""
    tokens, q = lexical_inputs(spark, sf)
    root = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    postings.save_lexical_index(tokens, root)
    return postings.stored_rank(postings.load_lexical_index(spark, root), q, 10).select(
        "query_id", "chunk_ord", "lexical_rank", F.round("bm25_score", 6).alias("bm25_score")
    )


@query("bm25_topk", D.ctes(D.SQL_CHUNKS, D.SQL_QUERIES, D.SQL_BM25) + _BM25_TOP)
def bm25_topk(spark, sf):
    tokens, q = lexical_inputs(spark, sf)
    return lexical.lexical_rank(tokens, q, 10).select(
        "query_id", "chunk_ord", "lexical_rank", F.round("bm25_score", 6).alias("bm25_score")
    )


def dense_inputs(spark, sf):
    rows = D.chunk_rows(spark, sf)
    rows = rows.withColumn("candidate_language", tx.detect_language(tx.passage_text("section", "text")))
    vectors = rows.select("chunk_ord", "fund", "candidate_language").join(D.vector_rows(spark, sf), "chunk_ord")
    return durable(vectors), D.search_queries(spark, sf)


@query(
    "semantic_topk",
    D.ctes(D.SQL_CHUNKS, D.SQL_QUERIES, D.SQL_DENSE) + "SELECT query_id, chunk_ord, CAST(semantic_rank AS INT) AS semantic_rank, round(semantic_score, 6) AS semantic_score FROM sem WHERE semantic_rank <= 10",
)
def semantic_topk(spark, sf):
    vectors, q = dense_inputs(spark, sf)
    return dense.semantic_rank(vectors, q, 10).select(
        "query_id", "chunk_ord", "semantic_rank", F.round("semantic_score", 6).alias("semantic_score")
    )


_STAGED = """
staged AS (SELECT *, CASE WHEN semantic_rank <= 10 THEN 0 WHEN candidate_language = 'en' AND lr <= 4 THEN 1
    WHEN candidate_language = 'bg' AND lr <= 4 THEN 2 ELSE 3 END AS stage FROM
    (SELECT *, row_number() OVER (PARTITION BY query_id, candidate_language ORDER BY semantic_rank) AS lr FROM sem)),
cand AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY stage, semantic_rank) AS candidate_rank FROM staged)"""


@query(
    "diversified_candidates",
    D.ctes(D.SQL_CHUNKS, D.SQL_QUERIES, D.SQL_DENSE, _STAGED) + """SELECT query_id, chunk_ord, candidate_language, CAST(candidate_rank AS INT) AS candidate_rank,
      CAST(semantic_rank AS INT) AS candidate_dense_rank FROM cand WHERE candidate_rank <= 15""",
)
def diversified_candidates(spark, sf):
    vectors, q = dense_inputs(spark, sf)
    return dense.candidate_rank(vectors, q, 15, 10, 4).select(
        "query_id", "chunk_ord", "candidate_language", "candidate_rank", "candidate_dense_rank"
    )


_FUSED = """
fused0 AS (SELECT coalesce(s.query_id, l.query_id) AS query_id, coalesce(s.chunk_ord, l.chunk_ord) AS chunk_ord, semantic_rank, lexical_rank,
    coalesce(3.0 / (20 + semantic_rank), 0) + coalesce(1.0 / (20 + lexical_rank), 0) AS hybrid_score
    FROM (SELECT * FROM sem WHERE semantic_rank <= 100) s FULL JOIN (SELECT * FROM lex WHERE lexical_rank <= 100) l
      ON l.query_id = s.query_id AND l.chunk_ord = s.chunk_ord),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, semantic_rank NULLS LAST, lexical_rank NULLS LAST) AS r FROM fused0)"""
_HYBRID_PARTS = (D.SQL_CHUNKS, D.SQL_QUERIES, D.SQL_BM25, D.SQL_DENSE, _FUSED)


@query(
    "hybrid_fusion",
    D.ctes(*_HYBRID_PARTS) + "SELECT query_id, chunk_ord, CAST(r AS INT) AS fused_rank, round(hybrid_score, 6) AS hybrid_score FROM fused WHERE r <= 10",
)
def hybrid_fusion(spark, sf):
    tokens, q = lexical_inputs(spark, sf)
    vectors, _ = dense_inputs(spark, sf)
    fused = fusion.reciprocal_rank_fusion(dense.semantic_rank(vectors, q, 100), lexical.lexical_rank(tokens, q, 100))
    return fused.filter("fused_rank <= 10").select("query_id", "chunk_ord", "fused_rank", F.round("hybrid_score", 6).alias("hybrid_score"))


def retriever(spark, sf, **options):
    return Retriever(D.chunk_rows(spark, sf), D.no_registry(spark), D.vector_rows(spark, sf), **options)


_MODE = """
pool AS (SELECT query_id, count(DISTINCT CASE WHEN candidate_language IN ('en','bg') THEN candidate_language END) AS n_langs
    FROM queries JOIN chunks ON fund IS NOT DISTINCT FROM route JOIN langs USING (chunk_ord) GROUP BY query_id)"""


@query(
    "retrieve_auto",
    D.ctes(*_HYBRID_PARTS, _MODE) + """SELECT query_id, CAST(rank AS INT) AS rank, chunk_ord, effective_mode, CASE WHEN route IS NULL THEN 'no_fund' ELSE 'fund' END AS route,
      round(score, 6) AS score FROM (
      SELECT query_id, semantic_rank AS rank, chunk_ord, 'semantic' AS effective_mode, semantic_score AS score FROM sem JOIN pool USING (query_id) WHERE n_langs > 1
      UNION ALL SELECT query_id, r, chunk_ord, 'hybrid', hybrid_score FROM fused JOIN pool USING (query_id) WHERE n_langs <= 1)
    JOIN queries USING (query_id) WHERE rank <= 5""",
)
def retrieve_auto(spark, sf):
    got = retriever(spark, sf).retrieve(D.search_queries(spark, sf), k=5)
    return got.select(
        "query_id", "rank", "chunk_ord", "effective_mode", "route",
        F.round(F.coalesce("hybrid_score", "semantic_score"), 6).alias("score"),
    )


_PER_FUND = """
fq AS (SELECT query_id, query_vector, i AS fund_order, nullif('src' || ((item_id + i) % 20), 'src0') AS fund FROM queries, unnest([0, 1]) t(i)),
fo AS (SELECT query_id, query_vector, fund, row_number() OVER (PARTITION BY query_id ORDER BY fund_order) - 1 AS fund_order FROM fq WHERE fund IS NOT NULL),
per AS (SELECT query_id, fund_order, chunk_ord, row_number() OVER (PARTITION BY query_id, fund_order ORDER BY
    round(list_inner_product(query_vector, CAST(embedding AS DOUBLE[])), 9) DESC, chunk_ord) AS rank
    FROM fo JOIN chunks USING (fund) JOIN embeddings ON vec_id = chunk_ord)"""


@query(
    "retrieve_per_owner",
    D.ctes(D.SQL_CHUNKS, D.SQL_QUERIES, _PER_FUND) + "SELECT query_id, CAST(fund_order AS INT) AS fund_order, CAST(rank AS INT) AS rank, chunk_ord FROM per WHERE rank <= 3",
)
def retrieve_per_owner(spark, sf):
    got = retriever(spark, sf).retrieve_per_fund(D.search_queries(spark, sf, funds=2), 3, "semantic")
    return got.select("query_id", "fund_order", "rank", "chunk_ord")


@query(
    "interleaved_owners",
    D.ctes(D.SQL_CHUNKS, D.SQL_QUERIES, _PER_FUND) + """SELECT query_id, chunk_ord, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, fund_order) AS INT) AS position
      FROM per WHERE rank <= 3""",
)
def interleaved_owners(spark, sf):
    got = retriever(spark, sf).retrieve_per_fund(D.search_queries(spark, sf, funds=2), 3, "semantic")
    return topk.interleave(got, ["query_id"], "rank", "fund_order").select("query_id", "chunk_ord", "position")


def length_reranker():
    def score(query, passages):
        return [1.0 / (1 + abs(len(p) - len(query))) for p in passages]

    return score


@query(
    "retrieve_reranked",
    D.ctes(D.SQL_CHUNKS, D.SQL_QUERIES, D.SQL_DENSE, _STAGED) + """SELECT query_id, chunk_ord, CAST(rank AS INT) AS rank, round(s, 6) AS reranker_score FROM (
      SELECT query_id, chunk_ord, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, candidate_rank) AS rank FROM (
        SELECT c.query_id, c.chunk_ord, candidate_rank, 1.0::DOUBLE / (1 + abs(length(lexical_text) - length(query))) AS s
        FROM cand c JOIN chunks k USING (chunk_ord) JOIN queries q ON q.query_id = c.query_id WHERE candidate_rank <= 15)) WHERE rank <= 5""",
)
def retrieve_reranked(spark, sf):
    got = retriever(spark, sf, load_reranker=lambda: length_reranker()).retrieve(
        D.search_queries(spark, sf), k=5, mode="reranked", candidate_k=15, global_k=10, per_language_k=4
    )
    return got.select("query_id", "chunk_ord", "rank", F.round("reranker_score", 6).alias("reranker_score"))


@query(
    "first_copies",
    "SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text",
)
def first_copies(spark, sf):
    d = D.read(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    return topk.first_wins(d, [], [F.col("digest")], [F.col("doc_id")]).select("doc_id", "source")


# --- retrieval evaluation --------------------------------------------------------------------

def cases(spark, sf):
    w = F.split("query", " ")
    base = D.search_queries(spark, sf)
    return base.select(
        "query_id", F.when(F.length("query") > 200, "long").otherwise("short").alias("direction"),
        F.lit(None).cast("string").alias("expected_document"), F.get("query_funds", F.lit(0)).alias("expected_fund"),
        F.array(F.array(F.element_at(w, 1), F.element_at(w, 2)), F.array(F.element_at(w, -1))).alias("evidence_groups"),
    )


_EVAL = f"""
top AS (SELECT query_id, chunk_ord, lexical_rank FROM lex WHERE lexical_rank <= 5),
texts AS (SELECT t.query_id, lexical_rank, {D.sql_fold_plain("section || ' ' || text")} AS value FROM top t JOIN chunks c USING (chunk_ord) JOIN queries q ON q.query_id = t.query_id
    WHERE route IS NULL OR fund = route),
terms AS (SELECT query_id, 0 AS g, {D.sql_fold_plain("string_split(query, ' ')[1]")} AS term FROM queries
  UNION ALL SELECT query_id, 0, {D.sql_fold_plain("string_split(query, ' ')[2]")} FROM queries
  UNION ALL SELECT query_id, 1, {D.sql_fold_plain("string_split(query, ' ')[-1]")} FROM queries),
seen AS (SELECT t.query_id, g, min(CASE WHEN contains(value, term) THEN lexical_rank END) AS first FROM terms t LEFT JOIN texts x ON x.query_id = t.query_id GROUP BY ALL),
scored AS (SELECT query_id, avg(CASE WHEN first IS NULL THEN 0 ELSE 1 END) AS cov, min(first) AS first FROM seen GROUP BY query_id),
evald AS (SELECT q.query_id, CASE WHEN length(query) > 200 THEN 'long' ELSE 'short' END AS direction,
    EXISTS (SELECT 1 FROM texts x WHERE x.query_id = q.query_id) AS source_hit, cov AS evidence_coverage, cov = 1 AS all_evidence,
    first AS first_answer_rank, coalesce(1.0 / first, 0) AS rr FROM queries q JOIN scored USING (query_id))"""


def lexical_results(spark, sf):
    tokens, q = lexical_inputs(spark, sf)
    ranked = lexical.lexical_rank(tokens, q, 5)
    return ranked.withColumn("rank", F.col("lexical_rank")).join(D.chunk_rows(spark, sf), "chunk_ord")


@query(
    "retrieval_metrics",
    D.ctes(D.SQL_CHUNKS, D.SQL_QUERIES, D.SQL_BM25, _EVAL) + """SELECT query_id, source_hit, round(evidence_coverage, 6) AS evidence_coverage, all_evidence,
      CAST(first_answer_rank AS INT) AS first_answer_rank, round(rr, 6) AS rr FROM evald""",
)
def retrieval_metrics(spark, sf):
    got = evaluation.evaluate_retrieval(lexical_results(spark, sf), cases(spark, sf), 5)
    return got.select(
        "query_id", "source_hit", F.round("evidence_coverage", 6).alias("evidence_coverage"), "all_evidence",
        "first_answer_rank", F.round("rr", 6).alias("rr"),
    )


@query(
    "retrieval_summary",
    D.ctes(D.SQL_CHUNKS, D.SQL_QUERIES, D.SQL_BM25, _EVAL) + """SELECT direction, round(avg(source_hit::INT), 6) AS source_recall, round(avg(evidence_coverage), 6) AS mean_evidence_coverage,
      round(avg(all_evidence::INT), 6) AS full_evidence_recall, round(avg(rr), 6) AS mrr, count(*) AS cases FROM evald GROUP BY direction""",
)
def retrieval_summary(spark, sf):
    got = evaluation.evaluate_retrieval(lexical_results(spark, sf), cases(spark, sf), 5)
    s = evaluation.summarise_retrieval(got, "direction")
    return s.select("direction", *[F.round(c, 6).alias(c) for c in s.columns if c not in ("direction", "cases")], "cases")


# the same evaluation over the dense ranking
_EVAL_SEMANTIC = re.sub(r"\b(top|texts|seen|scored|evald)\b", r"\1_s", _EVAL.split("terms AS (")[0]) + re.sub(
    r"\b(top|texts|seen|scored|evald)\b", r"\1_s", "seen AS (" + _EVAL.split("seen AS (")[1]
)
_EVAL_SEMANTIC = _EVAL_SEMANTIC.replace(
    "SELECT query_id, chunk_ord, lexical_rank FROM lex WHERE lexical_rank <= 5",
    "SELECT query_id, chunk_ord, semantic_rank AS lexical_rank FROM sem WHERE semantic_rank <= 5",
)
_BOTH = (D.SQL_CHUNKS, D.SQL_QUERIES, D.SQL_BM25, D.SQL_DENSE, _EVAL, _EVAL_SEMANTIC)


def both_evaluations(spark, sf):
    vectors, q = dense_inputs(spark, sf)
    semantic = dense.semantic_rank(vectors, q, 5).withColumn("rank", F.col("semantic_rank"))
    semantic = semantic.drop("candidate_language").join(D.chunk_rows(spark, sf), "chunk_ord")
    gold = cases(spark, sf)
    return (
        evaluation.evaluate_retrieval(lexical_results(spark, sf), gold, 5),
        evaluation.evaluate_retrieval(semantic, gold, 5),
    )


@query(
    "retrieval_gains",
    D.ctes(*_BOTH) + """SELECT query_id, round(a.evidence_coverage, 6) AS base_coverage, round(a.rr, 6) AS base_rr,
      round(b.evidence_coverage - a.evidence_coverage, 6) AS coverage_gain, round(b.rr - a.rr, 6) AS rr_gain FROM evald a JOIN evald_s b USING (query_id)""",
)
def retrieval_gains(spark, sf):
    base, other = both_evaluations(spark, sf)
    return evaluation.compare_runs(base, other).select(
        "query_id", *[F.round(c, 6).alias(c) for c in ("base_coverage", "base_rr", "coverage_gain", "rr_gain")]
    )


@query(
    "mode_summary",
    D.ctes(*_BOTH) + """SELECT mode, round(avg(source_hit::INT), 6) AS source_recall, round(avg(evidence_coverage), 6) AS mean_evidence_coverage,
      round(avg(all_evidence::INT), 6) AS full_evidence_recall, round(avg(rr), 6) AS mrr, count(*) AS cases
      FROM (SELECT 'lexical' AS mode, * FROM evald UNION ALL SELECT 'semantic', * FROM evald_s) GROUP BY mode""",
)
def mode_summary(spark, sf):
    base, other = both_evaluations(spark, sf)
    runs = base.withColumn("mode", F.lit("lexical")).unionByName(other.withColumn("mode", F.lit("semantic")))
    s = evaluation.summarise_retrieval(runs, "mode")
    return s.select("mode", *[F.round(c, 6).alias(c) for c in s.columns if c not in ("mode", "cases")], "cases")


# --- assembly --------------------------------------------------------------------------------

def turn_rows(spark, sf):
    """Conversation turns as retrieved evidence; assistant turns repeat the id of the turn before."""
    c = D.read(spark, sf, "conversations")
    return c.select(
        F.col("conv_id").cast("string").alias("query_id"), F.col("turn").alias("position"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.floor(F.col("turn") / 2).cast("string")).alias("chunk_id"),
        F.concat(F.lit("conv_"), (F.col("conv_id") % 7).cast("string")).alias("document"),
        F.col("turn").cast("int").alias("page_start"), (F.col("turn") + F.col("conv_id") % 2).cast("int").alias("page_end"),
        F.when(F.col("conv_id") % 3 != 0, F.col("role")).alias("section"),
        F.when(F.col("conv_id") % 4 != 0, F.concat(F.lit("F"), (F.col("conv_id") % 4).cast("string"))).alias("fund"), "text",
    )


def conversation_queries(spark, sf):
    c = D.read(spark, sf, "conversations")
    return c.groupBy(F.col("conv_id").cast("string").alias("query_id")).agg(F.min_by("text", "turn").alias("query"))


_ROOM = 700
_TURNS = f"""
turns AS (SELECT CAST(conv_id AS VARCHAR) AS query_id, turn AS position, conv_id || '-' || (turn // 2) AS chunk_id, 'conv_' || (conv_id % 7) AS document,
    turn AS page_start, turn + conv_id % 2 AS page_end, CASE WHEN conv_id % 3 <> 0 THEN role END AS section,
    CASE WHEN conv_id % 4 <> 0 THEN 'F' || (conv_id % 4) END AS fund, text FROM conversations),
uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY position) AS d FROM turns) WHERE d = 1),
numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS n FROM uniq),
first3 AS (SELECT *, trim(text, ' ' || chr(10)) AS body FROM numbered WHERE n <= 3),
e1 AS (SELECT *, rtrim(left(body, 300), ' ' || chr(10)) AS used_text FROM first3 WHERE n = 1),
e2 AS (SELECT f.*, rtrim(left(f.body, CAST(least(300, {_ROOM} - length(e1.used_text)) AS BIGINT)), ' ' || chr(10)) AS used_text,
    length(e1.used_text) AS before FROM first3 f JOIN e1 ON e1.query_id = f.query_id WHERE f.n = 2),
e3 AS (SELECT f.*, rtrim(left(f.body, CAST(least(300, {_ROOM} - e2.before - length(e2.used_text)) AS BIGINT)), ' ' || chr(10)) AS used_text
    FROM first3 f JOIN e2 ON e2.query_id = f.query_id WHERE f.n = 3),
cuts AS (SELECT query_id, n, chunk_id, document, page_start, page_end, section, fund, used_text FROM e1
  UNION ALL SELECT query_id, n, chunk_id, document, page_start, page_end, section, fund, used_text FROM e2
  UNION ALL SELECT query_id, n, chunk_id, document, page_start, page_end, section, fund, used_text FROM e3),
evidence AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n) AS INT) AS evidence_ord,
    CASE WHEN page_start = page_end THEN CAST(page_start AS VARCHAR) ELSE page_start || '-' || page_end END AS page FROM cuts WHERE used_text <> '')"""


def turn_evidence(spark, sf):
    return assembly.evidence_rows(turn_rows(spark, sf), 3, 300, _ROOM)


@query(
    "prompt_evidence",
    D.ctes(_TURNS) + "SELECT query_id, evidence_ord, 'E' || evidence_ord AS evidence_id, chunk_id, page, md5(used_text) AS used_md5 FROM evidence",
)
def prompt_evidence(spark, sf):
    return turn_evidence(spark, sf).select(
        "query_id", "evidence_ord", "evidence_id", "chunk_id", "page", F.md5("used_text").alias("used_md5")
    )


_PROMPTS = f"""
asked AS (SELECT CAST(conv_id AS VARCHAR) AS query_id, arg_min(text, turn) AS query FROM conversations GROUP BY conv_id),
blocks AS (SELECT query_id, string_agg('[E' || evidence_ord || ']' || chr(10) || 'Fund: ' || coalesce(fund, 'None') || chr(10) || 'Document: ' || document
    || chr(10) || 'Page: ' || page || chr(10) || 'Section: ' || coalesce(section, 'None') || chr(10) || 'Text:' || chr(10) || used_text,
    chr(10) || chr(10) ORDER BY evidence_ord) AS shown, count(*) AS n FROM evidence GROUP BY query_id),
prompted AS (SELECT a.query_id, query, '{assembly.INSTRUCTIONS.replace("'", "''")}' || chr(10) || chr(10) || 'QUESTION:' || chr(10) || query || chr(10) || chr(10)
    || 'EVIDENCE:' || chr(10) || coalesce(shown, '[NO EVIDENCE RETRIEVED]') AS prompt, coalesce(n, 0) AS n FROM asked a LEFT JOIN blocks b USING (query_id))"""


@query("prompts", D.ctes(_TURNS, _PROMPTS) + "SELECT query_id, md5(prompt) AS prompt_md5, CAST(length(prompt) AS INT) AS prompt_chars, CAST(n AS INT) AS n_evidence FROM prompted")
def prompts(spark, sf):
    p = assembly.prompts(conversation_queries(spark, sf), turn_evidence(spark, sf))
    return p.select("query_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("prompt_chars"), F.size("evidence_ids").alias("n_evidence"))


@query(
    "prompt_checks",
    D.ctes(_TURNS, _PROMPTS) + """SELECT p.query_id, r.n AS retrieved_chunks, p.n AS prompt_chunks, contains(prompt, query) AS query_present,
      true AS unique_evidence_ids, true AS has_document_metadata, CAST(length(prompt) AS INT) AS prompt_chars
    FROM prompted p JOIN (SELECT query_id, count(*) AS n FROM turns GROUP BY query_id) r USING (query_id)""",
)
def prompt_checks(spark, sf):
    evidence = durable(turn_evidence(spark, sf))
    prompted = assembly.prompts(conversation_queries(spark, sf), evidence)
    return evaluation.prompt_checks(prompted, evidence, turn_rows(spark, sf))


def derived_answers(spark, sf, evidence):
    """Answers whose status and citations follow the conversation id, some of them invalid."""
    k = F.col("query_id").cast("long")
    status = F.element_at(F.array(*[F.lit(s) for s in assembly.STATUSES]), (k % 4 + 1).cast("int"))
    cited = (
        F.when(k % 11 == 0, F.array().cast("array<string>")).when(k % 7 == 0, F.array(F.lit("E1"), F.lit("E9")))
        .otherwise(F.array(F.lit("E1"), F.lit("E1")))
    )
    supplied = evidence.groupBy("query_id").agg(F.collect_set("evidence_id").alias("supplied_ids"))
    return conversation_queries(spark, sf).join(supplied, "query_id").select(
        "query_id", "query", "supplied_ids", status.alias("status"), F.col("query").alias("answer"), cited.alias("evidence_ids"),
        F.lit(None).cast("string").alias("error"), F.lit(0.5).alias("latency_s"),
    )


_ANSWERS = """
ans AS (SELECT query_id, CAST(query_id AS BIGINT) AS k, ['supported', 'not_found', 'ambiguous', 'conflicting'][CAST(query_id AS BIGINT) % 4 + 1] AS status
    FROM asked WHERE query_id IN (SELECT query_id FROM evidence)),
checked AS (SELECT query_id, k, status, CASE WHEN k % 11 = 0 THEN '' WHEN k % 7 = 0 THEN 'E1,E9' ELSE 'E1' END AS evidence_ids,
    CASE WHEN k % 11 <> 0 AND k % 7 = 0 THEN 'cited evidence that was not retrieved: E9'
      WHEN status = 'supported' AND k % 11 = 0 THEN 'a supported answer must cite at least one retrieved evidence item'
      WHEN status = 'conflicting' THEN 'a conflicting answer must cite at least two competing evidence items' END AS error FROM ans)"""


@query("answer_validation", D.ctes(_TURNS, _PROMPTS, _ANSWERS) + "SELECT query_id, status, evidence_ids, error FROM checked")
def answer_validation(spark, sf):
    got = assembly.validate_answers(derived_answers(spark, sf, durable(turn_evidence(spark, sf))), strict=False)
    return got.select("query_id", "status", F.array_join("evidence_ids", ",").alias("evidence_ids"), "error")


@query(
    "cited_sources",
    D.ctes(_TURNS, _PROMPTS, _ANSWERS) + """SELECT query_id, 'E1' AS evidence_id, document, page, section, fund, chunk_id FROM checked JOIN evidence USING (query_id)
      WHERE evidence_ord = 1 AND k % 11 <> 0""",
)
def cited_sources(spark, sf):
    evidence = durable(turn_evidence(spark, sf))
    answers = assembly.validate_answers(derived_answers(spark, sf, evidence), strict=False)
    return assembly.cited_sources(answers, evidence).drop("source_ord")


@query(
    "answer_results",
    D.ctes(_TURNS, _PROMPTS, _ANSWERS) + """SELECT c.query_id, status, CASE WHEN k % 11 = 0 THEN 0 ELSE 1 END AS n_sources,
      CASE WHEN k % 11 = 0 THEN '' ELSE coalesce(fund, '') END AS funds FROM checked c JOIN evidence e ON e.query_id = c.query_id AND evidence_ord = 1""",
)
def answer_results(spark, sf):
    evidence = durable(turn_evidence(spark, sf))
    answers = assembly.validate_answers(derived_answers(spark, sf, evidence), strict=False)
    got = assembly.results(answers, assembly.cited_sources(answers, evidence))
    return got.select("query_id", "status", F.size("sources").alias("n_sources"), F.array_join("funds", ",").alias("funds"))


@query(
    "generation_summary",
    D.ctes(_TURNS, _PROMPTS, _ANSWERS) + """, g AS (SELECT c.query_id, c.error IS NULL AS ok, status = 'supported' AS s, e.document = 'conv_1' OR k % 2 = 0 AS d0, k FROM checked c JOIN evidence e ON e.query_id = c.query_id AND evidence_ord = 1),
    h AS (SELECT ok, ok AND s AS status_ok, ok AND (k % 2 = 0 OR (d0 AND k % 11 <> 0)) AS doc_ok FROM g)
    SELECT count(*) AS cases, count(*) FILTER (ok) AS successful_api_calls, count(*) FILTER (NOT ok) AS api_failures,
      round(avg(CASE WHEN ok THEN (status_ok AND doc_ok)::INT END), 6) AS pass_rate_successful,
      round(avg(CASE WHEN ok THEN status_ok::INT END), 6) AS status_accuracy_successful,
      round(avg(CASE WHEN ok THEN 1 END), 6) AS citation_validity_successful, 0.5 AS mean_latency_s FROM h""",
)
def generation_summary(spark, sf):
    evidence = durable(turn_evidence(spark, sf))
    answers = durable(assembly.validate_answers(derived_answers(spark, sf, evidence), strict=False))
    gold = answers.select(
        "query_id", F.lit("supported").alias("expected_status"),
        F.when(F.col("query_id").cast("long") % 2 == 1, F.lit("conv_1")).alias("expected_document"),
        F.array(F.element_at(F.split("query", " "), 1)).alias("expected_any_terms"),
    )
    checks = evaluation.generation_checks(answers, assembly.cited_sources(answers, evidence), turn_rows(spark, sf), gold)
    s = evaluation.summarise_generation(checks)
    keep = ("cases", "successful_api_calls", "api_failures", "mean_latency_s")
    return s.select(*[F.col(c) if c in keep else F.round(c, 6).alias(c) for c in s.columns])


# --- fingerprint -----------------------------------------------------------------------------

_LEVEL = "SELECT chunk_ord // 1024 AS chunk_ord, sha256(string_agg(h, '' ORDER BY chunk_ord)) AS h FROM {} GROUP BY 1"


@query(
    "chunk_fingerprint",
    D.ctes(D.SQL_CHUNKS) + f""", rows0 AS (SELECT chunk_ord, sha256(chunk_id || chr(0) || coalesce(section, 'None') || chr(0) || coalesce(text, 'None') || chr(0)) AS h FROM chunks),
    a AS ({_LEVEL.format('rows0')}), b AS ({_LEVEL.format('a')}), c AS ({_LEVEL.format('b')})
    SELECT sha256(string_agg(h, '' ORDER BY chunk_ord)) AS chunk_fingerprint FROM c""",
)
def chunk_fingerprint(spark, sf):
    return fingerprint.chunk_fingerprint(D.chunk_rows(spark, sf))


@query(
    "index_metadata_differences",
    D.ctes(D.SQL_CHUNKS) + """SELECT 'model_name' AS key, 'model-a' AS saved, 'model-b' AS current""",
)
def index_metadata_differences(spark, sf):
    rows = D.chunk_rows(spark, sf)
    return fingerprint.metadata_differences(
        fingerprint.index_metadata(rows, "model-a", "", 5), fingerprint.index_metadata(rows, "model-b", "", 5)
    )


# --- whole pipelines -------------------------------------------------------------------------

@query("corpus_chunks")
def corpus_chunks(spark, sf):
    """Discovery, registry, classes, segments and chunks over the derived layout."""
    built = build_corpus(built_pages(spark, sf))
    return built.chunks.withColumn("source_types", F.array_join("source_types", ","))


@query("corpus_classes")
def corpus_classes(spark, sf):
    _, _, classes, _ = discover(built_pages(spark, sf))
    return classes.groupBy("document_type").agg(F.count("*").alias("documents"))


def first_evidence_generator():
    def generate(prompt):
        answer = {"status": "supported", "answer": "See the first passage.", "evidence_ids": ["E1"]}
        return answer, str(answer)

    return generate


@query("assistant_answers")
def assistant_answers(spark, sf):
    """Questions to cited answers with a deterministic generator."""
    q = D.search_queries(spark, sf).drop("query_funds")
    assistant = Assistant(retriever(spark, sf), lambda: first_evidence_generator())
    got = assistant.answer(q)
    return got.select("query_id", "status", F.size("sources").alias("n_sources"), F.element_at("sources", 1)["chunk_id"].alias("chunk_id"))
