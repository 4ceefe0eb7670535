"""Inputs derived from the given tables, in Spark and in SQL.

The tables hold prose, vectors and web pages but no layout, entities or Cyrillic text, so these
are derived from whole tables: lines become layout blocks, benchmark passages become entities,
sources become owners, and one part of the texts is transliterated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.sources.layout import text_for_rag

LATIN = "abcdefghijklmnopqrstuvwxyz"
CYRILLIC = "абцдефгхийклмнопярстувжьзщ"
PAGE_LINES = 10


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- SQL fragments ---------------------------------------------------------------------------

EDGES = " :;,.\"''„“”"


def sql_squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def sql_label(x: str) -> str:
    return f"trim({sql_squeeze(x)}, '{EDGES}')"


def sql_fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def sql_fold_label(x: str) -> str:
    return sql_fold(sql_label(x))


def sql_fold_plain(x: str) -> str:
    return sql_fold(sql_squeeze(x))


def sql_words(x: str, first: int, last: int) -> str:
    return f"array_to_string(string_split({x}, ' ')[{first}:{last}], ' ')"


def sql_tokens(x: str) -> str:
    return rf"regexp_extract_all({sql_fold_plain(x)}, '[\p{{L}}\p{{N}}_]+(?:[&+.-][\p{{L}}\p{{N}}_]+)*')"


def sql_word_count(x: str) -> str:
    return f"CASE WHEN {sql_squeeze(x)} = '' THEN 0 ELSE len(string_split({sql_squeeze(x)}, ' ')) END"


# --- bilingual chunks ------------------------------------------------------------------------

def bilingual_text(text: Column, lang: Column) -> Column:
    """French and German texts in Cyrillic letters."""
    return F.when(lang.isin("fr", "de"), F.translate(F.lower(text), LATIN, CYRILLIC)).otherwise(text)


def chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunks: owner = source (``src0`` owns nothing), section = first words."""
    d = read(spark, sf, "documents").withColumn("text", bilingual_text(F.col("text"), F.col("lang")))
    text = F.col("text")
    return d.select(
        F.col("doc_id").alias("chunk_ord"), F.concat(F.lit("doc_"), "doc_id").alias("chunk_id"),
        F.concat(F.lit("doc_"), "doc_id").alias("document"), F.nullif("source", F.lit("src0")).alias("fund"),
        F.array_join(F.slice(F.split(text, " ", 4), 1, 3), " ").alias("section"),
        F.lit(1).alias("page_start"), (1 + F.floor(F.col("n_chars") / 2000)).cast("int").alias("page_end"),
        text.alias("text"),
    )


def vector_rows(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_ord"), "embedding")


_BI = f"CASE WHEN lang IN ('fr','de') THEN translate(lower(text), '{LATIN}', '{CYRILLIC}') ELSE text END"
SQL_CHUNKS = f"""
bi AS (SELECT doc_id, lang, source, n_chars, {_BI} AS text FROM documents),
chunks0 AS (SELECT doc_id AS chunk_ord, 'doc_' || doc_id AS chunk_id, 'doc_' || doc_id AS document,
    nullif(source, 'src0') AS fund, {sql_words('text', 1, 3)} AS section,
    1 AS page_start, CAST(1 + floor(n_chars / 2000) AS INT) AS page_end, text FROM bi),
chunks AS (SELECT *, concat_ws(chr(10), nullif({sql_squeeze('section')}, ''), nullif({sql_squeeze('text')}, '')) AS lexical_text
    FROM chunks0),
chunk_lang AS (SELECT chunk_ord, length(regexp_replace(lexical_text, '[^\\x{{0400}}-\\x{{04FF}}]', '', 'g')) AS cy,
    length(regexp_replace(lexical_text, '[^A-Za-z]', '', 'g')) AS la FROM chunks),
langs AS (SELECT chunk_ord, CASE WHEN cy > la THEN 'bg' WHEN la > cy THEN 'en' ELSE 'mixed' END AS candidate_language
    FROM chunk_lang)"""


def search_queries(spark: SparkSession, sf: str, funds: int = 1) -> DataFrame:
    """Benchmark passages as questions, routed to owners by their id, with a stored vector."""
    k = F.col("item_id") % 20
    routes = [
        F.when((k + i) % 20 != 0, F.concat(F.lit("src"), ((k + i) % 20).cast("string"))) for i in range(funds)
    ]
    vectors = read(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("query_vector"))
    return read(spark, sf, "benchmark").join(vectors, "item_id").select(
        F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"),
        F.array_compact(F.array(*routes)).alias("query_funds"), "query_vector",
    )


def no_registry(spark: SparkSession) -> DataFrame:
    from folioscope import schemas

    return spark.createDataFrame([], schemas.REGISTRY)


SQL_QUERIES = """
queries AS (SELECT CAST(item_id AS VARCHAR) AS query_id, item_id, text AS query,
    nullif('src' || (item_id % 20), 'src0') AS route, CAST(embedding AS DOUBLE[]) AS query_vector
    FROM benchmark JOIN embeddings ON item_id = vec_id)"""

SQL_BM25 = f"""
toks AS (SELECT c.chunk_ord, fund, candidate_language, {sql_tokens('lexical_text')} AS tokens
    FROM chunks c JOIN langs USING (chunk_ord)),
totals AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM toks),
dfs AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM toks) GROUP BY term),
raw_idf AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM dfs, totals),
idfs AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw_idf) ELSE r END AS idf FROM raw_idf),
qlang AS (SELECT query_id, length(regexp_replace(query, '[^\\x{{0400}}-\\x{{04FF}}]', '', 'g')) AS cy,
    length(regexp_replace(query, '[^A-Za-z]', '', 'g')) AS la FROM queries),
qterms AS (SELECT query_id, route, term, count(*) AS qtf,
    any_value(CASE WHEN cy > la THEN 'bg' WHEN la > cy THEN 'en' ELSE 'mixed' END) AS query_language
    FROM (SELECT query_id, route, unnest({sql_tokens('query')}) AS term FROM queries) JOIN qlang USING (query_id)
    GROUP BY query_id, route, term),
posts AS (SELECT chunk_ord, fund, candidate_language, dl, term, count(*) AS tf FROM
    (SELECT chunk_ord, fund, candidate_language, len(tokens) AS dl, unnest(tokens) AS term FROM toks)
    GROUP BY ALL),
bm AS (SELECT query_id, chunk_ord,
    round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS bm25_score
    FROM posts JOIN qterms USING (term) JOIN idfs USING (term), totals
    WHERE fund IS NOT DISTINCT FROM route
      AND (query_language = 'mixed' OR candidate_language = 'mixed' OR candidate_language = query_language)
    GROUP BY query_id, chunk_ord HAVING bm25_score > 0),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, chunk_ord) AS lexical_rank FROM bm)"""

SQL_DENSE = """
dense0 AS (SELECT query_id, chunk_ord, candidate_language,
    round(list_inner_product(query_vector, CAST(embedding AS DOUBLE[])), 9) AS semantic_score
    FROM queries, embeddings JOIN chunks ON chunk_ord = vec_id JOIN langs USING (chunk_ord)
    WHERE fund IS NOT DISTINCT FROM route),
sem AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic_score DESC, chunk_ord) AS semantic_rank
    FROM dense0)"""

# --- layout ----------------------------------------------------------------------------------

def layout_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as page rows of ten lines with titles, a fund list and pipe tables.

    Everything is computed inside the document row; only the pages are exploded.
    """
    d = read(spark, sf, "documents").select("doc_id", "lang", F.split("text", "\n").alias("lines"))
    n_pages = F.ceil(F.size("lines") / PAGE_LINES).cast("int")

    def title_of(p: Column) -> Column:
        return F.array_join(F.slice(F.split(F.get(F.col("lines"), (p - 1) * PAGE_LINES), " "), 1, 4), " ")

    d = d.withColumn("n_pages", n_pages).withColumn(
        "titles", F.transform(F.sequence(F.lit(1), F.col("n_pages")), title_of)
    )
    p = d.select("*", F.explode(F.sequence(F.lit(1), F.col("n_pages"))).alias("page")).withColumn(
        "raw", F.slice("lines", (F.col("page") - 1) * PAGE_LINES + 1, F.lit(PAGE_LINES))
    )
    lines = F.transform(
        "raw",
        lambda x, i: F.when((F.col("page") == 1) & (i == 3), F.concat(F.lit("Product name: "), F.array_join(F.slice(F.split(x, " "), 1, 5), " ")))
        .when((F.col("page") == 1) & (i == 6), F.lit("Product name:")).otherwise(x),
    )
    title = F.get("titles", F.col("page") - 1)
    shown = (
        F.when((F.col("page") == 1) & (F.col("lang") != "en"), F.concat(title, F.lit(" sub-fund")))
        .when(F.col("page") % 4 == 0, F.concat(F.lit("Annex for "), title))
        .when(F.col("page") % 4 == 3, F.concat(F.lit("Information concerning the sub-fund "), title))
        .otherwise(title)
    )

    def block(text, y, size, bold) -> Column:
        y = y.cast("double")
        return F.struct(
            text.alias("text"), F.array(F.lit(0.0), y, F.lit(500.0), y + 12.0).alias("bbox"),
            size.cast("double").alias("font_size"), F.lit(bold).alias("bold"),
        )

    p = p.withColumn("page_lines", lines).withColumn("title", title).withColumn("shown", shown)
    blocks = F.concat(
        F.array(block(F.col("shown"), F.lit(20), F.lit(16), True)),
        F.transform(
            "page_lines", lambda x, i: block(x, 50 + 30 * i, F.when(i % 5 == 0, 13).otherwise(10), False)
        ),
    )
    listed = F.concat(
        F.array(F.array(F.lit("Name"), F.lit("Page"))),
        F.transform(
            F.slice("titles", F.lit(2), F.greatest(F.col("n_pages") - 1, F.lit(0))),
            lambda t, i: F.array(t, (i + 2).cast("string")),
        ),
    )
    fund_list = F.when(
        (F.col("page") == 1) & (F.col("n_pages") > 1),
        F.array(F.struct(F.array(*[F.lit(float(v)) for v in (0, 0, 500, 10)]).alias("bbox"), listed.alias("rows"))),
    )
    piped = F.filter("page_lines", lambda x: x.contains(" | "))
    first_pipe = F.array_position(F.transform("page_lines", lambda x: x.contains(" | ")), True) - 1
    top = (50 + 30 * first_pipe).cast("double")
    pipe_table = F.when(
        F.size(piped) > 0,
        F.array(
            F.struct(
                F.array(F.lit(0.0), top, F.lit(500.0), top + 12.0).alias("bbox"),
                F.concat(
                    F.array(F.array(F.lit("Item"), F.lit("Value"))), F.transform(piped, lambda x: F.split(x, r" \| "))
                ).alias("rows"),
            )
        ),
    )
    none = F.array().cast("array<struct<bbox:array<double>,rows:array<array<string>>>>")
    lead = F.when(F.col("page") > 1, F.lit("")).otherwise(
        F.when(F.col("lang") == "en", F.lit("List of sub-funds\n")).otherwise(
            F.concat(F.lit("„"), "title", F.lit("“ list of funds\n"))
        )
    )
    charts = F.array().cast("array<struct<bbox:array<double>,image:string,rows:array<array<string>>>>")
    return p.select(
        F.concat(F.lit("doc_"), "doc_id").alias("document"), "page",
        F.concat(lead, F.array_join("page_lines", "\n")).alias("text"), blocks.alias("text_blocks"),
        F.concat(F.coalesce(fund_list, none), F.coalesce(pipe_table, none)).alias("tables"), charts.alias("charts"),
        F.array().cast("array<string>").alias("images"),
    ).withColumn("text_for_rag", text_for_rag(F.col("text"), F.col("tables"), F.col("charts")))


SQL_LAYOUT = f"""
l0 AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS raw,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_idx FROM documents),
l AS (SELECT doc_id, 'doc_' || doc_id AS document, lang, CAST(line_idx // {PAGE_LINES} + 1 AS INT) AS page,
    CAST(line_idx % {PAGE_LINES} AS INT) AS pos, raw,
    CASE WHEN line_idx = 3 THEN 'Product name: ' || {sql_words('raw', 1, 5)}
         WHEN line_idx = 6 THEN 'Product name:' ELSE raw END AS line FROM l0),
titles AS (SELECT document, lang, page, {sql_words('raw', 1, 4)} AS title FROM l WHERE pos = 0),
n_pages AS (SELECT document, max(page) AS n FROM l GROUP BY document),
blocks AS (SELECT document, page, 0 AS block_index,
    CASE WHEN page = 1 AND lang <> 'en' THEN title || ' sub-fund' WHEN page % 4 = 0 THEN 'Annex for ' || title
         WHEN page % 4 = 3 THEN 'Information concerning the sub-fund ' || title ELSE title END AS text,
    CAST(20 AS DOUBLE) AS y, CAST(16 AS DOUBLE) AS font_size, true AS bold FROM titles
  UNION ALL SELECT document, page, pos + 1, line, CAST(50 + 30 * pos AS DOUBLE),
    CAST(CASE WHEN pos % 5 = 0 THEN 13 ELSE 10 END AS DOUBLE), false FROM l),
page_texts AS (SELECT l.document, l.page, any_value(CASE WHEN l.page > 1 THEN '' WHEN l.lang = 'en' THEN 'List of sub-funds' || chr(10)
    ELSE '„' || title || '“ list of funds' || chr(10) END) || string_agg(line, chr(10) ORDER BY pos) AS text
    FROM l JOIN titles t ON t.document = l.document AND t.page = l.page GROUP BY l.document, l.page),
pipes AS (SELECT document, page, pos, line, min(pos) OVER (PARTITION BY document, page) AS first_pos
    FROM l WHERE contains(line, ' | '))"""

SQL_UNITS = f"""
shown_blocks AS (SELECT b.* FROM blocks b LEFT JOIN (SELECT DISTINCT document, page, first_pos FROM pipes) p
    ON p.document = b.document AND p.page = b.page AND b.block_index = p.first_pos + 1 WHERE p.document IS NULL),
list_text AS (SELECT t.document, 'Name | Page' || chr(10) || string_agg(title || ' | ' || page, chr(10) ORDER BY page) AS text
    FROM titles t WHERE page >= 2 GROUP BY t.document),
pipe_text AS (SELECT document, page, any_value(first_pos) AS first_pos,
    'Item | Value' || chr(10) || string_agg(array_to_string(list_transform(string_split(line, ' | '), lambda c: trim(c)), ' | '), chr(10) ORDER BY pos) AS text
    FROM pipes GROUP BY document, page),
units AS (
  SELECT document, page, y, 0 AS rank, block_index AS idx, {sql_squeeze('text')} AS text, 'text' AS source_type, font_size, bold
    FROM shown_blocks WHERE {sql_squeeze('text')} <> ''
  UNION ALL SELECT document, 1, 0.0, 1, 0, trim(text), 'table', NULL, false FROM list_text
  UNION ALL SELECT p.document, p.page, CAST(50 + 30 * first_pos AS DOUBLE), 1,
    CASE WHEN p.page = 1 AND n > 1 THEN 1 ELSE 0 END, trim(text), 'table', NULL, false
    FROM pipe_text p JOIN n_pages n ON n.document = p.document)"""


# --- entities --------------------------------------------------------------------------------

def passage_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages as entities: eight leading words, with five as a second spelling."""
    words = F.split("text", " ")
    b = read(spark, sf, "benchmark")
    return b.select(
        F.array_join(F.slice(words, 1, 8), " ").alias("canonical_name"),
        F.array(F.array_join(F.slice(words, 1, 5), " ")).alias("aliases"),
        F.lit(0).cast("long").alias("evidence_count"),
    )


SQL_PASSAGES = f"""
names AS (SELECT item_id, {sql_words('text', 1, 8)} AS canonical_name, {sql_words('text', 1, 5)} AS short FROM benchmark),
aliases AS (SELECT DISTINCT canonical_name, {sql_fold_label('a')} AS alias_norm FROM
    (SELECT canonical_name, canonical_name AS a FROM names UNION SELECT canonical_name, short FROM names)
    WHERE {sql_fold_label('a')} <> '')"""


def title_registry(pages: DataFrame) -> DataFrame:
    """Listed page titles as entities, one per folded form."""
    from folioscope.functions.text import fold_label
    from folioscope.operators.discovery import plausible_shape

    rows = pages.filter(F.col("page") == 1).select(F.explode("tables").alias("t")).filter(
        F.element_at(F.element_at("t.rows", 1), 2) == "Page"
    ).select(F.explode(F.slice("t.rows", F.lit(2), F.size("t.rows"))).alias("r"))
    titles = rows.select(F.element_at("r", 1).alias("title")).withColumn("_n", fold_label("title"))
    return titles.filter(plausible_shape(F.col("_n"))).groupBy("_n").agg(F.min("title").alias("canonical_name")).select(
        "canonical_name", F.array("canonical_name").alias("aliases"), F.lit(0).cast("long").alias("evidence_count")
    )


def sql_plausible(x: str) -> str:
    return (
        f"(length({x}) BETWEEN 5 AND 180 AND len(string_split({x}, ' ')) BETWEEN 2 AND 24 "
        rf"AND length(regexp_replace({x}, '[^\p{{L}}]', '', 'g')) >= 4 AND NOT regexp_matches({x}, '[.!?]$'))"
    )


SQL_TITLE_REGISTRY = f"""
reg AS (SELECT {sql_fold_label('title')} AS alias_norm, min(title) AS fund FROM titles WHERE page >= 2
    AND {sql_plausible(sql_fold_label('title'))} GROUP BY 1)"""


def page_classes(pages: DataFrame) -> DataFrame:
    """Classes by length: several pages, one full page, or a short page."""
    shape = pages.groupBy("document").agg(
        F.max("page").alias("n"), F.max(F.when(F.col("page") == 1, F.size("text_blocks"))).alias("b")
    )
    kind = F.when(F.col("n") > 1, "multi_fund").when(F.col("b") > 5, "single_fund").otherwise("no_fund")
    return shape.select(
        "document", kind.alias("document_type"),
        F.when(kind == "single_fund", F.concat(F.lit("owner of "), "document")).alias("primary_fund"),
        F.array().cast("array<string>").alias("mentioned_funds"),
    )


def shared_relations(spark: SparkSession, sf: str) -> DataFrame:
    """German documents relate to two owners."""
    d = read(spark, sf, "documents").filter("lang = 'de'")
    return d.select(
        F.concat(F.lit("doc_"), "doc_id").alias("document"), F.array(F.lit("Alpha"), "source").alias("related_funds")
    )


SQL_ANCHORS = f"""
folded AS (SELECT document, page, block_index, {sql_fold_label('text')} AS value FROM shown_blocks),
exact AS (SELECT document, page, block_index, fund FROM folded JOIN reg ON value = alias_norm),
special AS (SELECT *, (starts_with(value, 'annex for ') OR starts_with(value, 'appendix for ')) AS is_annex FROM folded
    WHERE starts_with(value, 'annex for ') OR starts_with(value, 'appendix for ') OR contains(value, 'information concerning the sub-fund')),
part AS (SELECT document, page, block_index, any_value(is_annex) AS is_annex, any_value(value) AS value,
    arg_max(fund, (length(alias_norm), fund)) AS fund FROM special, reg WHERE contains(value, alias_norm) GROUP BY ALL),
headings AS (SELECT document, page, block_index, fund, 'annex' AS segment_type, 'annex_heading' AS source, 0 AS prio, 1 AS src FROM part WHERE is_annex
  UNION ALL SELECT e.document, e.page, e.block_index, e.fund, 'fund_section', 'exact_heading', 2, 1 FROM exact e
    LEFT JOIN (SELECT * FROM special WHERE is_annex) a ON a.document = e.document AND a.page = e.page AND a.block_index = e.block_index
    WHERE a.document IS NULL
  UNION ALL SELECT p.document, p.page, p.block_index, p.fund, 'fund_section', 'subfund_marker', 1, 1 FROM part p
    LEFT JOIN exact e ON e.document = p.document AND e.page = p.page AND e.block_index = p.block_index
    WHERE NOT is_annex AND e.document IS NULL),
located AS (SELECT document, page, fund, min(block_index) AS block_index FROM (
    SELECT document, page, block_index, fund FROM exact
    UNION ALL SELECT document, page, block_index, fund FROM part WHERE contains(value, 'information concerning the sub-fund'))
    GROUP BY ALL),
refs AS (SELECT DISTINCT t.document, t.page, r.fund FROM titles t JOIN reg r ON r.alias_norm = {sql_fold_label('t.title')} WHERE t.page >= 2),
every AS (SELECT document, page, block_index, fund, 'fund_section' AS segment_type, 'fund_list' AS source, 0 AS prio, 0 AS src
    FROM refs JOIN located USING (document, page, fund) UNION ALL SELECT * FROM headings),
best AS (SELECT document, page, fund, segment_type, arg_min(block_index, (prio, block_index)) AS block_index,
    arg_min(source, (prio, block_index)) AS source FROM every GROUP BY ALL),
lagged AS (SELECT *, lag(fund) OVER w AS prev FROM best
    WINDOW w AS (PARTITION BY document ORDER BY page, block_index, CASE WHEN source = 'fund_list' THEN 0 ELSE 1 END, fund, segment_type)),
anchors AS (SELECT document, page, block_index, fund, segment_type, source FROM lagged WHERE prev IS NULL OR prev <> fund)"""

SQL_SEGMENTS = """
classes AS (SELECT n.document, CASE WHEN n > 1 THEN 'multi_fund' WHEN b > 5 THEN 'single_fund' ELSE 'no_fund' END AS kind
    FROM n_pages n JOIN (SELECT document, count(*) AS b FROM blocks WHERE page = 1 GROUP BY document) c ON c.document = n.document),
placed AS (SELECT a.*, row_number() OVER w - 1 AS ord, lead(page) OVER w AS end_page, lead(block_index) OVER w AS end_block
    FROM anchors a JOIN classes c ON c.document = a.document AND kind = 'multi_fund'
    WINDOW w AS (PARTITION BY a.document ORDER BY page, block_index, CASE WHEN source = 'fund_list' THEN 0 ELSE 1 END, fund, segment_type)),
opening AS (SELECT document, page, block_index FROM placed WHERE ord = 0 AND (page <> 1 OR block_index <> 0)),
segs AS (
  SELECT p.document, CAST(ord + CASE WHEN l.document IS NULL THEN 0 ELSE 1 END AS INT) AS segment_index, fund, segment_type,
    p.page AS start_page, p.block_index AS start_block, end_page, end_block FROM placed p LEFT JOIN opening l ON l.document = p.document
  UNION ALL SELECT document, 0, NULL, 'shared', 1, 0, page, block_index FROM opening
  UNION ALL SELECT c.document, 0, CASE WHEN kind = 'single_fund' THEN 'owner of ' || c.document END,
    CASE WHEN kind = 'multi_fund' THEN 'shared' ELSE kind END, 1, 0, NULL, NULL FROM classes c
    LEFT JOIN (SELECT DISTINCT document FROM placed) p ON p.document = c.document WHERE p.document IS NULL)"""

SQL_SEGMENT_UNITS = """
tops AS (SELECT document, page, block_index, y FROM blocks),
unit_segs AS (SELECT u.*, s.segment_index FROM units u JOIN segs s ON s.document = u.document
    AND u.page >= s.start_page AND (s.end_page IS NULL OR u.page <= s.end_page)
    LEFT JOIN tops lo ON lo.document = s.document AND lo.page = s.start_page AND lo.block_index = s.start_block
    LEFT JOIN tops hi ON hi.document = s.document AND hi.page = s.end_page AND hi.block_index = s.end_block
    WHERE (u.page <> s.start_page OR lo.y IS NULL OR u.y >= lo.y)
      AND (s.end_page IS NULL OR u.page <> s.end_page OR hi.y IS NULL OR u.y < hi.y)),
bodies AS (SELECT document, segment_index, median(font_size) AS body_size FROM unit_segs
    WHERE source_type = 'text' AND font_size > 0 GROUP BY ALL)"""


def sql_heading(text: str, words: str) -> str:
    labels = "'name','life','office','status','currency','legal form','date of incorporation','stock exchange listing'"
    return rf"""(source_type = 'text' AND {words} BETWEEN 1 AND 18
    AND NOT regexp_full_match({text}, '\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}')
    AND NOT regexp_full_match({text}, '\d{{1,2}}\s+[A-Za-z]+\s+\d{{4}}')
    AND NOT regexp_full_match({text}, '\(?\d+\)?[\s.:?-]*')
    AND NOT ({words} <= 2 AND {text} LIKE '%?') AND rtrim(lower({text}), ':') NOT IN ({labels})
    AND (regexp_matches({text}, '^\d+(?:\.\d+)*\.?\s+\S') OR coalesce(font_size >= body_size * 1.15, false)
      OR (bold AND {words} BETWEEN 2 AND 12)))"""


MAX_WORDS, MIN_WORDS, OVERLAP = 300, 80, 40
_LIMIT = MAX_WORDS - OVERLAP
SQL_PARTS = f"""
cut AS (SELECT *, string_split({sql_squeeze('text')}, ' ') AS w FROM unit_segs),
parts0 AS (SELECT document, segment_index, page, y, rank, idx, source_type, font_size, bold, k, text, w,
    len(w) > {_LIMIT} AS is_cut FROM cut, unnest(range(0, CAST(ceil(len(w) / {_LIMIT}.0) AS BIGINT))) t(k)),
parts1 AS (SELECT p.document, p.segment_index, page, source_type, font_size, bold, body_size,
    CASE WHEN is_cut THEN array_to_string(w[k * {_LIMIT} + 1:(k + 1) * {_LIMIT}], ' ') ELSE text END AS text,
    len(w[k * {_LIMIT} + 1:(k + 1) * {_LIMIT}]) AS words,
    row_number() OVER (PARTITION BY p.document, p.segment_index ORDER BY page, y, rank, idx, k) AS n
    FROM parts0 p LEFT JOIN bodies b ON b.document = p.document AND b.segment_index = p.segment_index),
parts AS (SELECT *, {sql_heading(sql_squeeze('text'), 'words')} AS heading FROM parts1)"""

SQL_PACK = f"""
steps AS (
  SELECT document, segment_index, n, words AS held, 0 AS closed, 0 AS closed_words FROM parts WHERE n = 1
  UNION ALL
  SELECT p.document, p.segment_index, p.n,
    CASE WHEN p.heading AND s.held >= {MIN_WORDS} THEN p.words
         WHEN s.held + p.words > {MAX_WORDS} THEN least({OVERLAP}, s.held) + p.words ELSE s.held + p.words END,
    s.closed + CASE WHEN (p.heading AND s.held >= {MIN_WORDS}) OR s.held + p.words > {MAX_WORDS} THEN 1 ELSE 0 END,
    s.held
  FROM steps s JOIN parts p ON p.document = s.document AND p.segment_index = s.segment_index AND p.n = s.n + 1),
ends AS (SELECT document, segment_index, max(n) AS last_n FROM parts GROUP BY ALL),
sizes AS (
  SELECT s.document, s.segment_index, s.closed - 1 AS chunk_number, s.closed_words AS word_count FROM steps s
    LEFT JOIN steps b ON b.document = s.document AND b.segment_index = s.segment_index AND b.n = s.n - 1
    WHERE s.n > 1 AND s.closed > b.closed
  UNION ALL SELECT s.document, s.segment_index, s.closed, s.held FROM steps s
    JOIN ends e ON e.document = s.document AND e.segment_index = s.segment_index AND e.last_n = s.n),
chunk_sizes AS (SELECT document || '::segment_' || printf('%03d', segment_index) || '::chunk_' || printf('%03d', chunk_number) AS chunk_id,
    document, segment_index, CAST(word_count AS INT) AS word_count FROM sizes)"""


#: Whole chunks from word ranges: what a part has in a later chunk than its first is joined by spaces.
SQL_CHUNK_TEXTS = f"""
pos AS (SELECT *, sum(words) OVER w - words AS s, last_value(CASE WHEN heading THEN {sql_squeeze('text')} END IGNORE NULLS) OVER w AS section
    FROM parts WINDOW w AS (PARTITION BY document, segment_index ORDER BY n)),
ranges AS (
  SELECT s.document, s.segment_index, s.closed - 1 AS number, p.s - s.closed_words AS a, p.s AS b FROM steps s
    JOIN pos p ON p.document = s.document AND p.segment_index = s.segment_index AND p.n = s.n
    LEFT JOIN steps o ON o.document = s.document AND o.segment_index = s.segment_index AND o.n = s.n - 1
    WHERE s.n > 1 AND s.closed > o.closed
  UNION ALL SELECT s.document, s.segment_index, s.closed, p.s + p.words - s.held, p.s + p.words FROM steps s
    JOIN ends e ON e.document = s.document AND e.segment_index = s.segment_index AND e.last_n = s.n
    JOIN pos p ON p.document = s.document AND p.segment_index = s.segment_index AND p.n = s.n),
pieces AS (SELECT p.*, r.number, greatest(a - s, 0) AS skip, least(b, s + words) - greatest(a, s) AS take,
    r.number > min(r.number) OVER (PARTITION BY p.document, p.segment_index, p.n) AS carried
    FROM pos p JOIN ranges r ON r.document = p.document AND r.segment_index = p.segment_index AND s < b AND s + words > a),
named AS (SELECT document, segment_index, number, section, min(n) AS n FROM pieces WHERE section IS NOT NULL GROUP BY ALL),
last_named AS (SELECT document, segment_index, number, arg_max(section, n) AS section FROM named GROUP BY ALL),
texts AS (SELECT document, segment_index, number, CAST(min(page) AS INT) AS page_start, CAST(max(page) AS INT) AS page_end, CAST(sum(take) AS INT) AS word_count,
    array_to_string(list_sort(list(DISTINCT source_type)), ',') AS source_types,
    string_agg(CASE WHEN carried THEN array_to_string(string_split({sql_squeeze('text')}, ' ')[skip + 1:skip + take], ' ') ELSE text END, chr(10) || chr(10) ORDER BY n) AS text
    FROM pieces GROUP BY ALL),
whole_chunks AS (SELECT t.document || '::segment_' || printf('%03d', t.segment_index) || '::chunk_' || printf('%03d', t.number) AS chunk_id, t.document, g.fund,
    g.segment_type, t.segment_index, n.section, page_start, page_end, word_count, source_types, text
    FROM texts t JOIN segs g ON g.document = t.document AND g.segment_index = t.segment_index
    LEFT JOIN last_named n ON n.document = t.document AND n.segment_index = t.segment_index AND n.number = t.number)"""


def ctes(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(p.strip() for p in parts) + "\n"
