"""Quality metrics of every stage, as joins and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import fold_label, fold_plain, loose, sentences, squeeze
from folioscope.operators.ordered import page_bucket, with_neighbour, with_ordinal
from folioscope.operators.topk import top_k
from folioscope.sources.layout import rows_text

METRICS = ("source_hit", "evidence_coverage", "all_evidence", "rr")


def safe_ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))


# --- discovery -----------------------------------------------------------------------------

def set_scores(predicted: DataFrame, gold: DataFrame, name: str = "name") -> DataFrame:
    """One row with counts, precision, recall and F1 of two name sets under label folding."""
    p = predicted.select(fold_label(name).alias("k")).distinct().withColumn("p", F.lit(1))
    g = gold.select(fold_label(name).alias("k")).distinct().withColumn("g", F.lit(1))
    both = p.join(g, "k", "full_outer").agg(
        F.count("p").alias("n_distinct_predicted"), F.count("g").alias("n_distinct_gold"),
        F.count_if(F.col("p").isNull()).alias("missing"), F.count_if(F.col("g").isNull()).alias("extra"),
    )
    n_pred, n_gold = predicted.agg(F.count("*")).scalar(), gold.agg(F.count("*")).scalar()
    scored = both.withColumn("n_predicted", n_pred).withColumn("n_gold", n_gold)
    precision = safe_ratio(F.col("n_predicted") - F.col("extra"), F.col("n_predicted"))
    recall = safe_ratio(F.col("n_gold") - F.col("missing"), F.col("n_gold"))
    return scored.select(
        "n_predicted", "n_gold", "missing", "extra", precision.alias("precision"), recall.alias("recall"),
        safe_ratio(2 * precision * recall, precision + recall).alias("f1"),
    )


def set_differences(predicted: DataFrame, gold: DataFrame, name: str = "name") -> DataFrame:
    """``side, name`` of missing and extra names, one (the least) spelling for each folded name."""

    def spellings(names: DataFrame) -> DataFrame:
        return names.groupBy(fold_label(name).alias("k")).agg(F.min(name).alias(name))

    p, g = spellings(predicted), spellings(gold)
    missing = g.join(p, "k", "left_anti").select(F.lit("missing").alias("side"), name)
    return missing.unionByName(p.join(g, "k", "left_anti").select(F.lit("extra").alias("side"), name))


def registry_summary(registry: DataFrame) -> DataFrame:
    return registry.select(
        "canonical_name", F.array_join("aliases", " | ").alias("aliases"), "evidence_count"
    )


# --- segmentation ----------------------------------------------------------------------------

def anchor_recall(anchors: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold ``fund, page, segment_type`` rows with ``found``."""
    keys = ["fund", "page", "segment_type"]
    hits = anchors.select(*keys).distinct().withColumn("found", F.lit(True))
    return gold.join(hits, keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def suspicious_anchors(anchors: DataFrame) -> DataFrame:
    """An annex directly followed by a main section of the same entity."""
    placed = with_ordinal(anchors, ["document"], [F.col("page"), F.col("block_index")], page_bucket())
    after = with_neighbour(
        placed, ["document"], "ordinal", {"page": "_page", "segment_type": "_type", "fund": "_fund"}, 1
    )
    return after.filter(
        (F.col("segment_type") == "annex") & (F.col("_type") == "fund_section") & (F.col("_fund") == F.col("fund"))
    ).select("document", "fund", F.col("page").alias("annex_page"), F.col("_page").alias("later_fund_section_page"))


def segment_continuity(segments: DataFrame) -> DataFrame:
    """``document, continuous``: every segment ends where the next one starts."""
    after = with_neighbour(
        segments, ["document"], "segment_index", {"start_page": "_page", "start_block": "_block"}, 1
    ).filter(F.col("_page").isNotNull())
    good = F.col("end_page").eqNullSafe(F.col("_page")) & F.col("end_block").eqNullSafe(F.col("_block"))
    gaps = after.groupBy("document").agg(F.bool_and(good).alias("continuous"))
    return segments.select("document").distinct().join(gaps, "document", "left").withColumn(
        "continuous", F.coalesce("continuous", F.lit(True))
    )


def single_owner_checks(segments: DataFrame, classifications: DataFrame) -> DataFrame:
    """Single-entity documents: exactly one segment, owned by the primary entity."""
    counted = segments.groupBy("document").agg(
        F.count("*").alias("segment_count"), F.max("fund").alias("_fund")
    )
    single = classifications.filter(F.col("document_type") == "single_fund")
    return single.join(counted, "document", "left").select(
        "document", "primary_fund", F.coalesce("segment_count", F.lit(0)).alias("segment_count"),
        ((F.col("segment_count") == 1) & F.col("_fund").eqNullSafe(F.col("primary_fund"))).alias("correct"),
    )


# --- chunking --------------------------------------------------------------------------------

def describe_sizes(chunks: DataFrame, column: str = "word_count", max_words: int = 300, short: int = 50) -> DataFrame:
    """Count, moments, percentiles and limit violations of chunk sizes."""
    # percentiles combine as value counts, so memory follows distinct sizes and not rows
    points = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    return chunks.agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"), F.max(column).alias("max"),
        *[F.percentile(column, p).alias(n) for n, p in points.items()],
        F.count_if(F.col(column) > max_words).alias("above_max"),
        F.count_if(F.col(column) < short).alias("below_short"),
    )


def multi_segment_chunks(chunks: DataFrame) -> DataFrame:
    """Chunk ids that appear in more than one segment."""
    return (
        chunks.groupBy("chunk_id").agg(F.min("segment_index").alias("_lo"), F.max("segment_index").alias("_hi"))
        .filter(F.col("_lo") != F.col("_hi")).select("chunk_id")
    )


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Chunks per document and entity; entity-free chunks form their own group."""
    return chunks.groupBy("document", "fund").agg(F.count("*").alias("chunks"))


def chunks_in_pages(chunks: DataFrame, first: int, last: int | None = None) -> DataFrame:
    """Chunks touching a page range."""
    kept = chunks.filter(F.col("page_end") >= first)
    return kept if last is None else kept.filter(F.col("page_start") <= last)


# --- retrieval -------------------------------------------------------------------------------

def evaluate_retrieval(results: DataFrame, cases: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    """Per case: source hit, evidence coverage, first answer rank and reciprocal rank.

    ``cases``: ``query_id, expected_document, expected_fund, evidence_groups``. A group is found
    when any of its terms occurs in the joined text of the matching top-k rows.
    """
    top = results.filter(F.col(rank) <= k)
    text = fold_plain(F.concat_ws(" ", F.coalesce("section", F.lit("")), F.coalesce("text", F.lit(""))))
    matching = top.join(cases.select("query_id", "expected_document", "expected_fund"), "query_id").filter(
        ((F.coalesce("expected_document", F.lit("")) == "") | F.col("document").eqNullSafe(F.col("expected_document")))
        & ((F.coalesce("expected_fund", F.lit("")) == "") | F.col("fund").eqNullSafe(F.col("expected_fund")))
    ).select("query_id", F.col(rank).alias("_rank"), text.alias("_text"))
    gathered = matching.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("_rank", "_text"))).alias("_rows")
    )
    terms = (
        cases.select("query_id", F.posexplode("evidence_groups").alias("_group", "_terms"))
        .select("query_id", "_group", F.explode("_terms").alias("_term"))
        .withColumn("_term", fold_plain("_term"))
    )
    joined = terms.join(gathered, "query_id", "left")
    combined = F.array_join(F.transform("_rows", lambda r: r["_text"]), "\n")
    hits = F.filter("_rows", lambda r: F.contains(r["_text"], F.col("_term")))
    per_term = joined.select(
        "query_id", "_group", F.coalesce(F.contains(combined, F.col("_term")), F.lit(False)).alias("_found"),
        F.get(hits, F.lit(0))["_rank"].alias("_first"),
    )
    per_group = per_term.groupBy("query_id", "_group").agg(
        F.bool_or("_found").alias("_found"), F.min("_first").alias("_first")
    )
    per_case = per_group.groupBy("query_id").agg(
        F.avg(F.col("_found").cast("int")).alias("_coverage"), F.min("_first").alias("first_answer_rank")
    )
    return (
        cases.join(gathered.select("query_id", F.lit(True).alias("_hit")), "query_id", "left")
        .join(per_case, "query_id", "left")
        .withColumn("source_hit", F.coalesce("_hit", F.lit(False)))
        .withColumn("evidence_coverage", F.coalesce("_coverage", F.lit(1.0)))
        .withColumn("all_evidence", F.col("evidence_coverage") == 1.0)
        .withColumn("rr", F.coalesce(1.0 / F.col("first_answer_rank"), F.lit(0.0)))
        .drop("_hit", "_coverage")
    )


def summarise_retrieval(evaluated: DataFrame, by: str) -> DataFrame:
    """Mean metrics per mode or direction."""
    return evaluated.groupBy(by).agg(
        F.avg(F.col("source_hit").cast("int")).alias("source_recall"),
        F.avg("evidence_coverage").alias("mean_evidence_coverage"),
        F.avg(F.col("all_evidence").cast("int")).alias("full_evidence_recall"),
        F.avg("rr").alias("mrr"),
        F.count("*").alias("cases"),
    )


def compare_runs(base: DataFrame, other: DataFrame, key: str = "query_id") -> DataFrame:
    """Coverage and reciprocal-rank gains of a second run over the first."""
    a = base.select(key, F.col("evidence_coverage").alias("base_coverage"), F.col("rr").alias("base_rr"))
    b = other.select(key, F.col("evidence_coverage").alias("other_coverage"), F.col("rr").alias("other_rr"))
    return a.join(b, key).select(
        "*", (F.col("other_coverage") - F.col("base_coverage")).alias("coverage_gain"),
        (F.col("other_rr") - F.col("base_rr")).alias("rr_gain"),
    )


# --- generation ------------------------------------------------------------------------------

def prompt_checks(prompted: DataFrame, evidence: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Per query: chunk counts, unique ids, question present, documents present, length."""
    facts = evidence.groupBy("query_id").agg(
        F.count("*").alias("prompt_chunks"),
        (F.count("*") == F.count_distinct("evidence_id")).alias("unique_evidence_ids"),
        F.bool_and(F.col("document").isNotNull()).alias("has_document_metadata"),
    )
    found = retrieved.groupBy("query_id").agg(F.count("*").alias("retrieved_chunks"))
    return prompted.join(found, "query_id", "left").join(facts, "query_id", "left").select(
        "query_id", F.coalesce("retrieved_chunks", F.lit(0)).alias("retrieved_chunks"),
        F.coalesce("prompt_chunks", F.lit(0)).alias("prompt_chunks"),
        F.contains("prompt", "query").alias("query_present"),
        F.coalesce("unique_evidence_ids", F.lit(True)).alias("unique_evidence_ids"),
        F.coalesce("has_document_metadata", F.lit(True)).alias("has_document_metadata"),
        F.length("prompt").alias("prompt_chars"),
    )


def generation_checks(answers: DataFrame, sources: DataFrame, retrieved: DataFrame, cases: DataFrame) -> DataFrame:
    """Per case: call ok, status, expected terms, expected document and valid citations.

    ``cases``: ``query_id, expected_status, expected_document, expected_any_terms``.
    """
    cited = sources.join(
        retrieved.select("query_id", "chunk_id").distinct().withColumn("_known", F.lit(True)),
        ["query_id", "chunk_id"], "left",
    ).join(cases.select("query_id", "expected_document"), "query_id").groupBy("query_id").agg(
        F.count("*").alias("num_sources"),
        F.bool_and(F.coalesce("_known", F.lit(False))).alias("_valid"),
        F.bool_or(F.col("document").eqNullSafe(F.col("expected_document"))).alias("_doc"),
    )
    ok = F.col("error").isNull() & F.col("status").isNotNull()
    folded = loose(F.coalesce("answer", F.lit("")))
    terms = F.coalesce("expected_any_terms", F.array().cast("array<string>"))
    prepared = (
        cases.join(answers.drop("evidence_ids"), "query_id").join(cited, "query_id", "left")
        .withColumn("_answer", folded).withColumn("_terms", terms)
    )
    exploded = (
        prepared.select("query_id", F.explode("_terms").alias("_t"))
        .withColumn("_t", loose("_t")).join(prepared.select("query_id", "_answer"), "query_id")
        .groupBy("query_id").agg(F.bool_or(F.contains("_answer", F.col("_t"))).alias("_any"))
    )
    checked = prepared.join(exploded, "query_id", "left").select(
        "query_id", ok.alias("api_ok"), F.coalesce("status", F.lit("API_ERROR")).alias("status"),
        (ok & F.col("status").eqNullSafe(F.col("expected_status"))).alias("status_ok"),
        (ok & F.coalesce("_any", F.lit(True))).alias("answer_terms_ok"),
        (
            ok & ((F.coalesce("expected_document", F.lit("")) == "") | F.coalesce("_doc", F.lit(False)))
        ).alias("expected_document_ok"),
        (ok & F.coalesce("_valid", F.lit(True))).alias("citation_valid"),
        F.coalesce("num_sources", F.lit(0)).alias("num_sources"), "latency_s", "error",
    )
    return checked.withColumn(
        "all_checks",
        F.col("status_ok") & F.col("answer_terms_ok") & F.col("expected_document_ok") & F.col("citation_valid"),
    )


def summarise_generation(checks: DataFrame) -> DataFrame:
    """Pass rates over successful calls, failures counted apart."""
    among_ok = lambda c: F.avg(F.when(F.col("api_ok"), F.col(c).cast("int")))
    return checks.agg(
        F.count("*").alias("cases"), F.count_if("api_ok").alias("successful_api_calls"),
        F.count_if(~F.col("api_ok")).alias("api_failures"),
        among_ok("all_checks").alias("pass_rate_successful"),
        among_ok("status_ok").alias("status_accuracy_successful"),
        among_ok("citation_valid").alias("citation_validity_successful"),
        F.avg("latency_s").alias("mean_latency_s"),
    )


# --- ingestion -------------------------------------------------------------------------------

def document_health(pages: DataFrame) -> DataFrame:
    """Per document: pages, empty pages, characters, U+FFFD, tables, charts, images."""
    text = F.coalesce("text", F.lit(""))
    marks = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    blank = squeeze(text) == ""
    return pages.groupBy("document").agg(
        F.count("*").alias("parsed_pages"), F.count_if(blank).alias("empty_text_pages"),
        F.avg(blank.cast("int")).alias("empty_page_rate"),
        F.sum(marks).alias("replacement_chars"), F.sum(F.length(text)).alias("text_chars"),
        F.sum(F.size("tables")).alias("tables"), F.sum(F.size("charts")).alias("charts"),
        F.sum(F.size("images")).alias("images"),
    )


def page_coverage(health: DataFrame, expected: DataFrame) -> DataFrame:
    """Parsed against expected page counts; a document without expected pages counts as full."""
    return expected.join(health.select("document", "parsed_pages"), "document", "left").select(
        "document", "expected_pages", F.coalesce("parsed_pages", F.lit(0)).alias("parsed_pages"),
        F.when(F.col("expected_pages") == 0, 1.0).otherwise(
            F.coalesce("parsed_pages", F.lit(0)) / F.col("expected_pages")
        ).alias("page_coverage"),
    )


def phrase_recall(pages: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold ``document, page, phrase`` rows with ``found``."""
    keys = ["document", "page"]
    texts = pages.join(gold.select(*keys).distinct(), keys, "left_semi").select(*keys, loose("text").alias("_text"))
    return gold.withColumn("_phrase", loose("phrase")).join(texts, keys, "left").select(
        *keys, "phrase", F.coalesce(F.contains("_text", F.col("_phrase")), F.lit(False)).alias("found")
    )


def _cells(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda c: squeeze(c)), "\u241f", "")


def structured_rows(pages: DataFrame, kind: str = "tables") -> DataFrame:
    """Rows of all tables (or charts) of each page: ``document, page, position, row``."""
    every = F.flatten(F.transform(kind, lambda t: t["rows"]))
    return pages.select("document", "page", F.posexplode(every).alias("position", "row"))


def row_recall(pages: DataFrame, gold: DataFrame, kind: str = "tables") -> DataFrame:
    """Gold ``document, page, row`` with ``matched`` (same cells after loose folding)."""
    keys = ["document", "page"]
    have = structured_rows(pages.join(gold.select(*keys).distinct(), keys, "left_semi"), kind)
    have = have.select(*keys, loose(_cells(F.col("row"))).alias("_row")).distinct().withColumn("matched", F.lit(True))
    wanted = gold.withColumn("_row", loose(_cells(F.col("row"))))
    return wanted.join(have, [*keys, "_row"], "left").withColumn(
        "matched", F.coalesce("matched", F.lit(False))
    ).drop("_row")


def detection(pages: DataFrame, wanted: DataFrame, kind: str = "tables") -> DataFrame:
    """Listed pages with the number of detected items and whether there is any."""
    counts = pages.select("document", "page", F.size(kind).alias("_n"))
    return wanted.select("document", "page").distinct().join(counts, ["document", "page"], "left").select(
        "document", "page", F.coalesce("_n", F.lit(0)).alias("detections"),
        (F.coalesce("_n", F.lit(0)) > 0).alias("detected"),
    )


def chart_points(pages: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold ``document, page, key, value`` with ``correct``; a repeated key keeps its last value."""
    rows = structured_rows(pages.join(gold.select("document", "page").distinct(), ["document", "page"], "left_semi"), "charts")
    points = rows.filter(F.size("row") >= 2).select(
        "document", "page", "position", loose(F.get("row", F.lit(0))).alias("_key"), loose(F.get("row", F.lit(1))).alias("_value")
    ).groupBy("document", "page", "_key").agg(F.max_by("_value", "position").alias("_value"))
    return gold.withColumn("_key", F.col("key")).join(points, ["document", "page", "_key"], "left").select(
        "document", "page", "key", "value", F.coalesce(F.col("_value") == F.col("value"), F.lit(False)).alias("correct")
    )


def image_checks(images: DataFrame) -> DataFrame:
    """Per page: recall and decode rate from source, extracted and decoded image counts."""
    source, got, ok = (F.col(c) for c in ("source_unique_images", "extracted_unique_images", "decoded_images"))
    return images.withColumn(
        "recall", F.when(source == 0, 1.0).otherwise(F.least(got, source) / source)
    ).withColumn("decode_rate", F.when(got == 0, 1.0).otherwise(ok / got))


def rag_inclusion(pages: DataFrame) -> DataFrame:
    """Per page: are text, table rows and chart rows all inside ``text_for_rag``?"""
    keys = ["document", "page"]
    whole = pages.select(*keys, loose("text_for_rag").alias("_rag"), loose("text").alias("_text"), "tables", "charts")

    def all_inside(kind: str, name: str) -> DataFrame:
        rows = structured_rows(pages, kind).select(*keys, loose(F.array_join("row", " | ", "")).alias("_row"))
        return rows.join(whole.select(*keys, "_rag"), keys).groupBy(*keys).agg(
            F.bool_and(F.contains("_rag", F.col("_row"))).alias(name)
        )

    joined = whole.select(*keys, F.contains("_rag", F.col("_text")).alias("text_preserved"))
    for kind, name in (("tables", "tables_preserved"), ("charts", "charts_preserved")):
        joined = joined.join(all_inside(kind, name), keys, "left").withColumn(name, F.coalesce(name, F.lit(True)))
    return joined


def audit_sample(pages: DataFrame, seed: int = 42, per_document: int = 2, min_chars: int = 100, min_sentence: int = 60) -> DataFrame:
    """Reproducible spot-check: up to ``per_document`` pages with text and one sentence each.

    The draw is by MD5 of seed, document and page, so any engine repeats it and samples of parts of a corpus merge:
    the pages with the least digests stay, and each map task hands on no more than ``per_document`` of a document.
    """
    def drawn(number: int) -> Column:
        return F.md5(F.concat_ws("|", F.lit(str(number)), "document", F.col("page").cast("string")))

    texts = pages.select("document", "page", loose("text").alias("_text")).filter(F.length("_text") >= min_chars)
    chosen = top_k(texts.withColumn("_draw", drawn(seed)), ["document"], [F.col("_draw"), F.col("page")], per_document, "_n")
    long = F.filter(sentences("_text"), lambda s: F.length(s) >= min_sentence)
    at = (F.conv(F.left(drawn(seed + 1), F.lit(8)), 16, 10).cast("long") % F.greatest(F.size("_long"), F.lit(1))).cast("int")
    return chosen.withColumn("_long", long).select(
        "document", "page",
        F.left(
            F.when(F.size("_long") > 0, F.get("_long", at)).otherwise(F.left("_text", F.lit(300))), F.lit(500)
        ).alias("sample_text"),
        F.lit("").alias("human_check"),
    )


def page_text_rows(pages: DataFrame) -> DataFrame:
    """Tables of each page as text, one row per table."""
    return pages.select("document", "page", F.posexplode("tables").alias("position", "t")).select(
        "document", "page", "position", rows_text(F.col("t.rows")).alias("table_text")
    )
