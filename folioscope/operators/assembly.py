"""Evidence assembly, prompt text, answer validation and source projection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import SPACE, page_label, strip
from folioscope.operators.topk import chunk_identity, first_wins, top_k

STATUSES = ("supported", "not_found", "ambiguous", "conflicting")
NO_EVIDENCE = "[NO EVIDENCE RETRIEVED]"
NOT_FOUND = "The requested information was not found in the provided documents."
# Fixed value: the instruction text placed before every question.
INSTRUCTIONS = """You are a fund-documentation question answering assistant.

Use ONLY the supplied evidence. Do not use outside knowledge.

Requirements:
1. Keep facts for different funds separate.
2. Answer in the same language as the user's question unless explicitly asked otherwise.
3. If the evidence does not contain the requested information, use status="not_found".
4. If the question is genuinely ambiguous and the evidence cannot resolve it, use status="ambiguous".
5. If supplied evidence materially disagrees, use status="conflicting" and explain the disagreement.
6. Never invent a fund, fact, number, document, page, section, or citation.
7. Cite only evidence IDs that directly support the answer.
8. A supported answer must cite at least one evidence ID.
9. Be concise but include all information necessary to answer the question.
"""

ITEM_COLUMNS = ("chunk_id", "document", "page_start", "page_end", "section", "fund", "text")


def dedupe_results(rows: DataFrame, keys: tuple[str, ...] = ("query_id",), order: str = "position") -> DataFrame:
    """First occurrence of every chunk per query."""
    return first_wins(rows, list(keys), chunk_identity(), [F.col(order)])


def evidence_rows(
    retrieved: DataFrame, max_chunks: int = 6, max_chars_per_chunk: int = 4500, max_total_chars: int = 22000
) -> DataFrame:
    """Evidence per query: first ``max_chunks`` distinct rows, cut to the character budgets.

    The budget is a fold because trimming a slice frees characters for the next one; it runs
    over at most ``max_chunks`` items per query.
    """
    first = top_k(dedupe_results(retrieved), ["query_id"], [F.col("position")], max_chunks, "_n")
    items = first.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("_n", *ITEM_COLUMNS))).alias("items")
    )
    trail = rf"[{SPACE}]+\z"

    def cut(item: Column, used: Column) -> Column:
        room = F.least(F.lit(max_chars_per_chunk), F.lit(max_total_chars) - used)
        body = strip(F.coalesce(item["text"], F.lit("")))
        return F.regexp_replace(F.left(body, room), trail, "")

    def with_text(item: Column, used: Column) -> Column:
        return item.withField("used_text", cut(item, used))

    empty = F.filter(
        F.transform("items", lambda i: i.withField("used_text", F.lit(""))), lambda i: F.lit(False)
    )
    start = F.struct(F.lit(0).alias("used"), empty.alias("kept"))

    def step(acc: Column, item: Column) -> Column:
        text = cut(item, acc["used"])
        grown = F.struct(
            (acc["used"] + F.length(text)).alias("used"),
            F.array_append(acc["kept"], with_text(item, acc["used"])).alias("kept"),
        )
        return F.when((acc["used"] >= max_total_chars) | (text == ""), acc).otherwise(grown)

    kept = F.aggregate("items", start, step, lambda acc: acc["kept"])
    rows = items.select("query_id", F.posexplode(kept).alias("pos", "item"))
    return rows.select(
        "query_id", (F.col("pos") + 1).alias("evidence_ord"),
        F.concat(F.lit("E"), (F.col("pos") + 1).cast("string")).alias("evidence_id"),
        *[F.col(f"item.{c}").alias(c) for c in ITEM_COLUMNS],
        F.col("item.used_text").alias("used_text"),
        page_label(F.col("item.page_start"), F.col("item.page_end")).alias("page"),
    )


def prompts(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """``query_id, query, prompt, evidence_ids`` for every query, with or without evidence."""
    shown = lambda c: F.coalesce(F.col(c), F.lit("None"))
    block = F.concat(
        F.lit("["), F.col("evidence_id"), F.lit("]\nFund: "), shown("fund"), F.lit("\nDocument: "),
        shown("document"), F.lit("\nPage: "), shown("page"), F.lit("\nSection: "), shown("section"),
        F.lit("\nText:\n"), F.col("used_text"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("evidence_ord", "evidence_id", block.alias("block"))))
    grouped = evidence.groupBy("query_id").agg(ordered.alias("_e")).select(
        "query_id",
        F.transform("_e", lambda e: e["evidence_id"]).alias("evidence_ids"),
        F.array_join(F.transform("_e", lambda e: e["block"]), "\n\n").alias("_blocks"),
    )
    return queries.select("query_id", "query").join(grouped, "query_id", "left").select(
        "query_id", "query",
        F.concat(
            F.lit(INSTRUCTIONS + "\n\nQUESTION:\n"), F.col("query"), F.lit("\n\nEVIDENCE:\n"),
            F.coalesce("_blocks", F.lit(NO_EVIDENCE)),
        ).alias("prompt"),
        F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"),
    )


def answer_error(status: Column, cited: Column, supplied: Column) -> Column:
    """Why an answer is unacceptable, or NULL. ``cited`` must already be distinct."""
    unknown = F.array_except(cited, supplied)
    return (
        F.when(~status.isin(*STATUSES), F.concat(F.lit("unknown status: "), status))
        .when(
            F.size(unknown) > 0,
            F.concat(F.lit("cited evidence that was not retrieved: "), F.array_join(unknown, ", ")),
        )
        .when(
            (status == "supported") & (F.size(cited) == 0),
            F.lit("a supported answer must cite at least one retrieved evidence item"),
        )
        .when(
            (status == "conflicting") & (F.size(cited) < 2),
            F.lit("a conflicting answer must cite at least two competing evidence items"),
        )
    )


def validate_answers(answers: DataFrame, strict: bool = True) -> DataFrame:
    """De-duplicate citations and check them against ``supplied_ids``.

    ``strict`` fails the job on the first bad answer; otherwise the reason lands in ``error``.
    """
    distinct = answers.withColumn("evidence_ids", F.array_distinct("evidence_ids"))
    error = answer_error(F.col("status"), F.col("evidence_ids"), F.col("supplied_ids"))
    if not strict:
        return distinct.withColumn("error", F.coalesce("error", error) if "error" in answers.columns else error)
    checked = F.when(error.isNull(), F.col("status")).otherwise(F.raise_error(error).cast("string"))
    return distinct.withColumn("status", checked)


Generate = Callable[[str], tuple[dict, str]]


def generate_answers(
    prompted: DataFrame, load_generator: Callable[[], Generate], keep_errors: bool = False
) -> DataFrame:
    """Run an external generator over prompts that have evidence.

    ``load_generator`` runs once per task and returns ``prompt -> (answer, raw)`` where the
    answer has ``status``, ``answer`` and ``evidence_ids``. With ``keep_errors`` a failing call
    becomes a row with ``error`` and does not stop the job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        generate = load_generator()
        for batch in batches:
            rows = []
            for qid, query, prompt, supplied in batch.itertuples(index=False, name=None):
                begun, error = time.perf_counter(), None
                answer: dict = {"status": None, "answer": None, "evidence_ids": []}
                raw = None
                try:
                    answer, raw = generate(prompt)
                except Exception as exc:
                    if not keep_errors:
                        raise
                    error = str(exc)
                rows.append(
                    {
                        "query_id": qid, "query": query, "prompt": prompt, "supplied_ids": list(supplied),
                        "status": answer["status"], "answer": answer["answer"],
                        "evidence_ids": list(answer["evidence_ids"]), "raw_model_output": raw,
                        "error": error, "latency_s": time.perf_counter() - begun,
                    }
                )
            if rows:
                yield pd.DataFrame(rows)

    schema = (
        "query_id STRING, query STRING, prompt STRING, supplied_ids ARRAY<STRING>, status STRING, "
        "answer STRING, evidence_ids ARRAY<STRING>, raw_model_output STRING, error STRING, latency_s DOUBLE"
    )
    asked = prompted.filter(F.size("evidence_ids") > 0)
    return asked.select("query_id", "query", "prompt", "evidence_ids").mapInPandas(run, schema)


def unanswered(prompted: DataFrame) -> DataFrame:
    """The fixed reply for prompts without evidence; no generator is involved."""
    none = F.lit(None).cast("string")
    return prompted.filter(F.size("evidence_ids") == 0).select(
        "query_id", "query", "prompt", F.col("evidence_ids").alias("supplied_ids"),
        F.lit("not_found").alias("status"), F.lit(NOT_FOUND).alias("answer"), "evidence_ids",
        none.alias("raw_model_output"), none.alias("error"), F.lit(0.0).alias("latency_s"),
    )


def cited_sources(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per citation with its document, page, section, entity and chunk."""
    cited = answers.select("query_id", F.posexplode("evidence_ids").alias("source_ord", "evidence_id"))
    return cited.join(
        evidence.select("query_id", "evidence_id", "document", "page", "section", "fund", "chunk_id"),
        ["query_id", "evidence_id"],
    )


def results(answers: DataFrame, sources: DataFrame, debug: bool = False) -> DataFrame:
    """Answers with nested ``sources`` and the distinct entities they come from."""
    fields = ["evidence_id", "document", "page", "section", "fund", "chunk_id"]
    grouped = sources.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("source_ord", *fields))).alias("_s")
    ).select(
        "query_id",
        F.transform("_s", lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias("sources"),
        F.array_distinct(
            F.filter(F.transform("_s", lambda s: s["fund"]), lambda f: F.coalesce(f, F.lit("")) != "")
        ).alias("funds"),
    )
    source_type = "array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>"
    shown = ["query_id", "query", "status", "answer", "funds", "sources", "evidence_ids"]
    return (
        answers.join(grouped, "query_id", "left")
        .withColumn("sources", F.coalesce(F.col("sources").cast(source_type), F.array().cast(source_type)))
        .withColumn("funds", F.coalesce("funds", F.array().cast("array<string>")))
        .select(*shown, *(["prompt", "raw_model_output"] if debug else []), *(["error"] if "error" in answers.columns else []))
    )


def with_retrieved(result_rows: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Add the retrieved rows of each query as an array in prompt order (a few rows per query)."""
    rows = retrieved.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("position", *ITEM_COLUMNS))).alias("retrieved")
    )
    return result_rows.join(rows, "query_id", "left")


def answer_json(result_rows: DataFrame) -> DataFrame:
    """The public output: answer, entities and ``document, page, section`` of each source."""
    sources = F.transform("sources", lambda s: F.struct(s["document"].alias("document"), s["page"].alias("page"), s["section"].alias("section")))
    payload = F.struct("answer", "funds", sources.alias("sources"))
    return result_rows.select("query_id", F.to_json(payload, {"ignoreNullFields": "false"}).alias("output"))
