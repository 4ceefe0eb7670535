"""Questions to cited answers: balanced retrieval, prompt budget, generation, validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import assembly
from folioscope.operators.names import detect_entities, strip_entities
from folioscope.operators.postings import TABLES, load_lexical_index
from folioscope.operators.topk import interleave
from folioscope.plans.index import stored_vectors
from folioscope.plans.retrieve import Retriever
from folioscope.session import durable
from folioscope.sources.artifacts import exists, read_table, require_artifacts


class Assistant:
    """Answers a batch of questions ``query_id, query`` (plus ``query_vector`` if not encoded here)."""

    def __init__(
        self, retriever: Retriever, load_generator: Callable[[], assembly.Generate], top_k: int = 6,
        mode: str = "auto", k_per_fund: int = 4, max_chunks: int = 6,
        max_chars_per_chunk: int = 4500, max_total_chars: int = 22000,
    ):
        self.retriever, self.load_generator = retriever, load_generator
        self.top_k, self.mode, self.k_per_fund = top_k, mode, k_per_fund
        self.budget = (max_chunks, max_chars_per_chunk, max_total_chars)

    def retrieve(self, queries: DataFrame) -> DataFrame:
        """Rows per query in prompt order (``position``).

        Questions naming several entities retrieve per entity and interleave, so that no entity
        crowds out another; all others retrieve once.
        """
        named = durable(detect_entities(queries, self.retriever.registry))
        several = F.size("query_funds") > 1
        one = self.retriever.retrieve(named.filter(~several), self.top_k, self.mode)
        one = one.withColumn("fund_order", F.lit(0)).withColumn("position", F.col("rank"))
        multi = named.filter(several)
        if not multi.isEmpty():
            stripped = strip_entities(multi, self.retriever.registry).drop("query").withColumnRenamed(
                "search_query", "query"
            )
            per_fund = self.retriever.retrieve_per_fund(stripped, self.k_per_fund, self.mode)
            one = one.unionByName(interleave(per_fund, ["query_id"], "rank", "fund_order"))
        return assembly.dedupe_results(one)

    def evidence(self, queries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Retrieved rows, evidence rows and prompts."""
        retrieved = durable(self.retrieve(queries))
        evidence = durable(assembly.evidence_rows(retrieved, *self.budget))
        return retrieved, evidence, assembly.prompts(queries, evidence)

    def answer(
        self, queries: DataFrame, debug: bool = False, keep_errors: bool = False, include_retrieved: bool = False
    ) -> DataFrame:
        """One result row per question; see ``assembly.results``."""
        retrieved, evidence, prompted = self.evidence(queries)
        generated = assembly.generate_answers(prompted, self.load_generator, keep_errors)
        # a generator call is expensive and not repeatable: keep its outcome
        generated = durable(assembly.validate_answers(generated, strict=not keep_errors))
        answers = generated.unionByName(assembly.unanswered(prompted))
        result = assembly.results(answers, assembly.cited_sources(answers, evidence), debug)
        return assembly.with_retrieved(result, retrieved) if include_retrieved else result

    def ask(self, queries: DataFrame) -> DataFrame:
        """The public JSON output; blank questions are refused."""
        blank = F.trim("query") == ""
        checked = queries.withColumn(
            "query", F.when(blank, F.raise_error(F.lit("Question cannot be empty.")).cast("string")).otherwise(F.trim("query"))
        )
        return assembly.answer_json(self.answer(checked))


def load_retriever(spark: SparkSession, root: str, **options) -> Retriever:
    """Retriever over a stored corpus; the model name comes from the index metadata."""
    require_artifacts(spark, root)
    model = read_table(spark, root, "index_metadata").first().model_name
    if "lexical" not in options and exists(spark, f"{root.rstrip('/')}/{TABLES[0]}"):
        options = {"index": load_lexical_index(spark, root), **options}
    return Retriever(
        read_table(spark, root, "chunks"), read_table(spark, root, "registry"),
        stored_vectors(spark, root), model_name=model, **options,
    )


def build_assistant(spark: SparkSession, root: str, load_generator, top_k: int = 6, **options) -> Assistant:
    return Assistant(load_retriever(spark, root, **options), load_generator, top_k=top_k)
