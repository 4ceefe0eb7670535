import pytest
from pyspark.sql import functions as F

from folioscope.operators import assembly

ROWS = "query_id STRING, position INT, chunk_id STRING, document STRING, page_start INT, page_end INT, section STRING, fund STRING, text STRING"


def test_budget_counts_used_characters(spark):
    rows = [("q", i, str(i), "doc", i, i, None, "F", c * 100) for i, c in enumerate("xyz", start=1)]
    rows.append(("q", 0, "1", "doc", 1, 1, None, "F", "first copy wins  "))
    df = spark.createDataFrame(rows, ROWS)
    got = assembly.evidence_rows(df, 2, 30, 40).orderBy("evidence_ord").collect()
    assert [(e.evidence_id, e.used_text) for e in got] == [("E1", "first copy wins"), ("E2", "y" * 25)]
    q = spark.createDataFrame([("q", "Why?"), ("z", "Nothing?")], "query_id STRING, query STRING")
    prompts = {r.query_id: r.prompt for r in assembly.prompts(q, assembly.evidence_rows(df, 2, 30, 40)).collect()}
    assert "[E2]\nFund: F\nDocument: doc\nPage: 2\nSection: None\nText:\n" + "y" * 25 in prompts["q"]
    assert "[E3]" not in prompts["q"] and prompts["z"].endswith("EVIDENCE:\n" + assembly.NO_EVIDENCE)


def test_blank_evidence_is_not_numbered(spark):
    rows = [("q", 1, "a", "d", 1, 1, None, None, " \n "), ("q", 2, "b", "d", 1, 2, None, None, "text")]
    got = assembly.evidence_rows(spark.createDataFrame(rows, ROWS)).collect()
    assert [(e.evidence_id, e.chunk_id, e.page) for e in got] == [("E1", "b", "1-2")]


@pytest.mark.parametrize(
    "status, ids, message",
    [("supported", ["E9"], "not retrieved: E9"), ("supported", [], "at least one"), ("conflicting", ["E1", "E1"], "at least two")],
)
def test_bad_citations_are_refused(spark, status, ids, message):
    df = spark.createDataFrame([("q", status, ids, ["E1", "E2"])], "query_id STRING, status STRING, evidence_ids ARRAY<STRING>, supplied_ids ARRAY<STRING>")
    with pytest.raises(Exception, match=message):
        assembly.validate_answers(df).select(F.col("status")).collect()
    assert message in assembly.validate_answers(df, strict=False).first().error


def test_failing_generator_can_become_rows(spark):
    prompted = spark.createDataFrame([("q", "Why?", "p", ["E1"])], "query_id STRING, query STRING, prompt STRING, evidence_ids ARRAY<STRING>")

    def loader():
        def generate(prompt):
            raise RuntimeError("busy")

        return generate

    row = assembly.generate_answers(prompted, loader, keep_errors=True).first()
    assert row.error == "busy" and row.status is None
