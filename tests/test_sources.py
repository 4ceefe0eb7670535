import pytest
from pyspark.sql import functions as F

from folioscope.functions.text import model_prefixes
from folioscope.operators import evaluation
from folioscope.plans.index import load_or_build_vectors
from folioscope.plans.ingest import run_ingestion
from folioscope.sources import artifacts, files, layout
from folioscope.streaming.ingest import append_pages, stream_text_pages


@pytest.fixture()
def folder(tmp_path):
    inside = tmp_path / "in"
    inside.mkdir()
    (inside / "a.txt").write_text("Alpha line\nsecond", encoding="utf-8")
    (inside / "b.TXT").write_bytes(b"Beta \xff end")
    (inside / "c.docx").write_bytes(b"no")
    return inside


def test_text_files_become_single_page_documents(spark, folder, tmp_path):
    out = str(tmp_path / "parsed")
    pages = run_ingestion(spark, str(folder), out).orderBy("document").collect()
    assert [(p.document, p.page, p.text) for p in pages] == [("a.txt", 1, "Alpha line\nsecond"), ("b.TXT", 1, "Beta � end")]
    assert pages[0].text_blocks[0].text == pages[0].text_for_rag and pages[0].text_blocks[0].bbox is None
    back = artifacts.read_documents_json(spark, out).orderBy("document").collect()
    assert [(p.document, p.text) for p in back] == [(p.document, p.text) for p in pages]


def test_unsupported_files_fail(spark, folder):
    every = spark.read.format("binaryFile").load(str(folder))
    with pytest.raises(Exception, match="Unsupported file type: .docx"):
        files.require_supported(every).select("path").collect()


def test_stream_appends_the_same_pages(spark, folder, tmp_path):
    target = str(tmp_path / "table")
    for _ in range(2):
        append_pages(stream_text_pages(spark, str(folder)), target, str(tmp_path / "ckpt")).awaitTermination(60)
    assert [r.document for r in spark.read.parquet(target).orderBy("document").collect()] == ["a.txt", "b.TXT"]


def test_layout_rules(spark):
    spans = [(" Big ", 12.0, 0), ("  ", 30.0, 16), ("title", 9.0, 20)]
    blocks = [(0, [0.0] * 4, [(spans,)]), (1, [0.0] * 4, [(spans,)]), (0, [0.0] * 4, [([(" ", 1.0, 0)],)])]
    tables = [([0.0, 0.0, 10.0, 10.0], [["a ", None], [None, ""], ["b\nc", "1"]]), ([0.0] * 4, [["only", "one"]])]
    df = spark.createDataFrame(
        [("d.pdf", 1, " text ", blocks, tables)],
        f"document STRING, page INT, text STRING, raw_blocks ARRAY<{layout.RAW_BLOCK}>, raw_tables ARRAY<STRUCT<bbox: ARRAY<DOUBLE>, rows: ARRAY<ARRAY<STRING>>>>",
    )
    r = layout.assemble_pages(df).first()
    assert [(b.text, b.font_size, b.bold) for b in r.text_blocks] == [("Big title", 12.0, True)]
    assert [t.rows for t in r.tables] == [[["a", ""], ["b c", "1"]]]
    assert r.text_for_rag == "text\n\na | \nb c | 1"


def test_chart_regions_and_rows(spark):
    regions = [[0.0, 0.0, 200.0, 100.0], [0.0, 0.0, 100.0, 100.0], [300.0, 0.0, 500.0, 100.0], [0.0, 200.0, 200.0, 300.0]]
    drawings = [([10.0, 10.0, 20.0, 20.0], 10), ([310.0, 10.0, 320.0, 20.0], 12), ([10.0, 210.0, 20.0, 220.0], 9)]
    tables = [([300.0, 0.0, 440.0, 100.0], [["x"]])]
    df = spark.createDataFrame(
        [(regions, drawings, tables)],
        "regions ARRAY<ARRAY<DOUBLE>>, drawings ARRAY<STRUCT<rect: ARRAY<DOUBLE>, items: INT>>, tables ARRAY<STRUCT<bbox: ARRAY<DOUBLE>, rows: ARRAY<ARRAY<STRING>>>>",
    )
    kept = df.select(layout.chart_regions(F.col("regions"), F.col("drawings"), F.col("tables"))).first()[0]
    assert [k["index"] for k in kept] == [1]
    charts = spark.createDataFrame([("d", 1, 1, [0.0] * 4, "i.png", b"x"), ("d", 1, 2, [0.0] * 4, "j.png", b"y")], "document STRING, page INT, index INT, bbox ARRAY<DOUBLE>, image STRING, png BINARY")

    def loader():
        return lambda png: "TITLE | t<0x0A>2021 | 1%<0x0A>noise\n2022 | 2%" if png == b"x" else "only | one"

    got = layout.decode_charts(charts, loader).first().charts
    assert [c.rows for c in got] == [[["2021", "1%"], ["2022", "2%"]]]


def test_table_shapes(spark):
    df = spark.createDataFrame([('[["a","b"]]',), ('{"data": [["c"]]}',), ('{"cells": [["d"]], "x": 1}',), ('{"rows": "no"}',)], "raw STRING")
    assert [r[0] for r in df.select(artifacts.table_rows_of()).collect()] == [[["a", "b"]], [["c"]], [["d"]], []]


def test_vectors_are_reused_until_the_chunks_change(spark, tmp_path):
    chunks = spark.createDataFrame([(0, "1", "A", "alpha", None), (1, "2", "B", "beta", "f")], "chunk_ord BIGINT, chunk_id STRING, section STRING, text STRING, fund STRING")
    loader = lambda: lambda texts: [[1.0, float(len(t)), 0.5] for t in texts]
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError, match="vectors"):
        artifacts.require_artifacts(spark, root)
    first, built = load_or_build_vectors(spark, chunks, root, loader)
    assert built and first.count() == 2
    assert not load_or_build_vectors(spark, chunks, root, loader)[1]
    assert load_or_build_vectors(spark, chunks.withColumn("text", F.lit("new")), root, loader)[1]
    unit = first.select(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).collect()
    assert all(abs(u[0] - 1) < 1e-5 for u in unit)
    assert model_prefixes("intfloat/Multilingual-E5-base") == ("query: ", "passage: ")


def test_only_changed_chunks_are_embedded_again(spark, tmp_path):
    """After one text changed, one row went and one came first in the order, only the two new texts reach the encoder."""
    schema = "chunk_ord BIGINT, chunk_id STRING, section STRING, text STRING, fund STRING"
    rows = [(k, f"doc::{k}", "s", f"text {k}", None) for k in range(600)]
    chunks = spark.createDataFrame(rows, schema)
    loader = lambda: lambda texts: [[1.0, float(len(t)), 0.5] for t in texts]
    asked = tmp_path / "asked"
    asked.mkdir()

    def counting():
        import uuid

        def encode(texts):
            (asked / uuid.uuid4().hex).write_text("\n".join(texts))
            return [[1.0, float(len(t)), 0.5] for t in texts]

        return encode

    root = str(tmp_path / "index")
    load_or_build_vectors(spark, chunks, root, loader)
    later = [(0, "doc::new", "s", "fresh", None)] + [(k, f"doc::{k}", "s", "changed text" if k == 77 else f"text {k}", None) for k in range(1, 600)]
    vectors, built = load_or_build_vectors(spark, spark.createDataFrame(later, schema), root, counting)
    sent = [line for f in asked.iterdir() for line in f.read_text().split("\n") if line]
    assert built and len(sent) == 4 and sum("changed text" in x for x in sent) == sum("fresh" in x for x in sent) == 1  # a section and a text each
    got = {r.chunk_id: r for r in vectors.collect()}
    assert len(got) == 600 and got["doc::new"].chunk_ord == 0 and "doc::0" not in got
    scratch, _ = load_or_build_vectors(spark, spark.createDataFrame(later, schema), str(tmp_path / "other"), loader)
    assert {r.chunk_id: (r.chunk_ord, r.embedding) for r in scratch.collect()} == {k: (r.chunk_ord, r.embedding) for k, r in got.items()}


def test_trees_are_compared_by_differing_nodes(spark):
    from folioscope.operators import fingerprint as P

    old = spark.createDataFrame([(f"c{k}", "s", f"t{k}") for k in range(400)], "chunk_id STRING, section STRING, text STRING")
    new = old.where("chunk_id <> 'c5'").withColumn("text", F.when(F.col("chunk_id").isin("c9", "c200"), "other").otherwise(F.col("text")))
    new = new.unionByName(spark.createDataFrame([("d1", None, None)], new.schema))
    trees = [(P.digest_nodes(x, 2), x) for x in (P.digest_leaves(old), P.digest_leaves(new))]
    assert sorted(r.chunk_id for r in P.changed_chunks(*trees[0], *trees[1], 2).collect()) == ["c200", "c9", "d1"]
    assert P.changed_chunks(*trees[0], *trees[0], 2).count() == 0
    assert [P.tree_depth(n) for n in (0, 4096, 4097, 10**9)] == [1, 1, 2, 6]


def test_row_recall_respects_cell_borders(spark):
    from conftest import page, table
    from folioscope import schemas

    pages = spark.createDataFrame([page("d", 1, [], [table([["a  b", "C"], ["x", "y"]])])], schemas.PAGES)
    gold = spark.createDataFrame([("d", 1, ["A b", "c"]), ("d", 1, ["a", "b c"])], "document STRING, page INT, row ARRAY<STRING>")
    assert [r.matched for r in evaluation.row_recall(pages, gold).orderBy(F.element_at("row", 2).desc()).collect()] == [True, False]
