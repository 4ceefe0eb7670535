import json

from folioscope.operators.lexical import shared_token_rank
from folioscope.plans.assistant import Assistant
from folioscope.plans.retrieve import Retriever


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def test_candidates_come_from_lists_and_labels_only(corpus):
    names = {r.name for r in corpus.candidates.collect()}
    assert names == {"Maple Growth Fund", "Willow Bond Fund"}


def test_documents_are_classified(corpus):
    kinds = {r.document: (r.document_type, r.primary_fund) for r in corpus.classifications.collect()}
    assert kinds == {
        "handbook.pdf": ("multi_fund", None),
        "leaflet.pdf": ("single_fund", "Maple Growth Fund"),
        "rights.pdf": ("no_fund", None),
    }


def test_segments_tile_the_document(corpus):
    got = corpus.segments.filter("document = 'handbook.pdf'").orderBy("segment_index").collect()
    assert [(s.fund, s.segment_type, s.start_page, s.start_block, s.end_page, s.end_block, s.scope) for s in got] == [
        (None, "shared", 1, 0, 2, 0, "general"),
        ("Maple Growth Fund", "fund_section", 2, 0, 3, 0, "fund"),
        ("Willow Bond Fund", "fund_section", 3, 0, None, None, "fund"),
    ]


def test_chunks_stay_inside_segments_and_are_ordered(corpus):
    got = corpus.chunks.orderBy("chunk_ord").collect()
    assert [c.chunk_ord for c in got] == list(range(len(got)))
    assert all("Willow" not in c.text for c in got if c.fund == "Maple Growth Fund")
    shared = next(c for c in got if c.document == "handbook.pdf" and c.fund is None)
    assert shared.source_types == ["table", "text"] and "Maple Growth Fund | 2" in shared.text
    assert shared.chunk_id == "handbook.pdf::segment_000::chunk_000"


def test_question_to_cited_answer(spark, corpus):
    def answer_from_first():
        def generate(prompt):
            assert "[E1]" in prompt
            answer = {"status": "supported", "answer": "Yes, within the law.", "evidence_ids": ["E1", "E1"]}
            return answer, json.dumps(answer)

        return generate

    retriever = Retriever(corpus.chunks, corpus.registry, lexical=shared_token_rank)
    assistant = Assistant(retriever, answer_from_first, top_k=4, mode="lexical")
    queries = spark.createDataFrame(
        [("q1", "May holders pass units to a person?"), ("q2", "zzz qqq"),
         ("q3", "Compare the objective of Maple Growth Fund and Willow Bond Fund")],
        "query_id STRING, query STRING",
    )
    result = {r.query_id: r for r in assistant.answer(queries).collect()}
    assert result["q1"].status == "supported" and result["q1"].evidence_ids == ["E1"]
    source = result["q1"].sources[0]
    assert (source.document, source.page, source.section, source.fund) == ("rights.pdf", "1", "Passing on units", None)
    assert result["q2"].status == "not_found" and result["q2"].sources == []
    shown = assistant.retrieve(queries).filter("query_id = 'q3'").orderBy("position").collect()
    assert [r.fund for r in shown][:2] == ["Maple Growth Fund", "Willow Bond Fund"]
    output = json.loads(assistant.ask(queries.filter("query_id = 'q1'")).first().output)
    assert output == {
        "answer": "Yes, within the law.", "funds": [],
        "sources": [{"document": "rights.pdf", "page": "1", "section": "Passing on units"}],
    }


def test_named_entity_routes_to_its_chunks(spark, corpus):
    retriever = Retriever(corpus.chunks, corpus.registry, lexical=shared_token_rank)
    queries = spark.createDataFrame([("a", "objective of Willow Bond Fund?")], "query_id STRING, query STRING")
    got = retriever.retrieve(queries, 3, "lexical").collect()
    assert {r.fund for r in got} == {"Willow Bond Fund"} and got[0].route == "fund"
    assert got[0].query_funds == ["Willow Bond Fund"] and "Willow" not in got[0].search_query


def test_stored_corpus_answers_in_auto_and_reranked_mode(spark, corpus, tmp_path):
    from folioscope.plans.assistant import build_assistant, load_retriever
    from folioscope.plans.index import load_or_build_vectors, save_corpus

    def encoder():
        return lambda texts: [[float(t.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]

    def generator():
        return lambda prompt: ({"status": "supported", "answer": "ok", "evidence_ids": ["E1"]}, "raw")

    def reranker():
        return lambda query, passages: [float(len(set(query.lower().split()) & set(p.lower().split()))) for p in passages]

    root = str(tmp_path)
    save_corpus(corpus, root)
    load_or_build_vectors(spark, corpus.chunks, root, encoder)
    assistant = build_assistant(spark, root, generator, load_encoder=encoder)
    q = spark.createDataFrame([("q", "May holders pass their units to any other person?")], "query_id STRING, query STRING")
    row = assistant.answer(q, debug=True, include_retrieved=True).first()
    assert row.sources[0].document == "rights.pdf" and row.raw_model_output == "raw"
    assert row.retrieved[0].document == "rights.pdf" and "QUESTION:\nMay holders" in row.prompt
    again = load_retriever(spark, root, load_encoder=encoder)
    lexical = again.retrieve(q, 3, "lexical")
    fresh = Retriever(again.chunks.drop("lexical_text", "candidate_language"), again.registry).retrieve(q, 3, "lexical")
    rows = lambda df: [(r["rank"], r.chunk_ord, r.bm25_score, r.candidate_language) for r in df.orderBy("rank").collect()]
    assert rows(lexical) == rows(fresh) and len(rows(lexical)) > 0
    assert "tokens" not in again.__dict__ and "tokens" not in assistant.retriever.__dict__  # a second start tokenises nothing
    ranked = load_retriever(spark, root, load_encoder=encoder, load_reranker=reranker).retrieve(q, 2, "reranked").collect()
    assert min(ranked, key=lambda r: r["rank"]).document == "rights.pdf"
    assert all(r.fund is None and r.effective_mode == "reranked" and r.candidate_dense_rank for r in ranked)
