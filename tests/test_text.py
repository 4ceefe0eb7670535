import unicodedata

from pyspark.sql import functions as F

from folioscope.functions import text as tx

SAMPLES = [
    "  Фонд „Пример“ : ", "Straße Nr. 5", "ﬁne №5 K&H egészség 2.", "", None, "a\tb\r\n c;", "x+y-z under_score 3.14",
    "ТЕКСТ mixed Text", " wide\x1cspace\x1f", "ΣΊΣΥΦΟΣ",
]


def plain(v):
    return " ".join(unicodedata.normalize("NFKC", v or "").split()).casefold()


def test_normal_forms_follow_python(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i INT, s STRING")
    got = df.select(
        "i", "s", tx.squeeze("s").alias("q"), tx.label("s").alias("l"), tx.fold_plain("s").alias("p"),
        tx.fold_label("s").alias("f"), tx.loose("s").alias("o"), tx.word_count("s").alias("n"),
        tx.detect_language("s").alias("lang"),
    ).orderBy("i").collect()
    for r in got:
        squeezed = " ".join((r.s or "").split())
        assert r.q == squeezed
        assert r.l == squeezed.strip(tx.LABEL_EDGES)
        assert r.p == plain(r.s)
        assert r.f == " ".join(unicodedata.normalize("NFKC", r.s or "").split()).strip(tx.LABEL_EDGES).casefold()
        assert r.o == " ".join((r.s or "").casefold().split())
        assert r.n == len((r.s or "").split())
    assert [r.lang for r in got] == ["bg", "en", "en", "mixed", "mixed", "en", "en", "en", "en", "mixed"]


def test_tokens_keep_inner_joiners(spark):
    df = spark.createDataFrame([("K&H egészség, 3.14 (net) co-op. x_1 Фонд-2!",)], "s STRING")
    assert df.select(tx.tokenize("s")).first()[0] == ["k&h", "egészség", "3.14", "net", "co-op", "x_1", "фонд-2"]


def test_page_labels(spark):
    df = spark.createDataFrame([(1, 1), (2, 5), (None, 4), (3, None), (None, None)], "a INT, b INT")
    got = [r[0] for r in df.select(tx.page_label(F.col("a"), F.col("b"))).collect()]
    assert got == ["1", "2-5", "4", "3", None]


def test_sentences_split_after_punctuation(spark):
    df = spark.createDataFrame([("One. Two!  Three? four.five",)], "s STRING")
    assert df.select(tx.sentences("s")).first()[0] == ["One.", "Two!", "Three?", "four.five"]


def test_language_and_passage_read_each_text_once(spark):
    """One pass for white space of each part and one for the letters of each alphabet, and the plain results."""
    parts = ["", None, " \t", "one", " a  b\tc ", " wide  x ", "a\x1cb", "много текст", "Ёж and ab", "я z", "12 34"]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate((a, b) for a in parts for b in parts)], "i INT, section STRING, text STRING")
    both = tx.passage_text("section", "text")
    got = df.select("section", "text", both.alias("p"), tx.detect_language(both).alias("lang"))
    assert df.select(tx.detect_language(both))._jdf.queryExecution().analyzed().toString().count("regexp_replace(") == 8  # in the plan and in its name
    for r in got.collect():
        passage = "\n".join(p for p in (" ".join((v or "").split()) for v in (r.section, r.text)) if p)
        cyrillic, latin = sum("Ѐ" <= c <= "ӿ" for c in passage), sum(c.isascii() and c.isalpha() for c in passage)
        assert r.p == passage and r.lang == ("bg" if cyrillic > latin else "en" if latin > cyrillic else "mixed")


def test_folding_holds_few_values_as_objects():
    """A batch of many texts costs little more than itself and its result."""
    import tracemalloc

    import pyarrow as pa

    values = pa.array(["Some Text " * 100] * 5000 + [None, ""])
    tracemalloc.start()
    got = tx._each(values, lambda v: tx._fold(v, " "), pa.string())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 5002 and got[0].as_py() == ("some text " * 100).strip() and got[5000].as_py() == got[5001].as_py() == ""
    assert peak < 1_000_000
    assert len(tx._each(pa.array([], pa.string()), str, pa.string())) == 0


def test_white_space_is_told_apart_by_two_ranges_first_at_every_code_point(spark):
    near = F.col("c").rlike(f"^{tx.NEAR_SPACE}$")
    points = spark.range(0x110000).where("id not between 55296 and 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "utf-32").alias("c"))
    padded = points.select("id", "c", F.concat(F.lit("a"), "c", F.lit("b "), "c", "c", F.lit(" d")).alias("s"))
    changed = padded.where((tx.squeeze("s") != F.col("s")) | (F.length("c") != 1)).select("id").collect()
    assert {r.id for r in changed} >= {i for i in range(0x110000) if chr(i).isspace()}
    got = padded.where(F.col("id").isin([r.id for r in changed])).select("c", "s", tx.squeeze("s").alias("q")).collect()
    assert all(r.q == " ".join(r.s.split()) for r in got)
    wide = f"[{tx.SPACE}]"
    assert points.where(F.col("c").rlike(wide) & (F.col("c") != "\n") & ~near).count() == 0


def test_a_folded_column_is_folded_once_whatever_is_asked_of_it(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "s STRING").withColumn("a", F.array("s"))
    known = spark.createDataFrame([("straße nr. 5".casefold(),), ("",)], "p STRING")
    folded = df.select(tx.fold_plain("s").alias("p"), tx.fold_labels("a").alias("f"), "s")
    kept = folded.where("p <> '' and p like '%5' and f[0] is not null").join(known, "p")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # 2 when filters were pushed below the folding
    assert [r.s for r in kept.collect()] == [SAMPLES[1]]


def test_workers_fold_and_find_names_without_pandas():
    import subprocess
    import sys
    from pathlib import Path

    code = """
import sys
import numpy as np, pyarrow as pa
from folioscope.functions import arrow, text
from folioscope.operators import names
given = arrow.text_lists([["Ab ", ""], None, [], ["\\u00e9"]])
assert given.to_pylist() == [["Ab ", ""], None, [], ["\\u00e9"]] and given[1:].to_pylist() == [None, [], ["\\u00e9"]]
got = text._each(given, lambda r: None if r is None else [text._fold(v, " ") for v in r], pa.list_(pa.string()))
assert got.to_pylist() == [["ab", ""], None, [], ["\\u00e9"]] and got.type == pa.list_(pa.string())
assert text._each(given.values, lambda v: text._fold(v, " "), pa.string()).to_pylist() == ["ab", "", "\\u00e9"]
data, at = names._utf8(given.values)
assert bytes(data).decode() == "Ab \\u00e9" and at.tolist() == [0, 3, 3, 5]
assert arrow.numbers(np.arange(6)[::2]).to_pylist() == [0, 2, 4] and not len(arrow.texts([]))
assert "pandas" not in sys.modules
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])
