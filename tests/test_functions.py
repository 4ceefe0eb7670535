import pytest
from pyspark.sql import functions as F

from folioscope.functions.geometry import covered_fraction
from folioscope.functions.text import percent
from folioscope.functions.vectors import inner_product, l2_normalise
from folioscope.operators.names import routed


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a ARRAY<FLOAT>, b ARRAY<FLOAT>")
    got = df.select(inner_product(F.col("a"), F.col("b")).alias("d"), l2_normalise(F.col("a")).alias("u")).collect()
    assert [r.d for r in got] == [11.0, 0.0]
    assert got[0].u == pytest.approx([0.6, 0.8]) and got[1].u == [0.0, 0.0]


def test_routing_keeps_owned_and_free_chunks_apart(spark):
    df = spark.createDataFrame([(0, None), (1, "Cedar"), (2, "Oak")], "i INT, fund STRING")

    def pool(*funds):
        wanted = F.array(*[F.lit(f) for f in funds]).cast("array<string>")
        return sorted(r.i for r in df.filter(routed(F.col("fund"), wanted)).collect())

    assert pool() == [0] and pool("Cedar") == [1] and pool("Cedar", "Oak") == [1, 2]


def test_covered_fraction_and_percent(spark):
    df = spark.createDataFrame(
        [([0.0, 0.0, 10.0, 10.0], [5.0, 0.0, 20.0, 10.0]), ([0.0, 0.0, 0.0, 10.0], [0.0, 0.0, 9.0, 9.0]), (None, [0.0] * 4)],
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>",
    )
    shares = [r[0] for r in df.select(covered_fraction(F.col("a"), F.col("b"))).collect()]
    assert shares == [0.5, 0.0, 0.0]
    assert df.select(percent(F.lit(0.9444))).first()[0] == "94.4%"
