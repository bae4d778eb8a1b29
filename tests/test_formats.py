import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from nearfield.functions import formats, similarity


def value(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


def lit(*xs, kind="double"):
    return F.array(*[F.lit(float(x) if kind == "double" else x).cast(kind) for x in xs])


def test_fixed_point(spark):
    for v, code in ((0.99999, 32767), (1.0, 32767), (-1.0, -32768), (0.0, 0), (0.5, 0x4000), (-0.5, -0x4000)):
        assert value(spark, formats.to_q15(F.lit(v))) == code
    for code, v in ((0, 0.0), (0x4000, 0.5), (-24576, -0.75), (-32768, -1.0), (32767, 32767 / 32768)):
        assert value(spark, formats.from_q15(F.lit(code))) == v


def test_padding():
    assert [formats.padded_dimensions(d) for d in (0, 1, 16, 17)] == [0, 16, 16, 32]


def test_normalise(spark):
    assert value(spark, formats.normalise(lit(3, 4))) == [0.6, 0.8]
    assert value(spark, formats.normalise(lit(0, 0))) == [0.0, 0.0]


def test_cosine_and_l2(spark):
    assert value(spark, similarity.cosine01(lit(1, 0), lit(0, 1))) == 0.5
    assert value(spark, similarity.cosine01(lit(1, 1, 1, 1), lit(1, 1, 1, 1))) == pytest.approx(1.0)  # does not overflow
    assert value(spark, similarity.cosine01(lit(0, 0), lit(1, 0))) == 0.5
    a = [0.0] * 32
    b = [0.0] * 32
    a[0], b[0], a[21], b[21] = 0.2, 0.5, -1.5, 0.4
    assert value(spark, similarity.l2_similarity(lit(*a[:16]), lit(*b[:16]))) == pytest.approx(1 / 1.09)
    assert value(spark, similarity.l2_similarity(lit(*a), lit(*b))) == pytest.approx(1 / 4.70)


def test_jaccard(spark):
    for a, b, s in (((), (), 0), ((1, 2), (1, 2), 1), ((1, 2, 3), (4, 5, 3), 1 / 5), ((1,), (1, 2, 3, 4, 5, 6), 1 / 6), ((1,), (2,), 0), ((5, 7, 1), (1, 2, 3, 4, 5, 6), 2 / 7)):
        x = F.array(*[F.lit(t) for t in a]).cast("array<int>")
        y = F.array(*[F.lit(t) for t in b]).cast("array<int>")
        assert value(spark, similarity.jaccard(x, y)) == pytest.approx(s)


def test_invalid_points(spark):
    with pytest.raises(PySparkException):
        value(spark, formats.checked_vector(lit(1), 2))
    with pytest.raises(PySparkException):
        value(spark, formats.token_set(F.array(F.lit(5)), 5))
    assert value(spark, formats.token_set(F.array().cast("array<int>"), 5)) == []
    assert value(spark, formats.token_set(F.array(F.lit(3), F.lit(1), F.lit(3)), 5)) == [1, 3]
