import pytest
from pyspark.sql import types as T

from strictframe import types as S
from strictframe.errors import TypeMismatchError


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        (S.BIGINT, S.TINYINT, S.decimal(20, 0)),
        (S.decimal(5, 1), S.decimal(3, 2), S.decimal(7, 2)),
        (S.decimal(75, 0), S.SMALLINT, S.decimal(75, 0)),
        (S.UINT8, S.UINT8, S.decimal(4, 0)),
        (S.INT128, S.BIGINT, S.decimal(40, 0)),
    ],
)
def test_sum_type(a, b, want):
    assert S.add_type(a, b) == want == S.add_type(b, a, "-")


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [(S.TINYINT, S.BIGINT, S.decimal(23, 0)), (S.decimal(12, 4), S.decimal(12, 2), S.decimal(25, 6)), (S.decimal(60, 3), S.decimal(60, 3), S.decimal(75, 6))],
)
def test_product_type(a, b, want):
    assert S.multiply_type(a, b) == want


def test_product_scale_limit():
    with pytest.raises(TypeMismatchError):
        S.multiply_type(S.decimal(75, 100), S.decimal(75, 100))


def test_quotient_type():
    assert S.divide_type(S.decimal(10, 2), S.decimal(10, 2)) == S.decimal(23, 13)
    assert S.divide_type(S.TINYINT, S.decimal(3, 2)) == S.decimal(11, 6)
    assert S.divide_type(S.INT, S.BIGINT) == S.BIGINT
    with pytest.raises(TypeMismatchError):
        S.divide_type(S.SCALAR, S.INT)


def test_results_keep_integers():
    assert S.result_type("+", S.TINYINT, S.INT) == S.INT
    assert S.result_type("*", S.UINT8, S.UINT8) == S.UINT8
    assert S.result_type("*", S.UINT8, S.SMALLINT) == S.SMALLINT
    with pytest.raises(TypeMismatchError):
        S.result_type("+", S.UINT8, S.TINYINT)
    with pytest.raises(TypeMismatchError):
        S.result_type("+", S.VARCHAR, S.INT)


def test_equality():
    for t in (S.VARCHAR, S.VARBINARY, S.BOOLEAN, S.timestamp("s")):
        S.check_equal(t, t)
    S.check_equal(S.timestamp("s"), S.timestamp("ns"))
    S.check_equal(S.INT, S.decimal(5, 2))
    for a, b in ((S.VARCHAR, S.INT), (S.BOOLEAN, S.INT), (S.VARBINARY, S.VARCHAR), (S.timestamp("s"), S.BIGINT)):
        with pytest.raises(TypeMismatchError):
            S.check_equal(a, b)


def test_order():
    S.check_ordered(S.BOOLEAN, S.BOOLEAN)
    S.check_ordered(S.timestamp("s"), S.timestamp("us"))
    for t in (S.VARCHAR, S.VARBINARY):
        with pytest.raises(TypeMismatchError):
            S.check_ordered(t, t)


@pytest.mark.parametrize(("a", "b"), [(S.BOOLEAN, S.INT), (S.timestamp("ms"), S.BIGINT), (S.INT, S.BIGINT), (S.UINT8, S.TINYINT), (S.INT, S.decimal(10, 0)), (S.decimal(5, 2), S.decimal(9, 2))])
def test_casts_allowed(a, b):
    S.check_cast(a, b)


@pytest.mark.parametrize(("a", "b"), [(S.BIGINT, S.INT), (S.BOOLEAN, S.UINT8), (S.VARCHAR, S.INT), (S.INT, S.decimal(9, 0)), (S.INT, S.decimal(12, 1)), (S.decimal(5, 2), S.decimal(9, 3)), (S.INT, S.VARCHAR), (S.timestamp("s"), S.INT)])
def test_casts_refused(a, b):
    with pytest.raises(TypeMismatchError):
        S.check_cast(a, b)


def test_scaling_casts():
    S.check_scaling(S.INT, S.decimal(12, 2))
    S.check_scaling(S.timestamp("s"), S.timestamp("ns"))
    for a, b in ((S.INT, S.decimal(11, 2)), (S.decimal(5, 2), S.decimal(5, 1)), (S.timestamp("ns"), S.timestamp("s"))):
        with pytest.raises(TypeMismatchError):
            S.check_scaling(a, b)


def test_physical_types():
    assert S.UINT8.spark() == T.ShortType()
    assert S.decimal(20, 10).spark() == T.DecimalType(20, 10)
    assert S.decimal(60, 4).spark() == T.DecimalType(38, 4)
    assert S.decimal(3, -2).spark() == T.DecimalType(5, 0)
    assert S.timestamp("ns").spark() == T.LongType()
    assert S.from_spark(T.DoubleType()) == S.decimal(20, 10)
    with pytest.raises(TypeMismatchError):
        S.from_spark(T.ArrayType(T.IntegerType()))
    with pytest.raises(TypeMismatchError):
        S.decimal(76, 0)


def test_type_names():
    assert S.parse_type("decimal(7, 2)") == S.decimal(7, 2)
    assert S.parse_type("TIMESTAMP(3)") == S.timestamp("ms")
    with pytest.raises(TypeMismatchError):
        S.parse_type("float")
