"""The dialect end to end on small literal tables."""

import random
from datetime import datetime
from decimal import Decimal as D

import pyarrow as pa
import pytest

from strictframe import types as S
from strictframe.engine import Engine
from strictframe.errors import DuplicateAliasError, GroupingError, NullInputError, ParameterError, QueryError, TypeMismatchError, UnknownNameError


@pytest.fixture(scope="module")
def e(spark):
    e = Engine(spark)
    dec = lambda xs, p, s: pa.array([D(x) for x in xs], pa.decimal128(p, s))
    e.catalog.add_arrow("dogs", pa.table({"id": pa.array([1, 2, 3, 4, 5], pa.int32()), "name": ["Rex", "Bo", "Ivy", "Max", "Ada"], "age": pa.array([13, 2, 0, 4, 4], pa.int8()), "owner": ["Kim", "Kim", "Kim", "Lee", "Lee"], "weight": dec(["14.5", "7.5", "2.0", "4.5", "5.5"], 3, 1)}))
    e.catalog.add_arrow("nums", pa.table({"a": [1, 1, 2, 3, 2], "b": [1, 0, 4, 2, 3], "c": [-2, 2, 1, 0, 1]}))
    e.catalog.add_arrow("small", pa.table({"a": pa.array([3, 5, 2, 1], pa.int8()), "b": pa.array([2, 1, 3, 4], pa.int8()), "c": pa.array([1, 4, 5, 2], pa.int8())}))
    e.catalog.add_arrow("decs", pa.table({"x": dec(["0.1", "0.2", "0.3", "0.4"], 5, 1), "y": dec(["0.05", "0.06", "0.07", "0.08"], 3, 2)}))
    e.catalog.add_arrow("blobs", pa.table({"k": [1234, 4567], "v": pa.array([b"\x01\x02\x03", b"\x04\x05\x06\x07"])}))
    e.catalog.add_arrow("pay", pa.table({"src": [f"0x{k}" for k in "12321"], "dst": [f"0x{k}" for k in "23132"], "value": dec(["100", "200", "300", "400", "500"], 38, 0), "at": pa.array([1, 2, 3, 4, 4], pa.timestamp("s"))}))
    e.catalog.add_arrow("fine", pa.table({"p": pa.array([-(1 << 63), -1, 5, (1 << 63) - 1], pa.timestamp("ns")), "q": pa.array([(1 << 63) - 1, 0, 4, -(1 << 63)], pa.timestamp("ns"))}))
    e.catalog.add_arrow("tiny", pa.table({"k": pa.array([100, 100], pa.int8())}))
    e.catalog.add_arrow("bytes", pa.table({"u": pa.array([200, 55], pa.uint8())}))
    return e


def rows(e, text, *params):
    return [tuple(r) for r in e.sql(text, *params).collect()]


def test_filter_and_parameters(e):
    assert rows(e, "select id, name from dogs where age > 2") == [(1, "Rex"), (4, "Max"), (5, "Ada")]
    assert [r[0] for r in rows(e, "select name == $1 as same from dogs", "Ivy")] == [False, False, True, False, False]
    assert rows(e, "select name, $1::boolean as good from dogs limit 1", True) == [("Rex", True)]
    assert rows(e, "select $1::varchar as a, $2::bigint as b", "Bo", 0) == [("Bo", 0)]


def test_exact_arithmetic(e):
    df, types = e.typed("select 2 * age as r from dogs")
    assert [r[0] for r in df.collect()] == [26, 4, 0, 8, 8]
    assert types["r"] == S.decimal(23, 0)
    df, types = e.typed("select x + y as r from decs")
    assert [r[0] for r in df.collect()] == [D("0.15"), D("0.26"), D("0.37"), D("0.48")] and types["r"] == S.decimal(7, 2)
    assert rows(e, "select a * b + b + c as r from small where a > b or c = 4") == [(9,), (10,)]
    assert e.typed("select a * b + b + c as r from small")[1]["r"] == S.decimal(9, 0)


def test_literals(e):
    df, types = e.typed("select 45.7 as a, 100.0 as b, 0x0a as c, to_timestamp(10) as d, timestamp '2011-02-04T18:25:06+03:00' as e, 'x' as f, 9223372036854775808 as g")
    r = df.first()
    assert (r.a, r.b, bytes(r.c), r.f, r.g) == (D("45.7"), D(100), b"\n", "x", 9223372036854775808)
    assert r.e == datetime(2011, 2, 4, 15, 25, 6)
    assert (types["a"], types["b"], types["e"], types["g"]) == (S.decimal(3, 1), S.decimal(3, 0), S.timestamp("s"), S.INT128)


def test_no_table(e):
    assert [[tuple(r) for r in df.collect()] for df in e.statements("select 1 + 1 as a; select 'w' as b; select 'A' as n, 1 as k union all select 'B' as n, 2 as k")] == [[(2,)], [("w",)], [("A", 1), ("B", 2)]]


def test_group_by(e):
    assert sorted(rows(e, "select owner, sum(weight) as w, count(1) as n from dogs group by owner")) == [("Kim", D("24.0"), 3), ("Lee", D("10.0"), 2)]
    assert sorted(rows(e, "select owner, sum(2 * weight + 1) as w from dogs group by owner")) == [("Kim", D("51.0")), ("Lee", D("22.0"))]
    df, types = e.typed("select owner, 2 * count(1) as n from dogs group by owner order by owner")
    assert [tuple(r) for r in df.collect()] == [("Kim", 6), ("Lee", 4)] and types["n"] == S.BIGINT
    assert sorted(rows(e, "select a, sum(1 + 2 * b) as d, count(*) as k from nums where c >= 0 group by a")) == [(1, 1, 1), (2, 16, 2), (3, 5, 1)]
    assert sorted(rows(e, "select owner, max(age) as hi, min(age) as lo from dogs group by owner")) == [("Kim", 13, 0), ("Lee", 4, 4)]
    assert sorted(rows(e, "select owner, true as yes from dogs group by owner")) == [("Kim", True), ("Lee", True)]
    assert sorted(rows(e, "select a, a + sum(b) - 1 as r from nums group by a")) == [(1, 1), (2, 8), (3, 4)]


def test_groups_come_in_order(e, spark):
    """Without ORDER BY, groups come in the order of their keys, also before a limit."""
    text = "select sum(b) as s, a from nums group by a"
    assert [r[1] for r in rows(e, text)] == [1, 2, 3]
    assert [r[1] for r in rows(e, text + " limit 2")] == [1, 2]
    assert [r[0] for r in rows(e, "select count(*) as n from dogs group by owner")] == [3, 2]
    plain = Engine(spark, sorted_groups=False)
    plain.catalog = e.catalog
    assert "Sort" not in plain.sql(text)._jdf.queryExecution().optimizedPlan().toString()


def test_sums_keep_their_type(e):
    assert e.typed("select sum(age) as s from dogs")[1]["s"] == S.TINYINT
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        e.sql("select sum(k) as s from tiny").collect()


def test_unsigned_sums_are_checked(e):
    assert rows(e, "select sum(u) as s from bytes") == [(255,)]


def test_global_aggregates(e, spark):
    assert rows(e, "select sum(b) as s, count(*) as n from nums where a > 1") == [(9, 3)]
    assert rows(e, "select count(*) as n from nums where a > 9") == [(0,)]
    strict = Engine(spark, strict_empty=True)
    strict.catalog = e.catalog
    assert rows(strict, "select count(*) as n from nums where a > 9") == []
    assert rows(strict, "select count(*) as n from nums where a > 2") == [(1,)]


def test_division_truncates(e):
    assert rows(e, "select a / b as r from small order by r") == [(0,), (0,), (1,), (5,)]
    assert rows(e, "select sum(c) / count(*) as r from nums where c < 0") == [(-2,)]
    df, types = e.typed("select 2.00 / x as r from decs where x = 0.3")
    assert types["r"] == S.decimal(8, 6) and df.first()[0] == D("6.666666")
    assert rows(e, "select -2.5 / 0.3 as r")[0][0] == D("-8.333333")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|zero"):
        e.sql("select a / (a - a) as r from small").collect()


def test_overflow_over_results(e):
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        e.sql("select 9223372036854775807 + count(*) as r from nums").collect()


def test_casts(e):
    text = "select sum((cast(dst = $1 as bigint) - cast(src = $1 as bigint)) * value * cast(at as bigint)) as r from pay"
    assert rows(e, text, "0x2") == [(100 * 1 - 200 * 2 - 400 * 4 + 500 * 4,)]
    with pytest.raises(TypeMismatchError):
        e.sql("select cast(id as tinyint) as r from dogs")


def test_binary_and_nanoseconds(e):
    assert [(k, bytes(v)) for k, v in rows(e, "select k, v from blobs where v = 0x04050607")] == [(4567, b"\x04\x05\x06\x07")]
    assert rows(e, "select p, p <= q as r from fine where p <= q") == [(-(1 << 63), True), (-1, True)]
    assert rows(e, "select p from fine where p > timestamp '1970-01-01T00:00:00.000000004Z'") == [(5,), ((1 << 63) - 1,)]


def test_leap_second(e):
    assert e.sql("select timestamp '1998-12-31T23:59:60Z' as t").first()[0] == datetime(1998, 12, 31, 23, 59, 59)


def test_decimal_equality(e):
    for text, want in (("0.3", 1), ("0.30", 1), ("0.31", 0), (".1", 1), ("-0.1", 0), ("1", 0)):
        assert len(rows(e, f"select x from decs where x = {text}")) == want


def test_order_and_slices(e):
    assert rows(e, "select name, age from dogs order by age desc, name limit 3") == [("Rex", 13), ("Ada", 4), ("Max", 4)]
    assert rows(e, "select id from dogs order by id limit 2 offset 3") == [(4,), (5,)]
    assert rows(e, "select id from dogs order by id offset -2 limit 1") == [(4,)]
    assert rows(e, "select id from dogs order by id offset 9") == []
    assert rows(e, "select id from dogs limit 0") == []
    with pytest.raises(QueryError):
        e.sql("select id from dogs offset -9")


def test_joins(e):
    with pytest.raises(TypeMismatchError):
        e.sql("select name from dogs join nums on id = a")
    assert sorted(rows(e, "select x.b as l, y.c as r from nums x join nums y on x.a = y.b where x.a = 3")) == [(2, 1)]
    assert len(rows(e, "select p.a as l, q.a as r from nums p cross join nums q")) == 25


def test_boolean_order(e):
    assert rows(e, "select true > false as a, (1 = 2) < true as b") == [(True, True)]


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("select a as x, b as x from nums", DuplicateAliasError),
        ("select * from dogs where name = 12", TypeMismatchError),
        ("select a as k from nums order by a", UnknownNameError),
        ("select a, b from nums group by a", GroupingError),
        ("select sum(name) as s from dogs", TypeMismatchError),
        ("select max(name) as s from dogs", TypeMismatchError),
        ("select sum(max(a)) as s from nums", GroupingError),
        ("select a - name as r from dogs", UnknownNameError),
        ("select age - name as r from dogs", TypeMismatchError),
        ("select -name as r from dogs", TypeMismatchError),
        ("select a from nums where b", TypeMismatchError),
        ("select a from nums where sum(a) = 1", GroupingError),
        ("select min(b) as low from nums group by low", UnknownNameError),
        ("select name from dogs where name < 'M'", TypeMismatchError),
        ("select a from nothing", UnknownNameError),
        ("select $0 as x", ParameterError),
        ("select $3 as x", ParameterError),
        ("select $1::boolean as x", ParameterError),
        ("select a from nums union all select name from dogs", TypeMismatchError),
        ("select age from dogs union all select id from dogs", TypeMismatchError),
    ],
)
def test_rejected(e, text, error):
    with pytest.raises(error):
        e.sql(text, 5)


def test_nulls_are_rejected(spark):
    e = Engine(spark)
    with pytest.raises(NullInputError):
        e.catalog.add_arrow("t", pa.table({"a": [1, None]}))
    e.catalog.add("t", spark.createDataFrame([(1,), (None,)], "a int"))
    with pytest.raises(Exception, match="null in column a"):
        e.sql("select a from t").collect()


def test_random_expressions_against_python(spark):
    """Sums, products and comparisons of random columns equal Python's exact arithmetic."""
    rng = random.Random(7)
    n = 60
    a = [rng.randint(-(1 << 40), 1 << 40) for _ in range(n)]
    b = [rng.randint(-128, 127) for _ in range(n)]
    c = [D(rng.randint(-9999, 9999)).scaleb(-2) for _ in range(n)]
    e = Engine(spark)
    e.catalog.add_arrow("r", pa.table({"a": a, "b": pa.array(b, pa.int8()), "c": pa.array(c, pa.decimal128(6, 2))}))
    got = rows(e, "select a * b - c as x, (a + c) * 2 as y, a * b < c * 1000 and not b = 3 or c >= 10.5 as z from r")
    assert got == [(x * y - z, (x + z) * 2, (x * y < z * 1000 and y != 3) or z >= D("10.5")) for x, y, z in zip(a, b, c)]


def test_results_do_not_depend_on_partitions(spark, e):
    text = "select owner, sum(weight) as w, count(*) as n from dogs group by owner order by owner"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        out = []
        for k in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", k)
            out.append(rows(e, text))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1]


def test_display_names(spark):
    e = Engine(spark, display_names=True)
    e.catalog.add("cats", spark.createDataFrame([(1, "a", True)], "weight long, name string, old boolean"))
    assert e.sql("select weight, weight + 1, not old, name = 'x', sum(weight) from cats where false group by weight, name, old").columns == ["weight", "cats.weight + Int64(1)", "NOT cats.old", 'cats.name = Utf8("x")', "SUM(cats.weight)"]
    assert e.sql("select count(*), max(c.weight) as m from cats c").columns == ["COUNT(Int64(1))", "m"]
