import os
from decimal import Decimal as D

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strictframe import types as S
from strictframe.cli import Database, _schema
from strictframe.engine import Engine
from strictframe.errors import DigestError, NullInputError, QueryError, TypeMismatchError
from strictframe.functions import wide
from strictframe.functions.digest import Bounds, digest, result_hash
from strictframe.operators import relational as R
from strictframe.sources.catalog import from_arrow, random_table, read_csv, to_arrow, without_nulls
from strictframe.streaming.append import append_stream, current_digests, digests, table


def got(df):
    return [tuple(r) for r in df.collect()]


def test_join_and_helpers(spark):
    left = spark.createDataFrame([(i, n) for i, n in enumerate("abcde", 1)], "id long, name string")
    right = spark.createDataFrame([(i, o) for i, o in zip([1, 2, 98, 4, 1, 2, 7], "CLMNOPQ")], "id long, owner string")
    joined = R.join_inner(left, right, "id", "id")
    assert joined.columns == ["id", "name", "owner"]
    assert sorted(r[0] for r in got(joined)) == [1, 1, 2, 2, 4]
    assert got(R.join_inner(left.filter("id > 4"), right, "id", "id")) == []
    assert len(got(R.cross_join(left, right))) == 35
    keys = R.key_union(left, right, "id")
    assert sorted(r[0] for r in got(keys)) == [1, 2, 3, 4, 5, 7, 98]
    assert dict(got(R.multiplicities(keys, right, "id"))) == {1: 2, 2: 2, 3: 0, 4: 1, 5: 0, 7: 1, 98: 1}
    assert sorted(got(R.missing_members(left, right, ["id"]))) == [(3, "c"), (5, "e")]
    with pytest.raises(TypeMismatchError):
        R.join_inner(left, right.withColumn("id", F.col("id").cast("int")), "id", "id")


def test_row_index_and_gather(spark):
    df = spark.range(100).select(((F.col("id") * 37) % 101).alias("k")).repartition(5)
    indexed = R.with_row_index(df, ["k"])
    assert [int(r.rho) for r in indexed.orderBy("k").collect()] == list(range(100))
    positions = spark.createDataFrame([(D(3),), (D(3),), (D(0),)], "rho decimal(38,0)")
    ks = [r.k for r in indexed.orderBy("k").collect()]
    assert sorted(r.k for r in R.gather(indexed, positions).collect()) == sorted([ks[3], ks[3], ks[0]])


def test_checks(spark):
    df = spark.createDataFrame([(1, 5), (2, 7), (3, 7), (4, 6)], "i int, v int")
    assert got(R.monotonic(df, "v", "i")) == [(4, 6)]
    assert len(got(R.monotonic(df, "v", "i", strict=True))) == 2
    assert got(R.permuted(df, df.orderBy(F.desc("i")))) == []
    assert got(R.coerced(df, {"i": S.BIGINT, "v": S.UINT8})) == got(df)
    with pytest.raises(TypeMismatchError):
        R.coerced(df, {"v": S.INT, "i": S.INT})
    with pytest.raises(Exception, match="uint8"):
        R.coerced(df.withColumn("v", F.lit(300)), {"i": S.INT, "v": S.UINT8}).collect()


def test_arrow(spark):
    t = pa.table({"A": pa.array([1, 2], pa.uint8()), "b": pa.array([1.25, -0.5]), "c": pa.array([b"x", b""]), "d": pa.array([0, 1], pa.timestamp("ms"))})
    df, types = from_arrow(spark, t)
    assert types == {"a": S.UINT8, "b": S.decimal(20, 10), "c": S.VARBINARY, "d": S.timestamp("ms")}
    back = to_arrow(df)
    assert back.column("b").to_pylist() == [D("1.25"), D("-0.5")]
    assert pa.types.is_timestamp(back.schema.field("d").type) and back.schema.field("d").type.tz is None
    with pytest.raises(TypeMismatchError):
        from_arrow(spark, pa.table([[1], [2]], names=["a", "A"]))


def test_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    with pytest.raises(NullInputError, match="s"):
        without_nulls(df)
    assert without_nulls(df.select("i")).count() == 2


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b,c,d\n1,2.5,x,TRUE\n2,3.25,y,false\n")
    df = read_csv(spark, str(tmp_path / "x.csv"))
    assert df.dtypes == [("a", "bigint"), ("b", "decimal(20,10)"), ("c", "string"), ("d", "boolean")]
    assert got(df) == [(1, D("2.5"), "x", True), (2, D("3.25"), "y", False)]


def test_random_tables_repeat(spark):
    kinds = {"a": S.BIGINT, "b": S.UINT8, "c": S.VARCHAR, "d": S.timestamp("us"), "e": S.BOOLEAN, "f": S.VARBINARY, "g": S.INT128}
    one, two = (random_table(spark, kinds, 50, 20, 3) for _ in range(2))
    assert got(one) == got(two)
    r = one.agg(F.min("a"), F.max("a"), F.min("b"), F.max(F.length("c"))).first()
    assert r[0] >= -20 and r[1] <= 20 and r[2] >= 0 and r[3] <= 10


def test_digests_add_up(spark):
    kinds = {"k": S.BIGINT, "s": S.VARCHAR}
    rows = spark.createDataFrame([(i, i * 3 % 7, f"v{i}") for i in range(10)], "rho long, k long, s string")
    whole = digest(rows, kinds)
    head, tail = digest(rows.filter("rho < 6"), kinds), digest(rows.filter("rho >= 6"), kinds, start=6)
    assert head.add(tail) == whole == tail.add(head)
    assert whole.subtract(tail).columns["k"][1] == head.columns["k"][1]
    assert whole.columns["k"][2] == Bounds("sharp", 0, 6) and whole.columns["s"][2] == Bounds("none")
    a, b = digest(rows, {"k": S.BIGINT}), digest(rows, {"s": S.VARCHAR})
    assert a.extend(b) == whole
    for bad in (lambda: head.add(head), lambda: head.subtract(tail), lambda: a.add(b), lambda: whole.extend(a)):
        with pytest.raises(DigestError):
            bad()
    changed = rows.withColumn("k", F.when(F.col("rho") == 3, 99).otherwise(F.col("k")))
    assert digest(changed, kinds).columns["k"][1] != whole.columns["k"][1]


def test_bounds_algebra():
    a, b = Bounds("sharp", 1, 9), Bounds("sharp", 3, 5)
    assert a.union(b) == a and a.union(Bounds("empty")) == a
    assert a.union(Bounds("bounded", 0, 4)) == Bounds("bounded", 0, 9)
    assert a.difference(b) == a and a.difference(Bounds("sharp", 20, 30)) == a
    assert a.difference(Bounds("sharp", 1, 2)) == Bounds("bounded", 1, 9)
    with pytest.raises(DigestError):
        a.union(Bounds("none"))


def test_result_hash(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    assert result_hash(df) == result_hash(df.orderBy(F.desc("i"))) != result_hash(df.limit(1))
    assert len(result_hash(df.filter("i > 5"))) == 64


def test_wide_numbers(spark):
    values = [0, 1, -1, 10**18 - 1, 10**18, -(10**18), 10**37 + 5, -(10**37), 2**127 - 1, -(2**127), 10**74 + 3, -(10**74)]
    df = wide.from_text(spark.createDataFrame([(str(v),) for v in values], "t string"), "w", F.col("t"))
    df = df.cache()
    assert [r.r for r in wide.to_text(df, "r", "w").collect()] == [str(v) for v in values]
    assert [int(r.t) for r in df.orderBy(wide.order("w")).collect()] == sorted(values)
    pairs = [(a, b) for a in values[:8] for b in values[:8]]
    both = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "ta string, tb string")
    both = wide.from_text(wide.from_text(both, "a", F.col("ta")), "b", F.col("tb"))
    for f, op in ((wide.add, int.__add__), (wide.subtract, int.__sub__), (wide.multiply, int.__mul__)):
        assert [int(r.r) for r in wide.to_text(f(both, "c", "a", "b"), "r", "c").collect()] == [op(a, b) for a, b in pairs]
    assert int(wide.to_text(wide.total(df.withColumn("k", F.lit(1)), ["k"], "s", "w"), "r", "s").first().r) == sum(values)
    with pytest.raises(Exception, match="75 digits"):
        wide.multiply(df, "c", "w", "w").filter("t like '1000%'").collect()
    df.unpersist()


def test_stream_append(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    spark.range(5).withColumn("s", F.lit("a")).write.parquet(str(source))
    schema = spark.read.parquet(str(source)).schema
    for k in range(2):
        stream = spark.readStream.schema(schema).parquet(str(source))
        append_stream(stream, str(out), str(tmp_path / "state")).awaitTermination()
        assert table(spark, str(out)).count() == 5 * (k + 1)
        assert digests(spark, str(out)) == current_digests(table(spark, str(out)))
        spark.range(5, 10).withColumn("s", F.lit("b")).write.mode("append").parquet(str(source))


def test_database(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    assert _schema("a decimal(5, 2), b varchar") == {"a": S.decimal(5, 2), "b": S.VARCHAR}
    db.create("t", "a bigint, b varchar")
    (tmp_path / "one.csv").write_text("a,b\n1,hi\n2,hello\n")
    (tmp_path / "two.csv").write_text("a,b\n3,there\n2,world\n")
    assert db.run("select count(*) as n from t")["rows"] == [["0"]]
    db.append("t", str(tmp_path / "one.csv"))
    db.append("t", str(tmp_path / "two.csv"))
    out = db.run("select b from t where a = 2 order by b")
    assert out["rows"] == [["hello"], ["world"]] and db.verify(out)
    db.append("t", str(tmp_path / "one.csv"))
    assert not db.verify(out)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables not there")
@pytest.mark.parametrize("parts,coalesce,advisory", [(4, "true", "64m"), (16, "true", "100k"), (200, "true", "1m"), (16, "false", "64m")])
def test_row_index_keeps_every_row_of_wide_tables(spark, parts, coalesce, advisory):
    settings = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": coalesce, "spark.sql.adaptive.advisoryPartitionSizeInBytes": advisory}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
        numbered = R.with_row_index(lines, ["l_orderkey", "l_linenumber"])
        n, distinct, least, most, rows = numbered.agg(F.count("*"), F.count_distinct("rho"), F.min("rho"), F.max("rho"), F.count_distinct(*lines.columns)).first()
        assert (n, distinct, least, most) == (60_000, 60_000, 0, 59_999) and rows == lines.distinct().count()
        assert got(R.monotonic(numbered.select(F.col("rho"), F.col("l_orderkey")), "l_orderkey", "rho")) == []
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_row_index_splits_a_hot_key_and_keeps_names(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("__at"), F.col("id").alias("a.b"))
    numbered = R.with_row_index(df, ["k"])
    assert numbered.columns == ["k", "__at", "a.b", "rho"]
    rows = sorted((int(r.rho), r.k) for r in numbered.collect())
    assert [r for r, _ in rows] == list(range(3000)) and [k for _, k in rows] == sorted(k for _, k in rows)


def test_offsets_from_the_end_are_top_k(spark):
    df = spark.range(50).select(F.col("id").alias("k"), (F.col("id") % 3).alias("m"))
    order = (("m", False), ("k", True))
    expected = sorted(((k, k % 3) for k in range(50)), key=lambda r: (-r[1], r[0]))
    assert got(R.sliced(R.ordered(df, order), -5, None, order)) == expected[-5:]
    assert got(R.sliced(R.ordered(df, order), -5, 2, order)) == expected[-5:-3]
    assert got(R.sliced(R.ordered(df, order), -50, None, order)) == expected
    with pytest.raises(QueryError, match="before the first of 50 rows"):
        R.sliced(R.ordered(df, order), -51, None, order)


def test_parquet_nulls_are_found_in_the_footers(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1, "a"), (2, None)], "i int, s string").write.parquet(path)
    e = Engine(spark)
    with pytest.raises(NullInputError, match="nulls in s"):
        e.catalog.add_parquet("t", path)
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string").write.mode("overwrite").parquet(path)
    e.catalog.add_parquet("t", path)
    assert got(e.sql("select count(s) as n from t where not (i = 1)")) == [(1,)]
