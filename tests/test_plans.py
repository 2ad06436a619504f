"""Literal values: schemas, joins with NULLs, windows, indexes, policies, sketches, streams."""

from __future__ import annotations

from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from weftline import sources
from weftline.functions import aggregates, arithmetic, hashing, jsons, maps, plumbing, sketches, timestamps, xpaths
from weftline.operators.indexing import zip_with_index
from weftline.operators import joins
from weftline.operators.joins import Above, key_join, salted_join
from weftline.plans import policy, schema
from weftline.plans.dataset import Dataset, Materialized
from weftline.plans.errors import InvalidPlan, SchemaMismatch
from weftline.queries import QUERIES
from weftline.streaming import windowed


@dataclass
class Address:
    street: str
    city: str | None


@dataclass
class Person:
    name: str
    age: int | None
    tags: list[str]
    scores: dict[str, float]
    home: Address


EMP, DEPT = "id long, name string, dept long", "dept long, title string"


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "a", 10), (2, "b", None), (3, "c", 30), (4, "d", 10)], EMP)


@pytest.fixture(scope="module")
def depts(spark):
    return spark.createDataFrame([(10, "x"), (20, "y"), (None, "z")], DEPT)


def test_schema_of_a_dataclass():
    s = schema.struct_type(Person)
    assert s.simpleString() == "struct<name:string,age:bigint,tags:array<string>,scores:map<string,double>,home:struct<street:string,city:string>>"
    assert [f.nullable for f in s] == [False, True, False, False, False]
    assert schema.struct_type(Person, flatten=True).names[-2:] == ["home_street", "home_city"]


def test_validate_reports_everything(people):
    with pytest.raises(SchemaMismatch) as e:
        schema.validate(people, schema.struct_type(Address))
    assert len(e.value.problems) >= 3


def test_narrow(people, spark):
    kind = "id long not null, name string not null, dept long"
    from pyspark.sql.types import StructType

    assert schema.narrow(people, StructType.fromDDL(kind)).count() == 4
    with pytest.raises(SchemaMismatch):
        schema.narrow(people, StructType.fromDDL("id long, name string, dept long not null"))


def test_null_keys_never_meet(people, depts):
    assert {r.id for r in key_join(people, depts, "dept", "dept", "inner").collect()} == {1, 4}
    assert {r.id for r in key_join(people, depts, "dept", "dept", "left_anti").collect()} == {2, 3}
    full = key_join(people, depts, "dept", "dept", "full")
    assert full.columns == ["id", "name", "_1_dept", "_2_dept", "title"] and full.count() == 6


def test_nested_join_tells_no_row_from_nulls(people, depts):
    rows = Dataset(people).left_join_on(Dataset(depts), "dept", "dept", nested=True).collect()
    assert sum(r["_2"] is None for r in rows) == 2 and next(r["_1"].id for r in rows if r["_2"]) in (1, 4)


def test_join_types_must_match(people, depts):
    with pytest.raises(InvalidPlan):
        key_join(people, depts, "name", "dept", "inner")


def test_keyed_join_equals_predicate_join(spark):
    import random

    rnd = random.Random(5)
    l = spark.createDataFrame([(rnd.choice([None, *range(6)]), i) for i in range(60)], "k long, a long")
    r = spark.createDataFrame([(rnd.choice([None, *range(8)]), i) for i in range(40)], "k long, b long")
    for how, keyed, theta in (("i", "join_on", "join"), ("l", "left_join_on", "left_join"), ("r", "right_join_on", "right_join"), ("f", "full_join_on", "full_join"), ("a", "anti_join_on", "anti_join")):
        x = getattr(Dataset(l), keyed)(Dataset(r), "k", "k").collect()
        y = getattr(Dataset(l), theta)(Dataset(r), lambda p, q: p("k") == q("k")).collect()
        assert sorted(map(repr, map(tuple, x))) == sorted(map(repr, map(tuple, y))), how
    plain = l.join(r, "k").count()
    assert salted_join(l, r, "k", 3).count() == plain


KINDS_OF_JOIN = ("join", "left_join", "right_join", "full_join", "anti_join")


@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("tile", [4, 256])  # many tiles, and one
def test_above_equals_predicate_join(spark, monkeypatch, keyed, tile):
    """NULL keys and values, NaN, ties, equal rows; a value that half of the rows have; keys that one side lacks."""
    import random

    monkeypatch.setattr(joins, "TILE", tile)
    rnd = random.Random(7)
    values = [None, float("nan"), 3.0, *[rnd.uniform(-9, 9) for _ in range(40)]]
    l = spark.createDataFrame([(rnd.choice([None, 0, 1, 2, 3]), rnd.choice(values), i // 2) for i in range(120)], "k long, v double, a long")
    r = spark.createDataFrame([(rnd.choice([None, 0, 0, 0, 2, 4]), rnd.choice([*values, *[1.5] * 40]), i // 2) for i in range(160)], "k long, v double, b long")
    above = Above("v", F.col("v") + 2, (("k", "k"),) if keyed else ())
    for how in KINDS_OF_JOIN:
        got = getattr(Dataset(l), how)(Dataset(r), above).df
        want = getattr(Dataset(l), how)(Dataset(r), lambda p, q: (p("v") > q("v") + 2) & (p("k") == q("k") if keyed else F.lit(True))).df
        assert got.columns == want.columns
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect()))), how
    nested = Dataset(l).full_join(Dataset(r), above, nested=True).df
    want = Dataset(l).full_join(Dataset(r), lambda p, q: (p("v") > q("v") + 2) & (p("k") == q("k") if keyed else F.lit(True)), nested=True).df
    assert nested.count() == want.count() and nested.where("_1 IS NULL").count() == want.where("_1 IS NULL").count() and nested.where("_2 IS NULL").count() == want.where("_2 IS NULL").count()
    semi = joins.predicate_join(l, r, above, "left_semi")
    assert sorted(map(repr, map(tuple, semi.collect()))) == sorted(map(repr, map(tuple, joins.predicate_join(l, r, lambda p, q: (p("v") > q("v") + 2) & (p("k") == q("k") if keyed else F.lit(True)), "left_semi").collect())))


@pytest.mark.parametrize("above", [True, False])
def test_above_deals_a_frequent_value_out(spark, monkeypatch, above):
    monkeypatch.setattr(joins, "TILE", 10)
    rows = spark.range(1000).select(F.struct("id").alias("_1"), F.when(F.col("id") < 900, 5.0).otherwise(F.col("id").cast("double")).alias("_v"))
    sizes = [r["count"] for r in rows.withColumn("_tile", joins._tile(rows, [], "_1")).groupBy("_tile").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) < 50
    others = spark.createDataFrame([(0, 4.0), (1, 6.0), (2, 2000.0)], "a long, w double")
    order = Above("w", "x") if above else Above("x", "w")
    sides = (others, rows.select(F.col("_v").alias("x"), "_1.id"))
    got = joins.predicate_join(*(sides if above else sides[::-1]), order, "inner")
    assert got.count() == (900 + 1000 if above else 1000 + 100)


def test_above_takes_dates_but_no_text(spark, monkeypatch):
    monkeypatch.setattr(joins, "TILE", 4)
    days = spark.range(60).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    for kind in ("date", "timestamp", "timestamp_ntz"):
        assert Dataset(days.select(F.col("d").cast(kind).alias("d"))).join(Dataset(days.select(F.col("d").cast(kind).alias("e"))), Above("d", "e")).count() == 60 * 59 // 2
    assert Dataset(spark.range(40)).join(Dataset(spark.range(40).select(F.col("id").cast("decimal(9,2)").alias("e"))), Above("id", "e")).count() == 40 * 39 // 2
    with pytest.raises(InvalidPlan):
        Dataset(spark.range(1).select(F.lit("a").alias("d"))).join(Dataset(days), Above("d", "d"))


@pytest.mark.parametrize("name", ["theta_join", "inner_join", "left_join", "right_join", "full_join"])
def test_order_joins_deal_by_tile(spark, sf_dir, name):
    """No task gets all rows of a nation, and no pair of far values is looked at."""
    assert "_edge" in QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_left_anti_join_looks_at_the_least_value(spark, sf_dir):
    assert "min(" in QUERIES["left_anti_join"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_approx_count_distinct_holds_a_sketch_a_group(spark, sf_dir):
    """Not one for each distinct key: only keys are grouped before the flags are."""
    plan = QUERIES["approx_count_distinct"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert all("approx_count_distinct" not in line for line in plan.splitlines() if "Aggregate(keys=[l_returnflag" in line and "l_partkey" in line.split("functions=")[0])
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_partkey")
    estimates = [{tuple(r) for r in df.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey")).collect()} for df in (lines, lines.distinct())]
    assert estimates[0] == estimates[1]


def test_zip_with_index_has_no_gaps(spark):
    df = spark.range(100, numPartitions=7)
    rows = {r.id: r["index"] for r in zip_with_index(df).collect()}
    assert rows == {i: i for i in range(100)}
    assert zip_with_index(spark.range(0)).count() == 0


def test_sort_nulls_first_rising_last_falling(people):
    assert [r.dept for r in Dataset(people).sort_by_exprs("dept").collect()][0] is None
    assert [r.dept for r in Dataset(people).sort_by_exprs(("dept", "desc")).collect()][-1] is None


def test_group_by_null_key_and_no_aggregates(people):
    assert Dataset(people).group_by_agg(["dept"], [aggregates.count().alias("n")]).count() == 3
    assert Dataset(people).group_by_agg(["dept"], []).count() == 3
    assert Dataset(people).filter("id > 9").aggregate([aggregates.count().alias("n")]).collect()[0].n == 0


def test_partition_leaves_null_predicates_out(people):
    a, b = Dataset(people).partition(F.col("dept") > 10)
    assert (a.count(), b.count()) == (1, 2)


def test_actions_and_tree(people):
    d = Dataset(people).filter("id > 1").limit(2)
    assert d.tree().split("\n") == ["Limit", "  Filter", "    Root"]
    assert d.count() == 2 and not d.is_empty() and len(d.take(1)) == 1
    assert Dataset(people.orderBy("id")).show(1).split("\n")[2] == "1 | a | 10"


def test_ansi_errors_and_try_forms(spark):
    one = spark.range(1).select(F.lit(2147483647).alias("i"), F.lit(0).alias("z"))
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
        one.select(arithmetic.add_int("i", F.lit(1))).collect()
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        one.select(arithmetic.div_double("i", "z")).collect()
    assert one.select(arithmetic.try_add("i", F.lit(1)), arithmetic.try_divide("i", "z")).first() == (None, None)


def test_hash_of_null(spark):
    r = spark.range(1).select(hashing.xxhash64(F.lit(None).cast("string")), hashing.hash_(F.lit(None).cast("string"))).first()
    assert tuple(r) == (42, 42)


def test_try_xpath_of_what_is_no_xml(spark):
    df = spark.createDataFrame([("<a><b>1</b></a>",), ("<a><b>",), (None,), ("",)], "x string")
    assert [r[0] for r in df.select(xpaths.try_xpath_int("x", "a/b")).collect()] == [1, None, None, None]


def test_map_duplicate_keys_fail(spark):
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        spark.range(1).select(maps.map_from_arrays(F.array(F.lit(1), F.lit(1)), F.array(F.lit(2), F.lit(3)))).collect()


def test_json_and_const(spark):
    df = spark.createDataFrame([('{"a": 1, "b": null}',), ("{",)], "j string")
    rows = df.select(jsons.from_json("j", "a int")["a"].alias("a"), jsons.json_tuple("j", "a", "b").alias("t")).collect()
    assert [(r.a, list(r.t)) for r in rows] == [(1, ["1", None]), (None, [None, None])]
    r = spark.range(1).select(plumbing.const([1, 2]), plumbing.const((1, "x")), plumbing.const({"k": 1}), plumbing.const(None)).first()
    assert r[0] == [1, 2] and tuple(r[1]) == (1, "x") and r[2] == {"k": 1} and r[3] is None


def test_json_tuple_is_get_json_object(spark):
    texts = ['{"a": "x", "b.c": 2, "d": {"e": [1, 2]}, "f": true, "g": 1.50}', '{"a": null}', "[1]", '[{"a": 1}]', "{bad", "", None, ' {"a": "é\\n"}', '{"g": 1e3, "a": ""}']
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    keys = ("a", "b.c", "d", "f", "g", "none")
    both = df.select(jsons.json_tuple("j", *keys).alias("x"), F.array(*(F.get_json_object("j", f"$['{k}']") for k in keys)).alias("y")).collect()
    assert [r.x for r in both] == [r.y for r in both]


def test_time_bucket_with_origin(spark):
    ts = F.lit("2024-01-01 00:07:00").cast("timestamp")
    r = spark.range(1).select(timestamps.time_bucket(300_000_000, ts, F.lit("2024-01-01 00:01:00").cast("timestamp")).cast("string")).first()
    assert r[0] == "2024-01-01 00:06:00"
    with pytest.raises(ValueError):
        timestamps.time_bucket(0, ts)


def test_collect_errors_is_bounded_and_counts_all(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(10)], "a long, b long")
    found = policy.collect_errors(df, 3, r=policy.divide("a", "b"))
    assert found.by_kind == {"DivisionByZero": 5} and len(found.errors) == 3 and found.truncated
    assert found.rows.where("r is null").count() == 5
    good, bad = policy.quarantine(df, 6, r=policy.divide("a", "b"), c=policy.cast(F.lit("x"), "int"))
    assert good.count() == 0 and bad.count() == 10 and all(len(r["_preview"]) <= 6 for r in bad.collect())
    good, bad = Dataset(df).with_quarantine("full", lambda c: F.regexp_replace(c, "[0-9]+", "#"), r=policy.divide("a", "b"))
    assert good.count() == 5 and {r["_preview"] for r in bad.collect()} == {'{"a":#,"b":#}'} and bad.node == "WithPolicy"
    assert "_preview" not in policy.quarantine(df, None, r=policy.divide("a", "b"))[1].columns


def test_guarded_values_nest(spark):
    df = spark.createDataFrame([("1", "2", [1, 2]), ("x", "0", [0, 1]), ("6", "0", []), ("9223372036854775807", "1", None), (None, "3", [5, 0])], "a string, b string, xs array<int>")
    a, b = policy.cast("a", "bigint"), policy.cast("b", "bigint")

    def of(g):
        return [tuple(r) for r in policy.guarded(df, v=g).select("v", "_error").collect()]

    assert of(a / b) == [(0.5, None), (None, "InvalidValue"), (None, "DivisionByZero"), (9223372036854775807.0, None), (None, None)]
    assert of(1 + a) == [(2, None), (None, "InvalidValue"), (7, None), (None, "Overflow"), (None, None)]
    assert of(policy.choose(policy.call(lambda v: v != 0, b), a % b, -1)) == [(1, None), (-1, None), (-1, None), (0, None), (None, None)]
    assert of(policy.either(a, b)) == [(1, None), (None, "InvalidValue"), (6, None), (9223372036854775807, None), (3, None)]
    assert of(policy.each("xs", lambda x: policy.divide(10, x))) == [([10.0, 5.0], None), (None, "DivisionByZero"), ([], None), (None, None), (None, "DivisionByZero")]
    assert of(policy.element("xs", b)) == [(2, None), (None, "IndexOutOfBounds"), (None, "IndexOutOfBounds"), (None, None), (None, "IndexOutOfBounds")]
    assert of(policy.check(b, b.value > 2, "TooLarge")) == [(2, None), (0, None), (0, None), (1, None), (None, "TooLarge")]
    assert of(policy.call(lambda v: F.coalesce(v, F.lit(0)), a))[1] == (None, "InvalidValue")
    deep = a
    for _ in range(12):
        deep = policy.call(lambda v: v + 0, deep * 1)
    assert of(deep)[0] == (1, None)


def test_guards_of_texts(spark):
    df = spark.createDataFrame([("2024-02-29", "%41", "Z0E=", "<a><b>3</b></a>", '{"n": 1}'), ("2023-02-29", "%4", "Z", "<a>", "{"), (None, None, None, None, None)], "d string, u string, b string, x string, j string")
    guards = {
        "date": policy.date("d"),
        "stamp": policy.timestamp("d", "yyyy-MM-dd"),
        "url": policy.url_decode("u"),
        "binary": policy.binary("b", "base64"),
        "xpath": policy.xpath(xpaths.try_xpath_int, "x", "a/b"),
        "json": policy.variant(policy.json("j"), "$.n", "int"),
        "number": policy.number(policy.call(lambda d: F.left(d, F.lit(5)), "d"), "9999"),
        "aes": policy.aes_decrypt(policy.call(lambda d: F.when(d.endswith("24-02-29"), F.aes_encrypt(d, F.lit("0000111122223333"))).otherwise(d.cast("binary")), "d"), F.lit("0000111122223333")),
    }
    for name, g in guards.items():
        errors = [r[0] for r in policy.guarded(df, v=g).select("_error").collect()]
        assert errors == (["InvalidValue"] * 2 + [None] if name == "number" else [None, "InvalidValue", None]), name
    assert policy.guarded(df, v=guards["json"]).first().v == 1
    assert policy.guarded(df, v=policy.variant(policy.json(F.lit('{"n": "x"}')), "$.n", "int")).first()._error == "InvalidValue"


def test_bounded_top_values(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None), ("a", 3, 7.0), ("b", 4, None), (None, 5, 1.0), (None, 6, 1.0)], "k string, i long, _key0 double")
    rows = Dataset(df).group_by_agg([lambda r: r.k], [aggregates.max_n("_key0", 2).alias("t"), aggregates.count(), aggregates.min_by_n("i", "_key0", 1).alias("m"), lambda r: F.sum(r.i).alias("s")])
    assert rows.df.columns == ["k", "t", "count(1)", "m", "s"]
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([("a", [7.0, 5.0], 3, [1], 6), ("b", [], 1, [], 4), (None, [1.0, 1.0], 2, [5], 11)], key=str)
    assert Dataset(df).aggregate([aggregates.max_by_n("i", "_key0", 2).alias("t")]).collect()[0].t == [3, 1]
    assert Dataset(df).filter("i > 9").aggregate([aggregates.min_n("i", 3).alias("t"), aggregates.count().alias("n")]).collect()[0] == ([], 0)
    plan = Dataset(df).group_by_agg(["k"], [aggregates.min_n("i", 2)]).df._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "row_number(), 2, Partial" in plan


def test_lambdas_over_rows(people):
    d = Dataset(people)
    assert [tuple(r) for r in d.filter(lambda r: r.id == 1).select(lambda r: ("<" + r.name + ">").alias("s"), n=lambda r: (r.name + r.name).length, m=lambda r: r.id + 1).collect()] == [("<a>", 2, 2)]
    assert d.with_fields(t=lambda r: r.name + "!").filter("t = 'b!'").count() == 1
    low, high = d.partition(lambda r: r.dept > 10)
    assert (low.count(), high.count()) == (1, 2) and d.partition("dept > 10")[1].count() == 2
    good, bad = d.with_quarantine(v=lambda r: policy.divide(r.id, r.id % 2))
    assert (good.count(), bad.count()) == (2, 2)


def test_tuple_sketch_above_its_size(spark):
    df = spark.range(20_000).select(F.lit("g").alias("g"), (F.col("id") % 10_000).alias("k"), F.lit(1.0).alias("v"))
    s = sketches.tuple_sketch(df, ["g"], "k", "v", lg=10).select(sketches.estimate("sketch").alias("e"), sketches.theta("sketch").alias("t"), sketches.summary("sketch").alias("s")).first()
    assert abs(s.e / 10_000 - 1) < 0.1 and 0 < s.t < 1 and abs(s.s / 20_000 - 1) < 0.1


def test_set_operations_of_full_sketches(spark):
    """Two sets of 20,000 that share 10,000, in sketches of 4,096 and of 256 keys, against the same on the hashes below theta."""
    for lg in (12, 8):
        a, b = (sketches.tuple_sketch(spark.range(low, low + 20_000).select("id", F.lit(1).alias("v")), [], "id", "v", lg, kind="bigint").withColumnRenamed("sketch", n) for low, n in ((0, "a"), (10_000, "b")))
        made = a.crossJoin(b).select("a", "b", sketches.union("a", "b", lg).alias("u"), sketches.intersection("a", "b", lg).alias("i"), sketches.difference("a", "b", lg).alias("d"), sketches.union_theta("a", sketches.theta_sketch("b"), lg, 1).alias("t")).first()
        for got, exact in ((made.u, 30_000), (made.i, 10_000), (made.d, 10_000), (made.t, 30_000)):
            assert abs(len(got.entries) / got.theta - exact) < 4 * 30_000 / 2 ** (lg / 2)
        x, y = ({e.h: e.s for e in side.entries} for side in (made.a, made.b))
        least = min(made.a.theta, made.b.theta)
        both = {e.h for e in made.a.entries if e.u < least} & {e.h for e in made.b.entries if e.u < least}
        assert {e.h: e.s for e in made.i.entries} == {h: x[h] + y[h] for h in both}
        assert {e.h for e in made.d.entries} == {e.h for e in made.a.entries if e.u < least} - y.keys()
        order = sorted({(e.u, e.h) for side in (made.a, made.b) for e in side.entries if e.u < least})
        assert [(e.u, e.h) for e in made.u.entries] == order[: 1 << lg] and len(made.u.entries) == 1 << lg


def test_sources_round_trip(spark, people, tmp_path):
    for fmt in ("parquet", "orc", "json"):
        sources.write(people, str(tmp_path / fmt), fmt)
        assert sources.read(spark, str(tmp_path / fmt), fmt).count() == 4
    with pytest.raises(ValueError):
        sources.read(spark, "x", "xls")


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")], "t string, k string")
    rows.select(F.to_timestamp("t").alias("ts"), "k").write.parquet(str(tmp_path / "in"))
    batch = windowed(spark.read.parquet(str(tmp_path / "in")), "ts", "1 hour", ["k"], [F.count("*").alias("n")]).collect()
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
    out = windowed(stream, "ts", "1 hour", ["k"], [F.count("*").alias("n")], late="1 minute")
    q = out.writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, batch))


def test_materialized(people):
    m = Dataset(people.orderBy("id")).materialize()
    assert m.row_count == 4 and m.column("id") == [1, 2, 3, 4] and m.map(lambda r: r.id * 2) == [2, 4, 6, 8]
    seen = []
    m.foreach(lambda r: seen.append(r.name))
    again = Materialized.from_rows([tuple(r) for r in m.to_list()], m.schema)
    assert seen == ["a", "b", "c", "d"] and again.show(1) == m.show(1)
