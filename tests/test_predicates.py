from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kgspark.plans import predicates as P


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        ("a", "commit", "alpha", 9.0, True, ["x", "yy"], "10", '{"k": "v", "n": 5}'),
        ("b", "file", "Beta", 10.0, False, [], "9", None),
        ("c", "file", None, None, None, None, "text", '{"k": "w"}'),
        ("d", "person", "delta", 9.0, True, ["5"], "9.0", "{}"),
    ]
    return spark.createDataFrame(data, "id string, type string, name string, n double, flag boolean, tags array<string>, mixed string, attrs string")


@pytest.mark.parametrize(
    ("where", "expected"),
    [
        ("name=alpha", "a"),
        ("name!=alpha", "bd"),
        ("name~lt", "d"),
        ("name~ETA", ""),
        ("name>alpha", "d"),
        ("name<=Beta", "b"),
        ("n=9", "ad"),
        ("n!=9", "b"),
        ("n>=9.5", "b"),
        ("n~9", ""),
        ("mixed>9", "a"),
        ("mixed!=9", "a"),
        ("mixed=text", "c"),
        ("flag=yes", "ad"),
        ("flag=1", "ad"),
        ("flag!=TRUE", "b"),
        ("flag>true", ""),
        ("tags=x", "a"),
        ("tags!=x", "bd"),
        ("tags~y", "a"),
        ("tags=5", "d"),
        ("tags>x", ""),
        ("k=v", "a"),
        ("k!=v", "c"),
        ("n=5", ""),
        ("missing=1", ""),
        ("missing!=1", ""),
        ("type=file", "bc"),
    ],
)
def test_conditions(rows, where, expected):
    assert "".join(sorted(r["id"] for r in P.filtered(rows, where=[where]).collect())) == expected


def test_operator_order_is_by_operator():
    assert P.parse("name=a~b") == P.Predicate("name=a", "~", "b")
    assert P.parse("a>=b") == P.Predicate("a", ">=", "b")
    assert P.parse("x!=y=z") == P.Predicate("x", "!=", "y=z")
    with pytest.raises(P.PredicateError):
        P.parse("=x")
    with pytest.raises(P.PredicateError):
        P.parse("nothing")


def order(df, **kw):
    keys = P.sort_keys(df, **kw)
    return "".join(r["id"] for r in df.orderBy(*keys).collect())


def test_sorting(rows):
    assert order(rows) == "abcd"
    assert order(rows, descending=True) == "abcd"
    assert order(rows, field="n") == "adbc"
    assert order(rows, field="n", descending=True) == "bdac"
    assert order(rows, field="mixed") == "bdac"
    assert order(rows, field="mixed", descending=True) == "adbc"
    assert order(rows, field="flag") == "badc"
    assert order(rows, field="name") == "badc"


def test_paging(rows):
    page = P.ranked(rows, P.sort_keys(rows), 2, 1)
    assert [(r["id"], r["rank"]) for r in page.orderBy("rank").collect()] == [("b", 2), ("c", 3)]
    assert P.ranked(rows, P.sort_keys(rows), 0).count() == 0
    assert P.ranked(rows, P.sort_keys(rows), 5, 9).count() == 0
    assert P.truncated(4, 2, 1) and not P.truncated(4, 2, 2) and not P.truncated(4, None)


def test_groups_and_types(rows):
    assert {r["group"]: r["n"] for r in P.grouped(rows, "flag").collect()} == {"true": 2, "false": 1, "_missing": 1}
    assert {r["group"]: r["n"] for r in P.grouped_with_total(rows, "type").collect()} == {"commit": 1, "file": 2, "person": 1, "_total": 4}
    assert P.filtered(rows, ["file", "file", "commit"]).count() == 3


def test_variant_attributes(spark, rows):
    own = rows.withColumn("attrs", F.parse_json("attrs"))
    assert [r["id"] for r in P.filtered(own, where=["k=v"]).collect()] == ["a"]


def test_filter_reaches_the_scan(spark, small):
    df = spark.read.parquet(f"{small}/orders.parquet").withColumnRenamed("o_orderstatus", "type")
    plan = P.filtered(df, ["F"], ["o_orderpriority=1-URGENT"]).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan or "EqualTo(o_orderstatus,F)" in plan
