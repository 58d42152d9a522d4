"""The stored field index: both forms of each predicate give the same documents."""

import json
import random

import pytest
from pyspark.sql import functions as F

from vaultql.operators import fields as I
from vaultql.operators.find import Query
from vaultql.operators.validate import Rule

NAMES = ["a", "b", "q\"uo.t'e", "never"]
POOL = [
    "x", "[[x]]", "[[X|y]]", "xy", "", "[[]]", "true", "1", "5.0", "2024-01-02", "2024-01-02T00:00:00Z", "2023", "é", "%_", 1, 5, 5.0, 0, -3, 2.5, True, False, None, [], [None], [None, "x"],
    ["x", 1, True], [["x"], 2], {"k": "x"}, {"k": 1.0}, [{"k": 1}], 9007199254740993, 9007199254740992, 1e300, 12345678901234567890,
]
NEEDLES = ["x", "[[x]]", "", "[[", "t", "1", "2024", '{"k"', "%", "é", "[", "5"]
VALUES = [9007199254740992.0, 1e300, "x", "[[x]]", "1", "true", "", 1, 5, 5.0, 0, True, False, 2.5, '{"k":"x"}', 9007199254740993, 9007199254740992, '["x"]']
DATES = ["2024-01-02", "2023-12-31", "1", "0", "2024-01-02T00:00:00Z", "x"]


def documents(spark, seed, n=150):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        meta = {name: rng.choice(POOL) for name in NAMES[:3] if rng.random() < 0.8}
        rows.append((f"d/{i}.md", json.dumps(meta) if rng.random() < 0.97 else None))
    return spark.createDataFrame(rows, "path string, j string").select("path", F.parse_json("j").alias("metadata"))


def random_query(rng, q):
    for _ in range(rng.choice([1, 1, 2, 3])):
        name, what = rng.choice(NAMES), rng.randrange(11)
        some = rng.choices(VALUES, k=rng.randint(0, 3))
        one = rng.choice(VALUES)
        needle, day = rng.choice(NEEDLES), rng.choice(DATES)
        q = [
            lambda: q.eq(name, one), lambda: q.not_eq(name, one), lambda: q.isin(name, some), lambda: q.not_in(name, some), lambda: q.has(name), lambda: q.missing(name),
            lambda: q.starts_with(name, needle), lambda: q.ends_with(name, needle), lambda: q.contains(name, needle),
            lambda: rng.choice([q.before, q.after, q.on])(name, day), lambda: q.path("d/1*.md"),
        ][what]()
    return q


@pytest.mark.parametrize("seed", [1, 2])
def test_both_forms_agree(spark, seed):
    docs = documents(spark, seed).cache()
    index = I.build(docs, NAMES)
    rng = random.Random(seed)
    asked = [random_query(rng, Query(docs, index=index)) for _ in range(40)]
    found = {}
    for route in ("scan", "auto"):
        frames = [q.frame(everything=True, route=route).select(F.lit(k).alias("k"), "path") for k, q in enumerate(asked)]
        for at in range(0, len(frames), 10):
            union = frames[at]
            for f in frames[at + 1 : at + 10]:
                union = union.unionByName(f)
            for r in union.collect():
                found.setdefault(r.k, {}).setdefault(route, []).append(r.path)
    assert all(sorted(v.get("scan", [])) == sorted(v.get("auto", [])) for v in found.values())
    assert sum(0 < len(v.get("scan", [])) < 150 for v in found.values()) > 10
    docs.unpersist()


def test_every_document_has_a_row_for_each_field(spark):
    docs = documents(spark, 3).cache()
    rows = I.shredded(docs, NAMES)
    assert rows.select("path", "field").distinct().count() == 150 * 4 and rows.where("field = 'never' AND kind <> 'absent'").count() == 0
    kinds = {r.kind for r in rows.select("kind").distinct().collect()}
    assert kinds == {"absent", "empty", "string", "number", "boolean", "array", "object"}
    assert I.shredded(docs, []).collect() == [] and I.shredded(docs.limit(0), NAMES).collect() == []
    docs.unpersist()


def test_routing_and_pruning(spark):
    docs = documents(spark, 4)
    index = I.build(docs, ["a", "b"])
    q = Query(docs, index=index)
    assert q.eq("a", "x").by_index() and not q.eq("a", "x").has("never").by_index() and not q.path("d/*").by_index() and not Query(docs).eq("a", "x").by_index()
    with pytest.raises(ValueError, match="fields of all"):
        q.has("never").frame(route="index")
    with pytest.raises(ValueError, match="route"):
        q.eq("a", "x").frame(route="cache")

    def plan(frame):
        return frame._jdf.queryExecution().executedPlan().toString()

    made = plan(q.eq("a", "[[x]]").not_eq("b", 5).frame())
    assert "LeftSemi" in made and "LeftAnti" in made and "field#" in made
    assert "(field#" in made.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(text,x)" in made
    assert "LeftSemi" not in plan(q.eq("a", "x").frame(route="scan")) and "LeftSemi" not in plan(q.eq("a", "x").has("never").frame())


def test_refresh_equals_a_new_index(spark, tmp_path):
    before, after = documents(spark, 5), documents(spark, 6)
    number = F.regexp_extract("path", "([0-9]+)", 1).cast("int")
    changed, gone = after.where(number < 40), before.where(number.between(100, 120)).select("path")
    index = I.build(before, NAMES, path=f"file://{tmp_path}/one")
    got = I.refreshed(index, changed, gone, path=f"file://{tmp_path}/two")
    want = I.shredded(before.where((number >= 40) & ~number.between(100, 120)).unionByName(changed), NAMES)
    columns = ["path", "field", "kind", "number", "whole", "text"]
    assert got.frame.select(columns).exceptAll(want.select(columns)).count() == 0 == want.select(columns).exceptAll(got.frame.select(columns)).count()
    assert got.digest == index.digest != I.FieldIndex(index.frame, ("a",)).digest


def test_which_fields_are_indexed():
    rules = [Rule("r", types={"day": "date", "body": "text", "tags": "list_of_strings", "n": "number"}, allowed={"status": ["a"]})]
    assert I.indexed_fields(rules) == ("day", "status", "tags")
    assert I.indexed_fields(rules, {"body": True, "day": False}) == ("body", "status", "tags")
    assert I.indexed_fields(rules, {"body": True}, auto=False) == ("body",)


def test_tasks_of_the_index_follow_the_rows(spark, monkeypatch):
    """Documents are counted: twice as many make twice as many tasks and files of one size, not larger tasks."""
    monkeypatch.setattr(I, "ROWS", 500)
    for n in (1000, 2000):
        docs = spark.range(n).selectExpr("concat(id, '.md') AS path", "parse_json(concat('{\"a\": ', id % 3, ', \"b\": \"x\"}')) AS metadata")
        index = I.build(docs, ["a", "b"])
        per = [r["count"] for r in index.frame.groupBy(F.input_file_name()).count().collect()]
        assert sum(per) == 2 * n and len(per) == 2 * (n // 250 + 1) and max(per) < 400
        assert sorted(r.path for r in Query(docs, index=index).eq("a", 1).frame(route="index").collect()) == sorted(f"{k}.md" for k in range(n) if k % 3 == 1)
