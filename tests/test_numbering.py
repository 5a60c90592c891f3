"""Row numbers over ranges."""

from seqgraph.functions.numbering import numbered


def test_rows_are_numbered_in_order_with_one_shuffle(spark):
    rows = spark.range(1_000).selectExpr("(id * 7919) % 1000 as x", "id % 3 as kind", "cast(id as string) as text").repartition(5)
    found = numbered(rows, ["kind", "x"], "n")
    told = found.collect()
    assert [(r.kind, r.x) for r in sorted(told, key=lambda r: r.n)] == sorted((r.kind, r.x) for r in told)
    assert sorted(r.n for r in told) == list(range(1_000)) and found.columns == ["x", "kind", "text", "n"]
    # The rows were dealt where they were written; what follows shuffles only a row for each range.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and all("text" not in line for line in plan.splitlines() if "Window" in line)
    assert numbered(rows.limit(0), ["x"], "n").collect() == []
