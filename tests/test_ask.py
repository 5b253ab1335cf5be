import pytest

from tabassay.operators import ask


@pytest.fixture
def orders(table):
    return table("order_id bigint, status string, amount double", [
        (i, "OK" if i % 4 else "HOLD", float(i)) for i in range(80)])


def test_answer(orders):
    a = ask.ask(orders, "SELECT status, count(*) AS n FROM df GROUP BY status")
    assert a.success and a.error == "" and a.elapsed_ms > 0
    assert {r["status"]: r["n"] for r in a.result.collect()} == {"OK": 60, "HOLD": 20}


def test_preview_notes_the_total(orders):
    a = ask.ask(orders, "SELECT * FROM df")
    assert len(a.preview) == 50 and a.note == "... (80 total rows)"
    assert ask.ask(orders, "SELECT * FROM df LIMIT 50").note == ""


def test_one_correction(orders):
    calls = []

    def fix(sql, error):
        calls.append(error)
        return "SELECT max(amount) AS m FROM df"
    a = ask.ask(orders, "SELECT nope FROM df", fix)
    assert a.success and a.result.first()["m"] == 79.0 and len(calls) == 1
    b = ask.ask(orders, "SELECT nope FROM df", lambda sql, error: sql)
    assert not b.success and "nope" in b.error and b.result is None


def test_other_relations_are_refused(spark, orders, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/other")
    spark.range(5).selectExpr("id * 2 AS k").createOrReplaceTempView("other_view")
    spark.read.parquet(f"{tmp_path}/other").createOrReplaceTempView("other_file")
    path = f"parquet.`{tmp_path}/other`"
    for sql in (f"SELECT count(*) AS n FROM {path}", "SELECT * FROM other_file", f"SELECT * FROM df WHERE order_id IN (SELECT id FROM {path})",
                f"SELECT (SELECT max(id) FROM {path}) AS m FROM df", f"WITH x AS (SELECT * FROM {path}) SELECT * FROM df JOIN x ON id = order_id"):
        a = ask.ask(orders, sql)
        assert not a.success and "not the table" in a.error and a.result is None, sql
    for sql in ("SELECT a.order_id FROM df a JOIN df b ON a.order_id = b.order_id + 1", "SELECT * FROM VALUES (1), (2)", "SELECT * FROM range(3)",
                "WITH x AS (SELECT * FROM df) SELECT count(*) FROM x WHERE amount > (SELECT avg(amount) FROM df)", "SELECT 1"):
        a = ask.ask(orders, sql)
        assert a.success, (sql, a.error)


def test_runtime_errors_are_reported(orders):
    a = ask.ask(orders, "SELECT 1 / (amount - amount) FROM df")
    assert not a.success and "DIVIDE_BY_ZERO" in a.error


def test_commands_are_refused_and_views_survive(orders, spark):
    spark.range(3).createOrReplaceTempView("df")
    for sql in ("CREATE TABLE made AS SELECT 1 AS x", "DROP VIEW df", "SELECT 1) UNION (SELECT 2"):
        ask.ask(orders, sql)
    assert not ask.ask(orders, "CREATE TABLE made AS SELECT 1 AS x").success
    assert ask.ask(orders, "SELECT count(*) AS n FROM df;").result.first()["n"] == 80
    assert spark.table("df").count() == 3
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("made", "tabassay"))]
    spark.catalog.dropTempView("df")


def test_samples_are_literals(table):
    t = table("note string", [("it's",), ('a "b"',), ("both ' and \"",), ("x\n\\",)])
    assert ask.schema_context(t).first()["samples"] == ", ".join(repr(v) for v in ["it's", 'a "b"', "both ' and \"", "x\n\\"])


def test_shapes(orders):
    assert {r["status"]: r["value"] for r in ask.aggregate(orders, "amount", "sum", ["status"]).collect()} == {
        "OK": 2400.0, "HOLD": 760.0}
    assert [r["status"] for r in ask.rank(orders, "amount", "status", 1).collect()] == ["OK"]
    assert [r["status"] for r in ask.rank(orders, "amount", "status", 1, ascending=True).collect()] == ["HOLD"]
    assert {r["value"]: r["pct"] for r in ask.distribution(orders, "status").collect()} == {"OK": 75.0, "HOLD": 25.0}
    assert sum(r["count"] for r in ask.distribution(orders, "amount", 7).collect()) == 80


def test_schema_text(orders):
    text = ask.schema_text(orders)
    assert text.startswith("Dataset: literal  (80 rows × 3 columns)")
    assert "[Categorical]  samples: 'HOLD', 'OK', 'OK', 'OK', 'HOLD'" in text
    assert "min=0, max=79, mean=39.5" in text
