import pytest

from tabassay import read_csv, read_parquet
from tabassay.operators.types import column_types


@pytest.fixture
def csv(spark, tmp_path):
    def make(text, **options):
        path = tmp_path / "in.csv"
        path.write_text(text, encoding="utf-8")
        return read_csv(spark, str(path), **options)
    return make


def test_inference(csv):
    t = csv("i,f,s,b,gap,yes,e,d\n1,1.5,x,True,1,yes,1e3,1d\n-2,NA,n/a,False,,no,2,2d\n3,3,z,TRUE,3,1,.5,3d\n")
    kinds = {f.name: f.dataType.simpleString() for f in t.df.schema.fields}
    assert kinds == {"row_id": "bigint", "i": "bigint", "f": "double", "s": "string", "b": "boolean",
                     "gap": "bigint", "yes": "string", "e": "double", "d": "string"}
    assert t.missing_count("f") == 1 and t.missing_count("s") == 1 and t.missing_count("gap") == 1
    assert [r["row_id"] for r in t.preview().collect()] == [0, 1, 2]


def test_quotes_and_line_breaks(csv):
    t = csv('a,b\n"q ""z""","two\nlines"\n"x, y",plain\n')
    rows = t.preview().collect()
    assert rows[0]["a"] == 'q "z"' and rows[0]["b"] == "two\nlines" and rows[1]["a"] == "x, y"


def test_missing_tokens(csv):
    tokens = ["#N/A", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null", "<NA>", "-nan"]
    t = csv("v,w\n" + "".join(f"{x},a\n" for x in tokens) + "2.5,b\n")
    assert t.count("v") == 1 and t.facts()["mean", "v"] == 2.5


def test_boolean_with_gaps_stays_text(csv):
    t = csv("flag,x\nTRUE,1\n,2\nfalse,3\n")
    assert t.schema["flag"].simpleString() == "string"
    assert [r["flag"] for r in t.preview().collect()] == ["True", None, "False"]


def test_all_missing_column_is_numeric(csv):
    assert column_types(csv("a,b\n,1\nNA,2\n"))["a"] == "numeric"


def test_dates_stay_text(csv):
    t = csv("order_date,v\n2024-01-01,1\n2024-02-01,2\n")
    assert t.schema["order_date"].simpleString() == "string"
    assert column_types(t)["order_date"] == "datetime"


def test_extra_cells_are_an_error(csv):
    with pytest.raises(ValueError, match="1 rows have more cells"):
        csv("a,b\n1,2\n3,4,5\n")
    assert csv("a,b\n1,2\n3\n").rows == 2


@pytest.mark.parametrize("text,layout", [
    ("01/15/2024", "M/d/yyyy"), ("15/01/2024", "d/M/yyyy"), ("15.01.24", "d.M.yy"), ("2024/1/5", "yyyy/M/d"), ("20240115", "yyyyMMdd"),
    ("5 Jan 2024", "d MMM yyyy"), ("January 5, 2024", "MMMM d, yyyy"), ("01/15/2024 10:05:00.25", "M/d/yyyy H:mm:ss.SS"),
    ("1/5/2024 1:05 PM", "M/d/yyyy h:mm a"), ("2024-01-15", None), ("soon", None)])
def test_layout_of_the_first_value(text, layout):
    from tabassay.sources.table import date_layout
    assert date_layout(text) == layout


def test_dates_follow_the_first_layout(table):
    from tabassay.operators import profile, quality
    t = table("ship_date string", [("01/15/2024",), ("02/20/2024",), ("2024-03-01",), (None,), ("13/01/2024",)])
    row = profile.profile_datetime(t, ["ship_date"]).first()
    assert (row["count"], row["min_date"], row["max_date"]) == (2, "2024-01-15T00:00:00", "2024-02-20T00:00:00")
    assert quality.violation_facts(t)["ship_date"][0] == 2


def test_fractions_and_zones(table):
    from tabassay.operators import profile
    t = table("at_time string", [("2024-01-15T10:00:00.250001",), ("2024-01-15T23:00:00+05:00",), ("2024-01-16T00:00:00Z",)])
    row = profile.profile_datetime(t, ["at_time"]).first()
    assert (row["min_date"], row["max_date"]) == ("2024-01-15T10:00:00.250001", "2024-01-16T00:00:00")


def test_own_type_extremes_and_negative_zero(table):
    from tabassay.operators import basic, quality
    t = table("big bigint, z double", [(2**60 + i, -0.0 if i % 2 else 0.0) for i in range(60)])
    assert basic.single_valued(t) == ["z"]
    from tabassay.functions.values import distinct_counts
    assert distinct_counts(t, ["big", "z"]) == {"big": 60, "z": 1}
    assert quality.missing(t).count() == 2


def test_release_deletes_what_was_staged(csv, tmp_path):
    import os
    t = csv("a,b\n1,2\n")
    folder = t._staged[0].removeprefix("file:")
    assert os.path.isdir(folder)
    t.release()
    assert not os.path.exists(folder)


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace
    from tabassay.sources.table import scratch_path
    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError):
        scratch_path(far, "x")


def test_parquet_row_ids_follow_files(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(100).repartitionByRange(3, "id").write.parquet(path)
    t = read_parquet(spark, path)
    ids = sorted((r["row_id"], r["id"]) for r in t.df.collect())
    assert [i for i, _ in ids] == list(range(100))
    assert [v for _, v in ids] == list(range(100))


@pytest.mark.parametrize("size", [400, 3001, 1 << 27])
def test_line_breaks_over_many_splits(spark, tmp_path, size):
    """Records across the borders of splits and of files equal those of one task per file."""
    import csv as writer
    import random
    rng = random.Random(size)
    bits = ["a", "b,", '"', "\n", "\r\n", 'x"y', " ", "é", "word ", "\n\n", '""', "long " * 120]
    rows = [(i, "".join(rng.choices(bits, weights=[5] * 11 + [.1], k=rng.randrange(8))), rng.choice(["u", '5" pipe', "NA", ""])) for i in range(400)]
    (tmp_path / "t").mkdir()
    for part, end in enumerate(("\n", "\r\n", "\n", "\n")):  # the last file has a header only
        with open(tmp_path / "t" / f"{part}.csv", "w", newline="", encoding="utf-8-sig" if part == 2 else "utf-8") as f:
            out = writer.writer(f, lineterminator=end)
            out.writerows([("i", "long\nname", "u"), *rows[part * 150:part * 150 + 150]])
            f.write("\n" if part == 1 else "")
    missing = {"", "NA"}
    want = [(i, i, *(None if v in missing else v for v in cells)) for i, *cells in rows]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        t = read_csv(spark, f"{tmp_path}/t")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert t.columns == ["i", "long\nname", "u"]
    assert [tuple(r) for r in t.preview(1000).collect()] == want


def test_states_of_lines():
    from tabassay.sources.records import ends_inside
    for line, outside, inside in (("a,b", False, True), ('"a', True, False), ('a"b', False, False), ('"a""', True, False), ('x","y', True, True),
                                  ('x,"y', True, False), ('"",""', False, True), ("", False, True), ('"a"b,"c', True, True)):
        assert (ends_inside(line, False), ends_inside(line, True)) == (outside, inside), line


def test_csv_rows_are_copied_once_and_not_shuffled(spark, tmp_path, monkeypatch):
    """Types come from the file; numbering stages the typed rows and broadcasts the offsets of the parts."""
    from tabassay.sources import table
    made = []
    real = table._stage
    for module in (table, __import__("tabassay.sources.csv", fromlist=["csv"])):
        monkeypatch.setattr(module, "_stage", lambda df, label: made.append(df.columns) or real(df, label))
    folder = str(tmp_path / "many")
    spark.range(0, 1000, 1, 5).selectExpr("id", "concat('t', id) AS word", "if(id % 7 = 0, 'NA', string(id / 2)) AS half").write.csv(folder, header=True)
    limits = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.maxPartitionBytes": "4000"}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        t = read_csv(spark, folder, multiline=False)
        assert made == [["id", "word", "half", "_pos"]]
        plan = t.df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
        rows = t.df.orderBy("row_id").collect()
    finally:
        for k in limits:
            spark.conf.unset(k)
    assert [r["row_id"] for r in rows] == list(range(1000))
    assert sorted((r["id"], r["word"], r["half"]) for r in rows) == [(i, f"t{i}", None if i % 7 == 0 else i / 2) for i in range(1000)]


def test_types_of_csv_take_one_copy(spark, monkeypatch):
    import query_registry
    from tabassay.sources import csv as reader, table
    made = []
    real = table._stage
    for module in (table, reader):
        monkeypatch.setattr(module, "_stage", lambda df, label: made.append(label) or real(df, label))
    assert query_registry.queries()["read_csv_types"](spark, "/root/testdata/sf0.001").count() == 15
    assert made == ["rows"]
