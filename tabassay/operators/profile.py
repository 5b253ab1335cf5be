"""Per-column profiles by coarse type, and the dataset summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.moments import number_moments
from ..functions.quantiles import edge_requests, exact_quantiles
from ..functions.text import rounded, share
from ..functions.values import distinct_counts, top_values, value_counts
from ..sources.table import Table, ref
from .quality import duplicate_facts, missing_total
from .types import column_types, of_type, type_count_rows

TOP_VALUES = 5


QUARTILES = [0.25, 0.5, 0.75]


def quartile_requests(table: Table, columns) -> dict:
    """Aggregates that the quartiles begin with, to be declared before another scan of the numbers."""
    return edge_requests({c: table.count(c) for c in columns}, QUARTILES, table.number, table.sort_limit)


def quartiles(table: Table, columns) -> dict[str, list]:
    """{column: [p25, median, p75]}, exact."""
    known = table.once("quartiles", dict)
    todo = [c for c in columns if c not in known]
    if todo:
        narrow = table.df.select(*[table.number(c).alias(c) for c in todo])
        requests = quartile_requests(table, todo)
        known.update(exact_quantiles(narrow, {c: table.count(c) for c in todo}, QUARTILES, table.sort_limit,
                                     first_edges=lambda asked: table.aggregate({k: requests[k] for k in asked})))
    return {c: known[c] for c in columns}


def number_profiles(table: Table) -> dict[str, dict]:
    """Rounded numeric profile per column; statistics are None where there is no value."""
    return table.once("number_profiles", lambda: _number_profiles(table))


def _number_profiles(table):
    columns = of_type(table, "numeric")
    facts = table.facts()
    table.declare(quartile_requests(table, columns))  # in the scan of the moments
    shape = number_moments(table, columns)
    cuts = quartiles(table, columns)
    out = {}
    for c in columns:
        n = table.count(c)
        s = shape.get(c, {})
        p25, median, p75 = cuts[c]
        values = {"mean": s.get("mean"), "median": median, "std": s.get("std"),
                  "min": facts["min", c], "max": facts["max", c], "p25": p25, "p75": p75,
                  "skewness": s.get("skewness"), "kurtosis": s.get("kurtosis")}
        out[c] = {"count": n, "null_count": table.rows - n,
                  **{k: rounded(v, 4) for k, v in values.items()},
                  "zero_count": facts["zeros", c], "negative_count": facts["negatives", c]}
    return out


def profile_numeric(table: Table) -> DataFrame:
    rows = [(c, *p.values()) for c, p in number_profiles(table).items()]
    return table.frame(rows, """column string, count bigint, null_count bigint, mean double,
        median double, std double, min double, max double, p25 double, p75 double,
        skewness double, kurtosis double, zero_count bigint, negative_count bigint""")


def profile_categorical(table: Table, columns=None, k: int = TOP_VALUES) -> DataFrame:
    """(column, count, null_count, unique_count, mode, top_values) from one shared shuffle."""
    columns = of_type(table, "categorical") if columns is None else columns
    if not columns:
        return table.frame([], _CATEGORICAL)
    counts = value_counts(table, columns)
    # Reads n like the branch below, so that both share one scan and shuffle.
    unique = counts.groupBy("column").agg(F.count_if(F.col("n") > 0).alias("unique_count"))
    listed = table.frame([(c, table.count(c), table.missing_count(c)) for c in columns],
                         "column string, count bigint, null_count bigint")
    top = top_values(counts, k).join(F.broadcast(listed), "column")
    entry = F.struct("rank", "value", F.col("n").alias("count"),
                     F.round(F.col("n") / F.col("count") * 100, 2).alias("pct"))
    ranked = top.groupBy("column").agg(F.array_sort(F.collect_list(entry)).alias("ranked"))
    found = ranked.join(unique, "column")
    kept = F.transform("ranked", lambda e: F.struct(e["value"].alias("value"),
                                                    e["count"].alias("count"),
                                                    e["pct"].alias("pct")))
    return listed.join(F.broadcast(found), "column", "left").select(
        "column", "count", "null_count",
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        F.col("ranked")[0]["value"].alias("mode"),
        F.coalesce(kept, F.array().cast("array<struct<value:string,count:bigint,pct:double>>"))
        .alias("top_values"))


_CATEGORICAL = """column string, count bigint, null_count bigint, unique_count bigint, mode string,
    top_values array<struct<value:string,count:bigint,pct:double>>"""


def categorical_facts(table: Table) -> dict:
    """{column: {unique_count, top_values}}; five values per column."""
    return table.once("categorical", lambda: _categorical_facts(table))


def _categorical_facts(table):
    columns = of_type(table, "categorical")
    if not columns:
        return {}
    counts = value_counts(table, columns)
    unique = counts.groupBy("column").agg(F.count_if(F.col("n") > 0).alias("n"))  # reads n: one shuffle for both
    rows = (top_values(counts, TOP_VALUES).select("column", "rank", "value", "n")
            .unionByName(unique.select("column", F.lit(0).cast("bigint").alias("rank"), F.lit(None).cast("string").alias("value"), "n"))).collect()
    out = {c: {"unique_count": 0, "top_values": []} for c in columns}
    for r in sorted(rows, key=lambda r: r["rank"]):
        if r["rank"]:
            out[r["column"]]["top_values"].append(
                {"value": r["value"], "count": r["n"], "pct": share(r["n"], table.count(r["column"]))})
        else:
            out[r["column"]]["unique_count"] = r["n"]
    table.once("distinct", dict).update({c: facts["unique_count"] for c, facts in out.items()})
    return out


def profile_datetime(table: Table, columns=None) -> DataFrame:
    """Range, most common year and most common month of the parsed values."""
    columns = of_type(table, "datetime") if columns is None else columns
    facts = datetime_facts(table, columns)
    return table.frame([(c, *facts[c]) for c in columns], """column string, count bigint,
        null_count bigint, min_date string, max_date string, date_range_days bigint,
        most_common_year bigint, most_common_month bigint""")


def datetime_facts(table: Table, columns) -> dict:
    known = table.once("datetimes", dict)
    todo = [c for c in columns if c not in known]
    if todo:
        known.update(_datetime_facts(table, todo))
    return {c: known[c] for c in columns}


def _datetime_facts(table, columns):
    # Year and month together have few values, so one grouped count serves range and modes.
    stamps = table.df.select(*[table.stamp(c).alias(c) for c in columns])
    pairs = stamps.unpivot([], [ref(c) for c in columns], "column", "at").where("at IS NOT NULL")
    months = pairs.groupBy("column", F.year("at").alias("y"), F.month("at").alias("m")).agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    # At most 12 rows per column and year from here on.
    sums = months.groupingSets([["column"], ["column", "y"], ["column", "m"]], "column", "y", "m").agg(
        F.grouping_id().alias("level"), F.sum("n").alias("n"),
        F.min("first").alias("first"), F.max("last").alias("last"))
    level = F.col("level")  # 3: whole column, 1: year, 2: month

    def most_common(part, at):
        return F.max_by(part, F.when(level == at, F.struct("n", -F.col(part))))

    whole = level == 3
    span = sums.groupBy("column").agg(
        F.max(F.when(whole, F.col("n"))).alias("n"), F.min("first").alias("first"),
        F.max("last").alias("last"), most_common("y", 1).alias("year"),
        most_common("m", 2).alias("month"))
    days = F.floor((F.unix_micros(F.col("last").cast("timestamp"))
                    - F.unix_micros(F.col("first").cast("timestamp"))) / F.lit(86_400_000_000))
    whole_second = lambda c: F.date_format(c, "SSSSSS") == "000000"
    iso = lambda c: F.when(whole_second(c), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    rows = span.select(
        "column", "n", iso("first").alias("first"), iso("last").alias("last"),
        days.alias("days"), "year", "month").collect()
    got = {r["column"]: (r["n"], table.missing_count(r["column"]), r["first"], r["last"],
                         r["days"], r["year"], r["month"]) for r in rows}
    return {c: got.get(c, (0, table.missing_count(c), None, None, None, None, None))
            for c in columns}


def profile_text(table: Table) -> DataFrame:
    columns, facts = of_type(table, "text"), table.facts()
    unique = distinct_counts(table, columns)
    rows = [(c, table.count(c), table.missing_count(c), unique[c],
             rounded(table.mean_chars(c), 1), facts["min_chars", c], facts["max_chars", c])
            for c in columns]
    return table.frame(rows, """column string, count bigint, null_count bigint,
        unique_count bigint, avg_char_length double, min_char_length bigint, max_char_length bigint""")


def profile_id(table: Table) -> DataFrame:
    columns = of_type(table, "id")
    unique = distinct_counts(table, columns)
    rows = [(c, table.count(c), table.missing_count(c), unique[c],
             rounded(unique[c] / table.count(c), 4) if table.count(c) else 0.0)
            for c in columns]
    return table.frame(rows, """column string, count bigint, null_count bigint,
        unique_count bigint, uniqueness_ratio double""")


def memory_mb(table: Table) -> float:
    """Estimated size in memory: text bytes plus eight bytes for every other cell."""
    facts = table.facts()
    total = sum(facts["bytes", c] or 0 if table.is_string(c) else 8 * table.rows
                for c in table.columns)
    return rounded(total / 1024 ** 2, 3)


def dataset_summary(table: Table) -> DataFrame:
    missing, pct = missing_total(table)
    row = (table.rows, len(table.columns), missing, pct, memory_mb(table),
           *[n for _, n in type_count_rows(table)], duplicate_facts(table)["exact_count"])
    return table.frame([row], """total_rows bigint, total_columns bigint, total_missing_cells bigint,
        missing_pct double, memory_mb double, numeric_columns bigint, categorical_columns bigint,
        datetime_columns bigint, text_columns bigint, id_columns bigint,
        duplicate_row_count bigint""")


def profile_dataset(table: Table) -> DataFrame:
    """All columns in one long frame: (position, column, col_type, stats map)."""
    order = {c: i for i, c in enumerate(table.columns)}
    ranks = table.frame([(i, c, column_types(table)[c]) for c, i in order.items()],
                        "position bigint, column string, col_type string")
    parts = [profile_numeric(table), profile_categorical(table), profile_datetime(table),
             profile_text(table), profile_id(table)]
    stats = None
    for part in parts:
        names = [n for n in part.columns if n != "column"]
        value = [F.to_json("top_values") if n == "top_values" else F.col(n).cast("string")
                 for n in names]
        pairs = [e for n, v in zip(names, value) for e in (F.lit(n), v)]
        one = part.select("column", F.create_map(*pairs).alias("stats"))
        stats = one if stats is None else stats.unionByName(one)
    return F.broadcast(ranks).join(stats, "column").select(
        "position", "column", "col_type", "stats").orderBy("position")


def column_profile(profile: DataFrame, name: str) -> DataFrame:
    """The profile row of one column; empty when there is no such column."""
    return profile.where(F.col("column") == name)
