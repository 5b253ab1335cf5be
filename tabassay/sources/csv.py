"""CSV reading: header row, usual missing-value tokens, types inferred from whole columns."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .records import csv_records
from .table import AGGREGATES_PER_PASS, Table, _stage, delete, number_rows, ref

# Cell texts that mean "missing".
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Cell texts that count as booleans.
BOOLEAN_TOKENS = ["True", "TRUE", "true", "False", "FALSE", "false"]

EXTRA = "_extra_cells"
INTEGER = r"^[+-]?\d+$"
REAL = r"(?i)^[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf|infinity)$"


def read_csv(spark: SparkSession, path: str, name: str | None = None,
             multiline: bool | None = None, **options) -> Table:
    """Read a CSV file into a Table; a row with more cells than the header is an error.

    Files are split over tasks. Where a cell holds a line break, which a first look at the lines
    finds (an odd number of quotes) or ``multiline`` says beforehand, each split first learns whether
    it starts inside quotes. The typed rows are staged as parquet, so later passes are columnar and
    row ids fixed. Without line breaks that is the only copy: types are learned from the file itself.
    """
    if multiline is None:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        multiline = bool(spark.read.text(path).where(quotes % 2 == 1).take(1))
    names = spark.read.csv(path, header=True, escape='"', multiLine=multiline, encoding="UTF-8").columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*names, EXTRA)])
    texts: list = []
    if multiline:
        cell = F.from_csv("text", schema.toDDL(), {"escape": '"', "multiLine": "true"})
        cells = csv_records(spark, path, texts).select("row_id", cell.alias("c")).select("row_id", "c.*")
    else:
        cells = spark.read.schema(schema).csv(path, header=True, escape='"', encoding="UTF-8")
    ids = ["row_id"] if multiline else []
    known = [F.when(~ref(c).isin(MISSING_TOKENS), ref(c)).alias(c) for c in names]
    marked = cells.select(*ids, *known, ref(EXTRA))

    checks = [F.count(ref(EXTRA)).alias("extra")]
    for i, c in enumerate(names):
        x = ref(c)
        checks += [
            F.count(F.lit(1)).alias(f"rows{i}"),
            F.count(x).alias(f"n{i}"),
            F.count_if(x.rlike(INTEGER) & x.try_cast("bigint").isNotNull()).alias(f"int{i}"),
            F.count_if(x.rlike(REAL) & x.try_cast("double").isNotNull()).alias(f"real{i}"),
            F.count_if(x.isin(BOOLEAN_TOKENS)).alias(f"bool{i}"),
        ]
    seen: dict = {}
    for start in range(0, len(checks), AGGREGATES_PER_PASS):
        seen.update(marked.agg(*checks[start:start + AGGREGATES_PER_PASS]).first().asDict())
    if seen["extra"]:
        for folder in texts:
            delete(spark, folder)
        raise ValueError(f"{path}: {seen['extra']} rows have more cells than the header has names")

    typed = [F.col(c) for c in ids]
    for i, c in enumerate(names):
        x, n = ref(c), seen[f"n{i}"]
        if n == 0:
            e = x.try_cast("double")
        elif seen[f"int{i}"] == n:
            e = x.try_cast("bigint")
        elif seen[f"real{i}"] == n:
            e = x.try_cast("double")
        elif seen[f"bool{i}"] == n:
            # With gaps a boolean column stays text, as in the usual CSV reader.
            e = x.try_cast("boolean") if n == seen[f"rows{i}"] else F.initcap(x)
        else:
            e = x
        typed.append(e.alias(c))
    staged: list = []
    if multiline:
        made, folder = _stage(marked.select(*typed), "csv")
        staged.append(folder)
        delete(spark, texts[0])
    else:
        made = number_rows(marked.select(*typed), staged)
    table = Table(made, name or path.rsplit("/", 1)[-1], "row_id", **options)
    table._staged += staged
    return table
