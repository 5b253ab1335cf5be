"""The table under examination: a DataFrame, its row id, and facts about its columns.

Facts are a handful of numbers per column. They are computed by Spark aggregates, kept on
the driver, and shared by all operators, so one scan serves many checks. Rows never come
to the driver.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ISO_STAMP = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?(Z|[+-]\d{2}:?\d{2})?$"
)
ISO_ZONE = r":.*(Z|[+-]\d{2}:?\d{2})$"
DATE_LIKE = (r"^\s*(\d{1,2}([-/.])\d{1,2}\2(\d{4}|\d{2})|\d{4}([-/.])\d{1,2}\4\d{1,2}|\d{8}|\d{1,2}([ -])[A-Z][a-z]{2,8}\5\d{4}"
             r"|[A-Z][a-z]{2,8} \d{1,2},? \d{4})([ T]|\s*$)")
AGGREGATES_PER_PASS = 120
# Requests that Spark evaluates without generated code, texts by row id and sketches. With one of
# them a scan has none at all, which costs more than a second scan once more than RIDERS others are asked for.
UNGENERATED = ("layout", "about", "edges")
RIDERS = 40
SMALL_FILES = 10_000  # files whose offsets may be broadcast

_NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def ref(name: str) -> Column:
    """Column reference that also works for names with dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def small_frame(spark: SparkSession, rows, ddl: str) -> DataFrame:
    """Frame of O(columns) report rows."""
    schema = T._parse_datatype_string(ddl)
    records = [dict(zip(schema.names, r)) for r in rows]
    arrow = pa.Table.from_pylist(records, schema=to_arrow_schema(schema))
    return spark.createDataFrame(arrow, schema)


def scratch_path(spark: SparkSession, label: str) -> str:
    """New path in the shared folder named by spark.checkpoint.dir (own folder only if unset)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tabassay-")
    return f"{base.rstrip('/')}/tabassay/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write once, read back: cuts lineage and survives lost executors."""
    return _stage(df, label)[0]


def _stage(df, label):
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a staged folder wherever it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Table:
    def __init__(self, df: DataFrame, name: str = "table", row_id: str | None = None,
                 datetime_formats: dict[str, str] | None = None,
                 sort_limit: int = 100_000):
        """``row_id`` names a technical key column; it is never profiled or counted.

        Without one, ids are assigned once and the table is staged, because
        recomputing generated ids could change them. Quantiles sort at most ``sort_limit``
        values of an interval in one buffer.
        """
        self._staged: list[str] = []
        if row_id is None:
            df, row_id = number_rows(df, self._staged), "row_id"
        if not isinstance(df.schema[row_id].dataType, T.IntegralType):
            raise ValueError(f"row id {row_id!r} must be a whole-number column")
        self.spark = df.sparkSession
        self.name = name
        self.row_id = row_id
        self.raw = df
        self.formats = datetime_formats or {}
        self.sort_limit = sort_limit
        self.schema = {f.name: f.dataType for f in df.schema.fields if f.name != row_id}
        self.columns = list(self.schema)
        self.df = df.select(ref(row_id), *[self._clean(c) for c in self.columns])
        self._memo: dict = {}
        self._known: dict = {}
        self._wanted: dict = {}

    def spread(self) -> Table:
        """A copy cut into one part per core and kept in memory or on disk, if the source has
        fewer splits than there are cores; otherwise the table itself.

        Worth it before several passes over a small or unsplittable source. A lost part is
        read and cut again: the cut is by row id.
        """
        cores = self.spark.sparkContext.defaultParallelism
        if self.raw.rdd.getNumPartitions() >= cores:
            return self
        kept = self.raw.repartition(cores, ref(self.row_id)).persist()
        return Table(kept, self.name, self.row_id, self.formats, self.sort_limit)

    def stage(self, df: DataFrame, label: str) -> DataFrame:
        """Write an intermediate result once; ``release`` removes it."""
        staged, path = _stage(df, label)
        self._staged.append(path)
        return staged

    def release(self) -> None:
        """Give back what ``spread`` kept and delete what this table staged; its results and the
        table itself, if it had to be staged, can no longer be read."""
        self.raw.unpersist()
        while self._staged:
            delete(self.spark, self._staged.pop())

    # -- column kinds ---------------------------------------------------------------

    def is_boolean(self, c):
        return isinstance(self.schema[c], T.BooleanType)

    def is_number(self, c):
        """Number dtype in the pandas sense: booleans excluded, ids included."""
        return isinstance(self.schema[c], T.NumericType)

    def is_string(self, c):
        return isinstance(self.schema[c], (T.StringType, T.CharType, T.VarcharType))

    def is_temporal(self, c):
        return isinstance(self.schema[c], _TEMPORAL)

    def is_nested(self, c):
        return isinstance(self.schema[c], _NESTED)

    @property
    def number_columns(self):
        return [c for c in self.columns if self.is_number(c)]

    @property
    def string_columns(self):
        return [c for c in self.columns if self.is_string(c)]

    # -- expressions ----------------------------------------------------------------

    def _clean(self, c):
        kind = self.schema[c]
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return F.nanvl(ref(c).cast("double"), F.lit(None).cast("double")).alias(c)
        if isinstance(kind, T.DecimalType):
            return ref(c).cast("double").alias(c)
        return ref(c)

    def number(self, c) -> Column:
        """The column as DOUBLE; booleans count as 0/1."""
        x = ref(c)
        return (x.cast("int") if self.is_boolean(c) else x).cast("double")

    def stamp(self, c) -> Column:
        """The column as TIMESTAMP_NTZ; text that does not parse becomes NULL.

        Text follows the given format, else the layout of its first date. Text with a zone
        becomes the moment in UTC.
        """
        x = ref(c)
        if self.is_temporal(c):
            return x.cast("timestamp_ntz")
        layout = self.formats.get(c) or self.layout(c)
        if layout:
            return F.try_to_timestamp(x, F.lit(layout)).cast("timestamp_ntz")
        wall = F.when(x.rlike(ISO_STAMP), x.try_cast("timestamp_ntz"))
        moment = F.convert_timezone(F.current_timezone(), F.lit("UTC"), x.try_cast("timestamp").cast("timestamp_ntz"))
        return F.when(x.rlike(ISO_ZONE), F.when(x.rlike(ISO_STAMP), moment)).otherwise(wall)

    def layout(self, c) -> str | None:
        """Date layout of a text column's first date by row id; None for ISO dates and others."""
        if not self.is_string(c):
            return None
        key = ("layout", c)
        expected = key in self._known or key in self._wanted
        first = self.aggregate(self.layout_requests([c] if expected else None))[key]
        return None if first is None else date_layout(first)

    def layout_requests(self, columns=None) -> dict:
        """First date of each of the text columns, all by default."""
        at = ref(self.row_id)
        return {("layout", c): F.min_by(ref(c), F.when(ref(c).rlike(DATE_LIKE), at))
                for c in (self.string_columns if columns is None else columns)}

    def text(self, c) -> Column:
        """The column as text; -0.0 is 0.0."""
        x = ref(c)
        return (x + F.lit(0.0) if isinstance(self.schema[c], (T.DoubleType, T.FloatType, T.DecimalType)) else x).cast("string")

    # -- facts ----------------------------------------------------------------------

    def once(self, key, compute):
        if key not in self._memo:
            self._memo[key] = compute()
        return self._memo[key]

    def declare(self, named: dict) -> None:
        """Named aggregates that a later check asks for: they share the next scan."""
        self._wanted.update({key: e for key, e in named.items() if key not in self._known})

    def aggregate(self, named: dict) -> dict:
        """Values of named global aggregates over the table. Those not known yet are evaluated
        together with all that were declared, in as few scans as code size and generated code allow."""
        missing = {key: e for key, e in named.items() if key not in self._known}
        if missing:
            items = list((self._wanted | missing).items())
            self._wanted = {}
            slow = [item for item in items if item[0][0] in UNGENERATED]
            fast = [item for item in items if item[0][0] not in UNGENERATED]
            for group in (fast, slow) if len(fast) > RIDERS else (items,):
                for start in range(0, len(group), AGGREGATES_PER_PASS):
                    part = group[start:start + AGGREGATES_PER_PASS]
                    row = self.df.agg(*[e.alias(f"a{i}") for i, (_, e) in enumerate(part)]).first()
                    self._known.update({key: row[i] for i, (key, _) in enumerate(part)})
        return {key: self._known[key] for key in named}

    def facts(self) -> dict:
        """One scan: row count, and per column counts, sums and extremes."""
        return self.once("facts", self._facts)

    def _facts(self):
        want = {("rows", None): F.count(F.lit(1))}
        for c in self.columns:
            want["n", c] = F.count(ref(c))
            if self.is_number(c) or self.is_boolean(c):
                x = self.number(c)
                want["mean", c] = F.avg(x)
                want["min", c] = F.min(x)
                want["max", c] = F.max(x)
                want["same", c] = F.min(ref(c)) == F.max(ref(c))  # in the column's own type
                want["zeros", c] = F.count_if(x == 0)
                want["negatives", c] = F.count_if(x < 0)
            elif self.is_string(c):
                want["chars", c] = F.sum(F.length(ref(c)))
                want["min_chars", c] = F.min(F.length(ref(c)))
                want["max_chars", c] = F.max(F.length(ref(c)))
                want["bytes", c] = F.sum(F.octet_length(ref(c)).cast("long"))
        return self.aggregate(want)

    @property
    def rows(self) -> int:
        return self.facts()["rows", None]

    def count(self, c) -> int:
        return self.facts()["n", c]

    def missing_count(self, c) -> int:
        return self.rows - self.count(c)

    def mean_chars(self, c) -> float:
        n = self.count(c)
        return self.facts()["chars", c] / n if n else 0.0

    def frame(self, rows, ddl) -> DataFrame:
        return small_frame(self.spark, rows, ddl)

    def preview(self, n: int = 100) -> DataFrame:
        """First rows in row order."""
        return self.df.orderBy(ref(self.row_id)).limit(n)

    def descriptor(self) -> DataFrame:
        from ..operators.types import column_types
        kinds = column_types(self)
        return self.frame(
            [(self.name, self.rows, len(self.columns), list(kinds.items()))],
            "name string, row_count bigint, col_count bigint, column_types map<string,string>")


def date_layout(text: str) -> str | None:
    """Layout of a date that is not ISO, as in the first value of a column; the day comes first
    only where the first number cannot be a month."""
    m = re.fullmatch(r"(.+?)(?:([ T])(\d{1,2}):(\d{2})(:\d{2})?(\.\d{1,6})?( ?[AaPp][Mm])?)?", text.strip())
    if not m:
        return None
    day, gap, hour, _, second, fraction, half = m.groups()
    if d := re.fullmatch(r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})", day):
        order = ("M", "d") if int(d[1]) <= 12 else ("d", "M")
        date = d[2].join([*order, "yyyy" if len(d[4]) == 4 else "yy"])
    elif d := re.fullmatch(r"\d{4}([/.])\d{1,2}\1\d{1,2}", day):
        date = d[1].join(("yyyy", "M", "d"))
    elif re.fullmatch(r"\d{8}", day):
        date = "yyyyMMdd"
    elif d := re.fullmatch(r"\d{1,2}([ -])([A-Z][a-z]{2,8})\1\d{4}", day):
        date = d[1].join(("d", "MMM" if len(d[2]) == 3 else "MMMM", "yyyy"))
    elif d := re.fullmatch(r"([A-Z][a-z]{2,8}) \d{1,2}(,?) \d{4}", day):
        date = ("MMM" if len(d[1]) == 3 else "MMMM") + f" d{d[2]} yyyy"
    else:
        return None
    if hour is None:
        return date
    time = ("h" if half else "H") + ":mm" + (":ss" if second else "") + ("." + "S" * (len(fraction) - 1) if fraction else "")
    return date + ("'T'" if gap == "T" else " ") + time + (" a" if half and half[0] == " " else "a" if half else "")


def number_rows(df: DataFrame, paths: list | None = None) -> DataFrame:
    """Add row_id = position in reading order, fixed by staging the rows; ``paths`` gets the folder.

    The parts' offsets meet the rows as in ``file_row_ids``: broadcast if they are at most
    SMALL_FILES, so that no row is shuffled.
    """
    staged, path = _stage(df.withColumn("_pos", F.monotonically_increasing_id()), "rows")
    if paths is not None:
        paths.append(path)
    part = F.shiftright(F.col("_pos"), 33)
    sizes = staged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    # One row per input partition.
    before = F.sum("_size").over(_all_before("_part"))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_offset"))
    few = [tuple(r) for r in offsets.limit(SMALL_FILES + 1).collect()]
    if len(few) <= SMALL_FILES:
        offsets = F.broadcast(small_frame(df.sparkSession, few, "_part bigint, _offset bigint"))
    numbered = staged.withColumn("_part", part).join(offsets, "_part")
    row_id = F.col("_offset") + F.col("_pos").bitwiseAND((1 << 33) - 1)
    return numbered.select(row_id.alias("row_id"), *[ref(c) for c in df.columns])


def _all_before(order):
    from pyspark.sql import Window
    return Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def file_row_ids(df: DataFrame) -> DataFrame:
    """Add row_id = dense position over the files of a parquet scan, without copying rows.

    File path and position in the file are stable, so recomputed tasks give the same ids. The
    files' offsets meet the rows on the full path: broadcast if they are at most SMALL_FILES, by
    Spark's own choice of join otherwise.
    """
    path = F.col("_metadata.file_path")
    sizes = df.groupBy(path.alias("_file")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(_all_before("_file")), F.lit(0))  # one row per file
    known = sizes.select("_file", before.alias("_offset"))
    few = [tuple(r) for r in known.limit(SMALL_FILES + 1).collect()]
    columns, pos = [ref(c) for c in df.columns], F.col("_metadata.row_index")
    if len(few) <= 1:
        return df.select(pos.alias("row_id"), *columns)
    if len(few) <= SMALL_FILES:
        known = F.broadcast(small_frame(df.sparkSession, few, "_file string, _offset bigint"))
    row_id = (F.col("_offset") + F.col("_pos")).alias("row_id")
    return (df.select(*columns, path.alias("_file"), pos.alias("_pos"))
            .join(known, "_file").select(row_id, *columns))


def read_parquet(spark, path, row_id=None, name=None, **options) -> Table:
    df = spark.read.parquet(path)
    if row_id is None:
        df, row_id = file_row_ids(df), "row_id"
    return Table(df, name or path.rsplit("/", 1)[-1], row_id, **options)


def read_table(spark, table, row_id=None, **options) -> Table:
    df = spark.table(table)
    if row_id is None:
        try:
            df, row_id = file_row_ids(df), "row_id"
        except AnalysisException:  # not read from files: the table numbers and stages its rows
            pass
    return Table(df, table, row_id, **options)
