"""DuckDB SQL for the registered queries, written per column and with global windows."""

from __future__ import annotations

from sample_views import DQ_ORDERS, US_ORDERS
from tabassay.sources.csv import MISSING_TOKENS

NUM = ["amount", "amount_tax", "price_low", "price_high", "skewed", "spiky", "tier", "gauss"]
CAT = ["status", "priority", "ref_code", "middle_name"]
STR = ["status", "priority", "ref_code", "event_date", "middle_name", "notes"]
NUMBERS = ["order_id", *NUM]
COLUMNS = ["order_id", *NUM, *STR]
DUCK_DQ = DQ_ORDERS.format(orders="orders")

OPTIONAL_WORDS = """['suite','apt','apartment','unit','fax','middle','nickname','alias','optional',
  'secondary','alt','extension','ext','line2']"""
PROSE_WORDS = """['description','desc','note','notes','comment','comments','narrative','summary',
  'detail','details','text','body','feedback','reason','remarks','remark','memo','explanation']"""
NON_NEGATIVE = """['age','price','cost','amount','quantity','count','salary','revenue','distance',
  'weight','height','duration','rate','score','size']"""
SPACES = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)"


def dq(body, *ctes):
    parts = [f"dq AS MATERIALIZED ({DUCK_DQ})", *ctes]
    return "WITH " + ",\n".join(parts) + "\n" + body


def each(columns, make, start=0):
    return "\nUNION ALL\n".join(make(c, i) for i, c in enumerate(columns, start))


def rounded(*names):
    return ", ".join(f"round({n}, 4) + 0.0 AS {n}" for n in names)


# -- shared pieces --------------------------------------------------------------------

def shapes(table, numbers, words=(), stamps=()):
    """Per column: position, dtype, rows, non-null count, mean length, distinct values."""
    columns = [*numbers, *words, *stamps]

    def one(c, i):
        dtype = "num" if c in numbers else "str" if c in words else "ts"
        length = f"avg(length({c}))" if c in words else "NULL"
        return (f"SELECT {i} AS position, '{c}' AS \"column\", '{dtype}' AS dtype, count(*) AS rows, "
                f"count({c}) AS n, {length}::DOUBLE AS mean_chars, count(DISTINCT {c}) AS uniq FROM {table}")
    return f"shapes AS ({each(columns, one)})"


KINDS = r"""kinds AS (
  SELECT *, CASE
    WHEN string_split_regex(lower("column"), '[\s_\-]+')[1] = 'id'
      OR string_split_regex(lower("column"), '[\s_\-]+')[-1] = 'id' THEN 'id'
    WHEN dtype = 'num' THEN 'numeric' WHEN dtype = 'ts' THEN 'datetime'
    WHEN contains(lower("column"), 'date') OR contains(lower("column"), 'time') THEN 'datetime'
    WHEN mean_chars > 50 THEN 'text' ELSE 'categorical' END AS col_type
  FROM shapes)"""

ROLES = rf"""roles AS (
  SELECT *, CASE role WHEN 'id' THEN 'ID' WHEN 'numeric_measure' THEN 'Numeric'
    WHEN 'datetime' THEN 'Datetime' WHEN 'categorical_low' THEN 'Categorical'
    WHEN 'categorical_high' THEN 'High-Card. Cat.' WHEN 'free_text' THEN 'Free Text'
    ELSE 'Optional' END AS label
  FROM (SELECT *, CASE
    WHEN col_type = 'id' THEN 'id' WHEN col_type = 'numeric' THEN 'numeric_measure'
    WHEN col_type = 'datetime' THEN 'datetime'
    WHEN list_has_any(string_split_regex(lower("column"), '[\s_\-]+'), {PROSE_WORDS})
      OR (uniq * 100.0 / rows > 50 AND mean_chars > 30) THEN 'free_text'
    WHEN list_has_any(string_split_regex(lower("column"), '[\s_\-]+'), {OPTIONAL_WORDS})
      OR regexp_matches(regexp_replace(lower("column"), '[\s_\-]', '', 'g'), 'address2|addr2|line2')
      OR ((rows - n) * 100.0 / rows > 40 AND coalesce(mean_chars, 0) <= 30) THEN 'optional_text'
    WHEN uniq <= 20 THEN 'categorical_low' ELSE 'categorical_high' END AS role
  FROM kinds))"""

DQ_SHAPES = shapes("dq", NUMBERS, STR)


def number_profile(table, columns):
    def one(c, i):
        return f"""SELECT {i} AS position, '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS null_count,
  avg({c})::DOUBLE AS mean, median({c})::DOUBLE AS median, stddev_samp({c}) AS std, min({c})::DOUBLE AS min,
  max({c})::DOUBLE AS max, quantile_cont({c}, 0.25)::DOUBLE AS p25, quantile_cont({c}, 0.75)::DOUBLE AS p75,
  coalesce(skewness({c}), 0) AS skewness, coalesce(kurtosis({c}), 0) AS kurtosis,
  count(*) FILTER ({c} = 0) AS zero_count, count(*) FILTER ({c} < 0) AS negative_count FROM {table}"""
    return f"numbers AS ({each(columns, one)})"


PROFILE_OUT = """SELECT "column", count, null_count, """ + rounded(
    "mean", "median", "std", "min", "max", "p25", "p75", "skewness", "kurtosis"
) + ", zero_count, negative_count FROM numbers"


def counts_of(table, columns):
    return "counts AS (" + each(columns, lambda c, i: (
        f"SELECT {i} AS position, '{c}' AS \"column\", {c} AS value, count(*) AS n FROM {table} "
        f"WHERE {c} IS NOT NULL GROUP BY {c}")) + ")"


RANKED = """ranked AS (SELECT *, sum(n) OVER (PARTITION BY "column")::BIGINT AS total,
  count(*) OVER (PARTITION BY "column") AS uniq,
  row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM counts)"""

TOP_OUT = """SELECT "column", rank, value, n AS count, round(n * 100.0 / total, 2) + 0.0 AS pct
FROM ranked WHERE rank <= 5"""


def stamps_of(table, column, text=False):
    at = f"TRY_CAST({column} AS TIMESTAMP)" if text else column
    return f"""stamped AS (SELECT * FROM (SELECT {at} AS moment FROM {table}) WHERE moment IS NOT NULL)"""


def iso_text(x):
    return (f"CASE WHEN epoch_us({x}::TIMESTAMP) % 1000000 = 0 THEN strftime({x}, '%Y-%m-%dT%H:%M:%S') "
            f"ELSE strftime({x}, '%Y-%m-%dT%H:%M:%S.%f') END")


def datetime_profile(table, column):
    return f"""SELECT '{column}' AS "column", count(*) AS count,
  (SELECT count(*) FROM {table} WHERE {column} IS NULL) AS null_count,
  {iso_text('min(moment)')} AS min_date, {iso_text('max(moment)')} AS max_date,
  CAST(floor((epoch_us(max(moment)) - epoch_us(min(moment))) / 86400000000) AS BIGINT) AS date_range_days,
  (SELECT year(moment) FROM stamped GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_common_year,
  (SELECT month(moment) FROM stamped GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_common_month
FROM stamped"""


def text_profile(table, columns):
    return each(columns, lambda c, i: f"""SELECT '{c}' AS "column", count({c}) AS count,
  count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count,
  round(avg(length({c})), 1) AS avg_char_length, min(length({c})) AS min_char_length,
  max(length({c})) AS max_char_length FROM {table}""")


def id_profile(table, columns):
    return each(columns, lambda c, i: f"""SELECT '{c}' AS "column", count({c}) AS count,
  count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count,
  round(count(DISTINCT {c}) / count({c})::DOUBLE, 4) AS uniqueness_ratio FROM {table}""")


# -- quality --------------------------------------------------------------------------

def missing_of(table, columns):
    return "missing AS (" + each(columns, lambda c, i: (
        f"SELECT {i} AS position, '{c}' AS \"column\", count(*) - count({c}) AS missing_count, "
        f"round((count(*) - count({c})) * 100.0 / count(*), 2) + 0.0 AS missing_pct FROM {table}")) + ")"


def longest_run(c, i):
    return f"""SELECT '{c}' AS "column", coalesce(max(len), 0) AS longest_run FROM (
  SELECT count(*) AS len FROM (
    SELECT {c} IS NULL AS gone, row_number() OVER (ORDER BY row_id)
      - row_number() OVER (PARTITION BY {c} IS NULL ORDER BY row_id) AS island FROM dq)
  WHERE gone GROUP BY island)"""


RUNS = f"runs AS ({each(COLUMNS, longest_run)})"
PATTERNS = """patterns AS (SELECT *, CASE WHEN missing_count = 0 THEN 'none'
  WHEN longest_run > 0.2 * missing_count THEN 'clustered' ELSE 'scattered' END AS pattern
  FROM missing JOIN runs USING ("column"))"""
DUPES = f"""dupes AS (SELECT (sum(n) - count(*))::BIGINT AS exact_count,
  round((sum(n) - count(*)) * 100.0 / sum(n), 2) + 0.0 AS exact_pct
  FROM (SELECT count(*) AS n FROM dq GROUP BY {", ".join(COLUMNS)}))"""
NEAR = f"""near AS (SELECT min(row_id) AS group_row_id, count(*) AS n FROM dq
  GROUP BY {", ".join(COLUMNS[1:])} HAVING count(*) >= 2)"""
VIOLATIONS = """bad AS (SELECT event_date AS value, count(*) AS n, min(row_id) AS first_row FROM dq
  WHERE event_date IS NOT NULL AND TRY_CAST(event_date AS TIMESTAMP) IS NULL GROUP BY 1),
violations AS (SELECT 'event_date' AS "column", sum(n)::BIGINT AS violation_count,
  (SELECT string_agg(value, ', ' ORDER BY first_row) FROM (SELECT * FROM bad ORDER BY first_row LIMIT 5)) AS samples
  FROM bad HAVING sum(n) > 0)"""
CARDINALITY = """cardinality AS (SELECT position, "column",
  CASE col_type WHEN 'categorical' THEN 'high_cardinality_categorical'
    ELSE 'low_cardinality_numeric' END AS kind, uniq AS unique_count,
  round(uniq * 100.0 / rows, 2) + 0.0 AS unique_pct
  FROM kinds WHERE rows > 50 AND ((col_type = 'categorical' AND round(uniq * 100.0 / rows, 2) > 50)
    OR (col_type = 'numeric' AND uniq < 10)))"""


def spelling_of(c, i):
    return f"""SELECT {i} AS position, '{c}' AS "column",
  coalesce((SELECT bool_or({c} <> trim({c}, {SPACES})) FROM dq), false) AS padded,
  coalesce((SELECT max(k) > 1 FROM (SELECT count(*) AS k FROM dq WHERE {c} IS NOT NULL
    GROUP BY lower(trim({c}, {SPACES})))), false)
  AND coalesce((SELECT min(k) = 1 FROM (SELECT count(*) AS k FROM dq WHERE {c} IS NOT NULL
    GROUP BY trim({c}, {SPACES}))), false) AS casing,
  (SELECT count(DISTINCT trim({c}, {SPACES})) > count(DISTINCT lower(trim({c}, {SPACES}))) FROM dq) AS strict"""


SPELLING = f"spelling AS ({each(STR, spelling_of)})"


def negatives_of(table, columns):
    return "negatives AS (" + each(columns, lambda c, i: (
        f"SELECT {i} AS position, '{c}' AS \"column\", count(*) FILTER ({c} < 0) AS negative_count, "
        f"round(count(*) FILTER ({c} < 0) * 100.0 / count({c}), 2) + 0.0 AS negative_pct FROM {table} "
        f"HAVING count(*) FILTER ({c} < 0) > 0 "
        f"AND list_bool_or(list_transform({NON_NEGATIVE}, lambda w: contains(lower('{c}'), w)))")) + ")"


TOTALS = """totals AS (SELECT sum(missing_count)::BIGINT AS missing_cells,
  round(sum(missing_count) * 100.0 / ((SELECT count(*) FROM dq) * count(*)), 2) + 0.0 AS total_pct,
  count(*) AS n_cols FROM missing)"""
HEALTH = """health AS (SELECT round(0.30 * greatest(0, 100 - 3 * total_pct)
  + 0.20 * greatest(0, 100 - 5 * exact_pct)
  + 0.20 * 100 * (1 - (SELECT count(*) FROM violations)::DOUBLE / n_cols)
  + 0.30 * (100 - 10 * ((SELECT count(*) > 0 FROM cardinality)::INT
    + (SELECT count(*) > 0 FROM spelling WHERE padded OR casing)::INT
    + (SELECT count(*) > 0 FROM negatives)::INT)), 1)::DOUBLE AS health_score FROM totals, dupes)"""
BANDED = """banded AS (SELECT health_score, CASE WHEN health_score > 80 THEN 'Good'
  WHEN health_score >= 50 THEN 'Fair' ELSE 'Poor' END AS band FROM health)"""
QUALITY = [DQ_SHAPES, KINDS, missing_of("dq", COLUMNS), RUNS, PATTERNS, DUPES, NEAR, VIOLATIONS,
           CARDINALITY, SPELLING, negatives_of("dq", NUMBERS), TOTALS, HEALTH, BANDED]
ISSUES = """listed AS (
  SELECT 1 AS grp, position, "column", 'Missing Values' AS issue_type,
    CASE WHEN missing_pct > 30 THEN 'High' WHEN missing_pct > 10 THEN 'Medium' ELSE 'Low' END AS severity,
    missing_count || ' missing (' || missing_pct || '%, ' || pattern || ')' AS detail
  FROM patterns WHERE missing_count > 0
  UNION ALL SELECT 2, 0, '(all columns)', 'Duplicate Rows',
    CASE WHEN exact_pct > 10 THEN 'High' ELSE 'Medium' END,
    exact_count || ' exact duplicates (' || exact_pct || '%)' FROM dupes WHERE exact_count > 0
  UNION ALL SELECT 3, 0, 'order_id', 'Near-Duplicate Rows', 'Low',
    count(*) || ' row groups identical except in ''order_id''' FROM near HAVING count(*) > 0
  UNION ALL SELECT 4, 0, "column", 'Type Violation', 'Medium',
    violation_count || ' values can''t be cast (e.g. ' || samples || ')' FROM violations
  UNION ALL SELECT 5, position, "column", 'Cardinality Anomaly', 'Low',
    CASE kind WHEN 'high_cardinality_categorical'
      THEN unique_count || ' unique values (' || unique_pct || '%) — may be free text or an ID column'
      ELSE 'Only ' || unique_count || ' unique values — may be categorical' END FROM cardinality
  UNION ALL SELECT 6, position, "column", 'Whitespace / Casing', 'Low',
    concat_ws(', ', CASE WHEN padded THEN 'leading/trailing spaces' END,
      CASE WHEN casing THEN 'casing variants (e.g. ''Apple'' vs ''apple'')' END)
  FROM spelling WHERE padded OR casing
  UNION ALL SELECT 7, position, "column", 'Unexpected Negatives', 'Medium',
    negative_count || ' negative values (' || negative_pct || '%)' FROM negatives),
issues AS (SELECT row_number() OVER (ORDER BY grp, position) - 1 AS ordinal, "column", issue_type,
  severity, detail FROM listed)"""
JUDGED = """judged AS (SELECT i.*, CASE
  WHEN issue_type = 'Missing Values' AND role = 'optional_text' THEN 'suppress'
  WHEN issue_type = 'Missing Values' AND role = 'free_text' THEN 'downgrade'
  WHEN issue_type = 'Cardinality Anomaly' AND role IN ('id','free_text','categorical_high') THEN 'suppress'
  WHEN issue_type = 'Whitespace / Casing' AND role IN ('id','free_text') THEN 'suppress'
  WHEN issue_type = 'Whitespace / Casing' AND role = 'optional_text' THEN 'downgrade'
  ELSE 'keep' END AS action FROM issues i LEFT JOIN roles r ON i."column" = r."column")"""
# Position of a cardinality issue is its table column, as in the column-ordered check.


# -- insights -------------------------------------------------------------------------

NUMBERS_4 = """numbers4 AS (SELECT position, "column", count, round(mean, 4) AS mean, round(median, 4) AS median,
  round(std, 4) AS std, round(skewness, 4) AS skewness FROM numbers)"""


def skews(table, columns):
    return [number_profile(table, columns), NUMBERS_4, """skews AS (SELECT position, "column" AS columns,
  'distribution_skew' AS finding_type, printf('skewness=%.2f', skewness) AS statistic,
  CASE WHEN abs(skewness) > 5 THEN 'high' ELSE 'medium' END AS severity,
  json_object('column', "column", 'skewness', round(skewness, 2), 'direction',
    CASE WHEN skewness > 0 THEN 'right-skewed (long tail of high values)'
      ELSE 'left-skewed (long tail of low values)' END,
    'mean', round(mean, 2), 'median', round(median, 2))::VARCHAR AS context
  FROM numbers4 WHERE count >= 10 AND abs(skewness) > 2)"""]


def pairs_sql(table="dq", columns=NUMBERS):
    out = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns[i + 1:], i + 1):
            out.append(f"SELECT {i * 100 + j} AS position, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM {table}")
    return "corrs AS (SELECT position, a, b, CASE WHEN isnan(r) THEN NULL ELSE r END AS r FROM (" + \
        "\nUNION ALL\n".join(out) + "))"


HIGH_CORR = """highcorr AS (SELECT position, a || ', ' || b AS columns, 'high_correlation' AS finding_type,
  printf('r=%.2f', r) AS statistic, CASE WHEN abs(r) > 0.95 THEN 'high' ELSE 'medium' END AS severity,
  json_object('column_a', a, 'column_b', b, 'pearson_r', round(r, 2),
    'direction', CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END)::VARCHAR AS context
  FROM corrs WHERE abs(r) > 0.85)"""


def outliers_sql():
    one = lambda c, i: (
        f"SELECT s.*, count(*) FILTER (abs(d.{c} - s.mean) > 3 * s.std) * 100.0 / count(d.{c}) AS pct "
        f"FROM numbers4 s, dq d WHERE s.\"column\" = '{c}' GROUP BY ALL")
    return f"""outliers AS (SELECT position, "column" AS columns, 'outlier_prevalence' AS finding_type,
  printf('%.1f%% outliers (±3σ)', pct) AS statistic, CASE WHEN pct > 15 THEN 'high' ELSE 'medium' END AS severity,
  json_object('column', "column", 'outlier_pct', round(pct, 1), 'mean', round(mean, 2), 'std', round(std, 2),
    'bounds', round(mean - 3 * std, 2) || ' to ' || round(mean + 3 * std, 2))::VARCHAR AS context
  FROM ({each(NUM, one)}) WHERE count >= 10 AND std > 0 AND pct > 5)"""


DOMINANCE = """dominance AS (SELECT position, "column" AS columns, 'categorical_dominance' AS finding_type,
  '''' || value || ''' in ' || printf('%.1f', round(n * 100.0 / total, 2)) || '% of rows' AS statistic,
  CASE WHEN round(n * 100.0 / total, 2) > 90 THEN 'high' ELSE 'medium' END AS severity,
  json_object('column', "column", 'dominant_value', value,
    'dominant_pct', round(round(n * 100.0 / total, 2), 1), 'unique_value_count', uniq)::VARCHAR AS context
  FROM ranked WHERE rank = 1 AND round(n * 100.0 / total, 2) > 70)"""


def gaps_of(table, column, text=False):
    return stamps_of(table, column, text) + f""",
gaps AS (SELECT (epoch_us(moment) - lag(epoch_us(moment)) OVER (ORDER BY moment)) / 1e6 AS gap FROM stamped),
gapstats AS (SELECT '{column}' AS "column", count(*) AS n, avg(gap) AS mean_gap, stddev_samp(gap) AS std_gap FROM gaps)"""


GAPS_OF_STAMPS = """gaps AS (SELECT (epoch_us(moment) - lag(epoch_us(moment)) OVER (ORDER BY moment)) / 1e6 AS gap FROM stamped),
gapstats AS (SELECT '{column}' AS "column", count(*) AS n, avg(gap) AS mean_gap, stddev_samp(gap) AS std_gap FROM gaps)"""
US_DATES = f"us AS ({US_ORDERS.format(orders='orders')})"


def us_stamps():
    return "stamped AS (SELECT * FROM (SELECT try_strptime(ship_date, '%m/%d/%Y') AS moment FROM us) WHERE moment IS NOT NULL)"


def gap_text(x):
    return (f"CASE WHEN {x} < 7200 THEN printf('%.0f seconds', {x}) WHEN {x} < 172800 "
            f"THEN printf('%.1f hours', {x} / 3600) ELSE CAST(floor({x} / 86400) AS BIGINT) || ' days' END")


DATE_GAPS = f"""dategaps AS (SELECT 0 AS position, "column" AS columns, 'date_gaps' AS finding_type,
  printf('gap CV=%.2f', std_gap / mean_gap) AS statistic,
  CASE WHEN std_gap / mean_gap > 2 THEN 'high' ELSE 'medium' END AS severity,
  json_object('column', "column", 'mean_gap', {gap_text('mean_gap')}, 'std_gap', {gap_text('std_gap')},
    'coefficient_of_variation', round(std_gap / mean_gap, 2),
    'note', 'High CV means the time between records is irregular.')::VARCHAR AS context
  FROM gapstats WHERE n >= 10 AND mean_gap > 0 AND std_gap / mean_gap > 0.5)"""
CONTRADICTIONS = """contradictions AS (SELECT 0 AS position, 'price_low, price_high' AS columns,
  'cross_column_contradiction' AS finding_type, above || ' rows where price_low > price_high' AS statistic,
  CASE WHEN round(above * 100.0 / complete, 1) > 10 THEN 'high' ELSE 'medium' END AS severity,
  json_object('column_a', 'price_low', 'column_b', 'price_high',
    'rule_violated', 'price_low should be ≤ price_high', 'violation_count', above,
    'violation_pct', round(above * 100.0 / complete, 1)::DOUBLE)::VARCHAR AS context
  FROM (SELECT count(*) FILTER (price_low > price_high) AS above,
    count(*) FILTER (price_low IS NOT NULL AND price_high IS NOT NULL) AS complete FROM dq) WHERE above > 0)"""
FINDING_PARTS = ["skews", "highcorr", "outliers", "dominance", "dategaps", "contradictions"]
FINDING_CTES = [*skews("dq", NUM), pairs_sql(), HIGH_CORR, outliers_sql(), counts_of("dq", CAT), RANKED,
                DOMINANCE, gaps_of("dq", "event_date", True), DATE_GAPS, CONTRADICTIONS]
FINDINGS = "findings AS (SELECT row_number() OVER (ORDER BY grp, position) - 1 AS ordinal, columns, " \
    "finding_type, statistic, severity, context FROM (" + " UNION ALL ".join(
        f"SELECT {i} AS grp, * FROM {p}" for i, p in enumerate(FINDING_PARTS)) + "))"


def finding_out(part):
    return (f"SELECT row_number() OVER (ORDER BY position) - 1 AS ordinal, columns, finding_type, "
            f"statistic, severity, context FROM {part}")


def histogram(table, columns, bins):
    def one(c, i):
        return f"""SELECT {i} AS position, '{c}' AS "column", b AS bin, lo + b * ((hi - lo) / {bins}) AS low,
  lo + (b + 1) * ((hi - lo) / {bins}) AS high,
  (SELECT count(*) FROM {table} WHERE {c} IS NOT NULL
    AND least(floor(({c} - lo) / (hi - lo) * {bins}), {bins - 1}) = b) AS count
FROM (SELECT CASE WHEN min({c}) = max({c}) THEN min({c}) - 0.5 ELSE min({c}) END::DOUBLE AS lo,
  CASE WHEN min({c}) = max({c}) THEN max({c}) + 0.5 ELSE max({c}) END::DOUBLE AS hi FROM {table}),
  range({bins}) r(b)"""
    return f"hist AS ({each(columns, one)})"


# -- anomalies ------------------------------------------------------------------------

def iqr_of(table, columns, row_id="row_id"):
    def one(c, i):
        return f"""SELECT {row_id} AS row_id, '{c}' AS "column", {c}::DOUBLE AS x, q1, q3 FROM {table},
  (SELECT quantile_cont({c}, 0.25)::DOUBLE AS q1, quantile_cont({c}, 0.75)::DOUBLE AS q3, count({c}) AS n FROM {table})
  WHERE n >= 10 AND q3 > q1 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))"""
    return f"""iqrcells AS ({each(columns, one)}),
iqr AS (SELECT row_id, "column", 'iqr' AS method_used, least(1.0, (k - 1.5) / 3.5::DOUBLE) AS anomaly_score,
  CASE WHEN k >= 3 THEN 'high' WHEN k >= 2 THEN 'moderate' ELSE 'low' END AS severity,
  x AS raw_value, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper,
  printf('[%.4g, %.4g]', q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) AS expected_range,
  "column" AS primary_driver_feature
  FROM (SELECT *, CASE WHEN x < q1 THEN (q1 - x) / (q3 - q1) ELSE (x - q3) / (q3 - q1) END AS k FROM iqrcells))"""


def normality_of(table, columns):
    # Population moments from centred sums; chained steps of the published formulas.
    def one(c, i):
        return f"""SELECT {i} AS position, '{c}' AS "column", n, mean, sd, s3 / n / pow(s2 / n, 1.5) AS g1,
  s4 / n / pow(s2 / n, 2) AS b2 FROM (SELECT count(v)::DOUBLE AS n, any_value(mean) AS mean, any_value(sd) AS sd,
    sum(pow(v - mean, 2)) AS s2, sum(pow(v - mean, 3)) AS s3, sum(pow(v - mean, 4)) AS s4
    FROM (SELECT {c}::DOUBLE AS v, (SELECT avg({c}) FROM {table})::DOUBLE AS mean,
      (SELECT stddev_samp({c}) FROM {table}) AS sd FROM {table})) WHERE n >= 10 AND s2 > 0"""
    return f"""moments AS ({each(columns, one)}),
step1 AS (SELECT *, g1 * sqrt((n+1)*(n+3)/(6*(n-2))) AS y0,
  -1 + sqrt(2 * (3*(n*n+27*n-70)*(n+1)*(n+3)/((n-2)*(n+5)*(n+7)*(n+9)) - 1)) AS w2,
  3*(n-1)/(n+1) AS e, 24*n*(n-2)*(n-3)/((n+1)*(n+1)*(n+3)*(n+5)) AS v,
  6*(n*n-5*n+2)/((n+7)*(n+9)) * sqrt(6*(n+3)*(n+5)/(n*(n-2)*(n-3))) AS s FROM moments),
step2 AS (SELECT *, CASE WHEN y0 = 0 THEN 1 ELSE y0 END / sqrt(2 / (w2 - 1)) AS ya, (b2 - e) / sqrt(v) AS x,
  6 + (8 / s) * (2 / s + sqrt(1 + 4 / (s * s))) AS a FROM step1),
step3 AS (SELECT *, ln(ya + sqrt(ya * ya + 1)) / sqrt(0.5 * ln(w2)) AS zs, 1 + x * sqrt(2 / (a - 4)) AS d FROM step2),
normality AS (SELECT *, exp(-(zs * zs + pow((1 - 2 / (9 * a) - sign(d) * pow((1 - 2 / a) / abs(d), 1 / 3.0::DOUBLE))
  / sqrt(2 / (9 * a)), 2)) / 2) AS p_value FROM step3)"""


NORMALITY_OUT = """SELECT "column", n::BIGINT AS n, round(p_value, 4) + 0.0 AS p_value,
  p_value > 0.05 AS is_normal FROM normality"""


def zscore_of(table, columns, thr, row_id="row_id"):
    def one(c, i):
        return f"""SELECT {row_id} AS row_id, '{c}' AS "column", {c}::DOUBLE AS x, mean, sd FROM {table}, normality
  WHERE "column" = '{c}' AND p_value > 0.05 AND sd > 0 AND abs(({c} - mean) / sd) > {thr}"""
    return f"""zcells AS ({each(columns, one)}),
zscore AS (SELECT row_id, "column", 'zscore' AS method_used, least(1.0, (abs((x - mean) / sd) - {thr}) / 4.0::DOUBLE) AS anomaly_score,
  CASE WHEN abs((x - mean) / sd) >= {thr} + 2 THEN 'high' ELSE 'moderate' END AS severity, x AS raw_value,
  mean - {thr} * sd AS lower, mean + {thr} * sd AS upper,
  printf('[%.4g, %.4g]  (μ ± %.1fσ)', mean - {thr} * sd, mean + {thr} * sd, {thr}::DOUBLE) AS expected_range,
  "column" AS primary_driver_feature FROM zcells)"""


RECORDS = [iqr_of("dq", NUM), normality_of("dq", NUM), zscore_of("dq", NUM, 3),
           """records AS (SELECT * FROM iqr UNION ALL SELECT * FROM zscore)""",
           """composite AS (SELECT row_id, least(1.0, greatest(0.0, max(anomaly_score))
             + 0.15 * (count(DISTINCT method_used) - 1)) AS composite_score,
             count(DISTINCT method_used) AS methods FROM records GROUP BY row_id)""",
           """shown AS (SELECT row_id, "column", CASE method_used WHEN 'iqr' THEN 'IQR' ELSE 'Z-Score' END AS method,
             severity, round(composite_score, 3) AS score, raw_value, expected_range
             FROM records JOIN composite USING (row_id))""",
           """panel AS (SELECT (SELECT count(*) FROM records) AS records, count(*) AS rows_flagged,
             count(*) FILTER (methods >= 2) AS multi_method_rows,
             round(count(*) * 100.0 / (SELECT count(*) FROM dq), 1) + 0.0 AS flagged_pct FROM composite)""",
           """top AS (SELECT row_id, composite_score, severity, primary_driver_feature, "column", method_used
             FROM records JOIN composite USING (row_id)
             ORDER BY composite_score DESC, row_id, anomaly_score DESC, "column", method_used LIMIT 1)"""]
RECORD_OUT = """SELECT row_id, "column", method_used, {}, severity, expected_range, primary_driver_feature FROM {{}}""".format(
    rounded("anomaly_score", "raw_value", "lower", "upper"))

# -- isolation forest: the same digests, grown and walked level by level ------------------------------

TREES, SAMPLE, DEPTH = 100, 256, 8
UNIT = "(('0x' || substr(md5({}), {}, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
PATH = """round(({level} + CASE WHEN n <= 1 THEN 0 WHEN n = 2 THEN 1
  ELSE 2 * (ln((n - 1)::DOUBLE) + 0.5772156649::DOUBLE) - 2 * (n - 1)::DOUBLE / n END) * 16777216)::BIGINT"""


def forest_of(table, columns, row_id="row_id"):
    """scores (row_id, fs, score), where fs lists the columns with gaps filled by medians."""
    filled = ", ".join(f"coalesce({c}::DOUBLE, (SELECT median({c}::DOUBLE) FROM {table}))" for c in columns)
    unit = lambda what, at=1: UNIT.format(what, at)
    least, most = ("list_value(" + ", ".join(f"{fn}(fs[{i}])" for i in range(1, len(columns) + 1)) + ")" for fn in ("min", "max"))
    parts = [f"""feat AS MATERIALIZED (SELECT {row_id} AS row_id, list_value({filled}) AS fs FROM {table})""",
             f"""lines AS MATERIALIZED (SELECT t, 1 + floor({unit("'42:' || t || ':slope'")} * 2147483646)::BIGINT AS a,
  floor({unit("'42:' || t || ':shift'")} * 2147483647)::BIGINT AS b FROM range({TREES}) r(t))""",
             f"""pool AS (SELECT row_id, fs, ('0x' || substr(md5('42:' || row_id), 17, 8))::BIGINT % 2147483647 AS number FROM feat
  WHERE {unit("'42:' || row_id")} < {4 * TREES * SAMPLE}.0::DOUBLE / (SELECT count(*) FROM feat))""",
             f"""l0 AS MATERIALIZED (SELECT t, 0::BIGINT AS slot, fs FROM (SELECT t, row_id, (number * a + b) % 2147483647 AS draw FROM pool, lines
  QUALIFY row_number() OVER (PARTITION BY t ORDER BY draw, row_id) <= {SAMPLE}) JOIN feat USING (row_id))"""]
    for level in range(DEPTH):
        parts.append(f"""s{level} AS MATERIALIZED (SELECT t, slot, n, spread[floor({unit("'42:' || t || ':' || slot")} * len(spread))::INTEGER + 1] AS f, lows, highs,
  {unit("'42:' || t || ':' || slot", 14)} AS u FROM (SELECT *, CASE WHEN n > 1 THEN list_filter(range(1, {len(columns) + 1}), lambda i: highs[i] > lows[i]) ELSE [] END AS spread
    FROM (SELECT t, slot, count(*) AS n, {least} AS lows, {most} AS highs FROM l{level} GROUP BY t, slot)))""")
        parts.append(f"""l{level + 1} AS MATERIALIZED (SELECT t, 2 * slot + 1 + (fs[f] > lows[f] + u * (highs[f] - lows[f]))::INTEGER AS slot, fs
  FROM l{level} JOIN s{level} USING (t, slot) WHERE f IS NOT NULL)""")
    leaves = [f"SELECT t, slot, {PATH.format(level=level)} AS path FROM s{level} WHERE f IS NULL" for level in range(DEPTH)]
    leaves.append(f"SELECT t, slot, {PATH.format(level=DEPTH)} FROM (SELECT t, slot, count(*) AS n FROM l{DEPTH} GROUP BY t, slot)")
    cuts = " UNION ALL ".join(f"SELECT t, slot, f, lows[f] + u * (highs[f] - lows[f]) AS cut FROM s{level} WHERE f IS NOT NULL" for level in range(DEPTH))
    parts += [f"cuts AS MATERIALIZED ({cuts})", f"leaves AS MATERIALIZED ({' UNION ALL '.join(leaves)})"]
    walk = f"(SELECT row_id, t, fs, 0::BIGINT AS slot FROM feat, lines)"
    for level in range(DEPTH):
        walk = f"""(SELECT row_id, w.t, fs, CASE WHEN f IS NULL THEN w.slot ELSE 2 * w.slot + 1 + (fs[f] > cut)::INTEGER END AS slot
  FROM {walk} w LEFT JOIN cuts c ON c.t = w.t AND c.slot = w.slot)"""
    # A leaf's slot is the least on its branch that holds one: empty sides end a level above the bottom.
    parts.append(f"""walked AS (SELECT row_id, sum(path) AS total, count(path) AS found FROM {walk} w LEFT JOIN leaves e ON e.t = w.t AND e.slot = w.slot GROUP BY row_id)""")
    scale = PATH.format(level=0).replace("round(", "(", 1).replace(" * 16777216)::BIGINT", ")")
    parts.append(f"""scores AS MATERIALIZED (SELECT feat.row_id, fs, pow(2::DOUBLE, -total::DOUBLE / 16777216.0::DOUBLE / (SELECT sum({scale}) FROM (SELECT count(*) AS n FROM l0 GROUP BY t))) AS score
  FROM feat JOIN walked USING (row_id))""")
    return parts


def forest_records_of(columns, contamination=0.05):
    names = "[" + ", ".join(f"'{c}'" for c in columns) + "]"
    return [f"cutoff AS (SELECT quantile_cont(score, {1 - contamination}) AS cut, min(score) AS low, max(score) AS high FROM scores)",
            f"""driver AS (SELECT * FROM (SELECT i, avg(x) AS mean, stddev_samp(x) AS sd, avg(x) FILTER (score > cut) AS inside, avg(x) FILTER (score <= cut) AS outside
  FROM (SELECT score, unnest(range(1, {len(columns) + 1})) AS i, unnest(fs) AS x FROM scores), cutoff GROUP BY i)
  ORDER BY abs(inside - outside) / (abs(outside) + 1e-9) DESC, i LIMIT 1)""",
            f"""forest AS (SELECT row_id, 'multivariate' AS "column", 'isolation_forest' AS method_used, s AS anomaly_score,
  CASE WHEN s >= 0.7 THEN 'high' ELSE 'moderate' END AS severity, fs[i] AS raw_value, mean - 3 * sd AS lower, mean + 3 * sd AS upper,
  printf('[%.4g, %.4g]  (primary driver: %s)', mean - 3 * sd, mean + 3 * sd, {names}[i]) AS expected_range, {names}[i] AS primary_driver_feature
  FROM (SELECT row_id, fs, (score - low) / (high - low + 1e-10) AS s FROM scores, cutoff WHERE score > cut), driver)"""]


FOREST = [*forest_of("dq", NUM), *forest_records_of(NUM)]
THREE = [*FOREST, *(p.replace("UNION ALL SELECT * FROM zscore)", "UNION ALL SELECT * FROM zscore UNION ALL SELECT * FROM forest)")
                    .replace("WHEN 'iqr' THEN 'IQR' ELSE 'Z-Score' END", "WHEN 'iqr' THEN 'IQR' WHEN 'zscore' THEN 'Z-Score' ELSE 'Isolation Forest' END") for p in RECORDS)]

# -- report lines ---------------------------------------------------------------------

QUALITY_LINES = """SELECT row_number() OVER (ORDER BY p) - 1 AS position, '- ' || line AS line FROM (
  SELECT 1 AS p, 'Health score: ' || health_score || '/100' AS line FROM health
  UNION ALL SELECT 2, CASE WHEN total_pct > 0 THEN 'Missing data: ' || printf('%.1f', total_pct)
    || '% of all cells; worst column is ''' || w."column" || ''' (' || printf('%.1f', w.missing_pct)
    || '% missing, ' || w.pattern || ' pattern)' ELSE 'No missing values detected.' END
    FROM totals, (SELECT * FROM patterns ORDER BY missing_pct DESC, position LIMIT 1) w
  UNION ALL SELECT 3, CASE WHEN exact_count > 0 THEN 'Exact duplicates: ' || format('{:,}', exact_count)
    || ' rows (' || printf('%.1f', exact_pct) || '% of dataset)' ELSE 'No exact duplicate rows found.' END FROM dupes
  UNION ALL SELECT 4, 'Type violations in ' || count(*) || ' column(s): '
    || string_agg('''' || "column" || '''', ', ') FROM violations HAVING count(*) > 0
  UNION ALL SELECT 5, 'Whitespace / casing inconsistencies in ' || count(*) || ' column(s)'
    FROM spelling WHERE padded OR casing HAVING count(*) > 0
  UNION ALL SELECT 6, 'Unexpected negative values: ' || string_agg('''' || "column" || ''' ('
    || printf('%.1f', negative_pct) || '%)', ', ' ORDER BY position)
    FROM (SELECT * FROM negatives ORDER BY position LIMIT 3) HAVING count(*) > 0)"""
TITLE = """list_aggregate(list_transform(string_split(finding_type, '_'),
  lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ')"""
QUOTED = "'''' || replace(columns, ', ', ''', ''') || ''''"
INSIGHT_LINES = f"""SELECT ordinal AS position, '- [' || upper(severity) || '] ' || {TITLE} || ' in ' || {QUOTED}
  || ' (' || statistic || '): No explanation available.' AS line FROM findings WHERE ordinal < 6"""
ANOMALY_LINES = """SELECT row_number() OVER (ORDER BY p) - 1 AS position, line FROM (
  SELECT 1 AS p, '- ' || format('{:,}', rows_flagged) || ' rows flagged (' || flagged_pct || '% of dataset)' AS line FROM panel
  UNION ALL SELECT 2, '- IQR: ' || format('{:,}', count(*)) || ' records' FROM iqr HAVING count(*) > 0
  UNION ALL SELECT 3, '- Z-Score: ' || format('{:,}', count(*)) || ' records' FROM zscore HAVING count(*) > 0
  UNION ALL SELECT 4, '- ' || multi_method_rows || ' rows flagged by 2+ methods (high confidence)'
    FROM panel WHERE multi_method_rows > 0
  UNION ALL SELECT 5, '- Highest-scoring anomaly: row ' || row_id || ', driven by ''' || primary_driver_feature
    || ''' (composite score ' || printf('%.2f', composite_score) || ')' FROM top)"""
METHOD_LINES = ANOMALY_LINES.replace("UNION ALL SELECT 4,", """UNION ALL SELECT 3.5, '- Isolation Forest: ' || format('{:,}', count(*)) || ' records' FROM forest HAVING count(*) > 0
  UNION ALL SELECT 4,""")
GLANCE = f"""SELECT 0 AS position, 'Health Score' AS metric, health_score || '/100 — ' || band AS value FROM banded
UNION ALL SELECT 1, 'Insight Count', count(*)::VARCHAR FROM findings
UNION ALL SELECT 2, 'Anomalous Rows', rows_flagged::VARCHAR FROM panel
UNION ALL SELECT 3, 'Top Insight', {TITLE} || ' in ' || {QUOTED} || ' (' || statistic || ')' FROM findings WHERE ordinal = 0
UNION ALL SELECT 4, 'Top Anomaly', 'Row ' || row_id || ' — ''' || primary_driver_feature || ''' (score '
  || printf('%.2f', composite_score) || ', ' || severity || ' severity)' FROM top"""
TYPE_LINE = """SELECT 0 AS position, string_agg(k || ' ' || col_type, ', ' ORDER BY p) AS line FROM (
  SELECT col_type, count(*) AS k, list_position(['numeric','categorical','datetime','id','text'], col_type) AS p
  FROM kinds GROUP BY col_type)"""


def memory_mb():
    texts = " + ".join(f"sum(coalesce(strlen({c}), 0))" for c in STR)
    return f"round(({texts} + 8 * {len(NUMBERS)} * count(*)) / 1048576.0, 3)"


REPORT = f"""SELECT row_number() OVER (ORDER BY s, position) - 1 AS position, line FROM (
  SELECT 0 AS s, 0 AS position, 'Dataset: dq_orders' AS line
  UNION ALL SELECT 0, 1, 'Size: ' || format('{{:,}}', count(*)) || ' rows × 15 columns (' ||
    printf('%.1f', {memory_mb()}) || ' MB in memory)' FROM dq
  UNION ALL SELECT 0, 2, 'Column types: ' || line FROM ({TYPE_LINE})
  UNION ALL SELECT 1, -2, '' UNION ALL SELECT 1, -1, '--- DATA QUALITY ---'
  UNION ALL SELECT 1, position, line FROM ({QUALITY_LINES})
  UNION ALL SELECT 2, -2, '' UNION ALL SELECT 2, -1, '--- STATISTICAL INSIGHTS ---'
  UNION ALL SELECT 2, position, line FROM ({INSIGHT_LINES})
  UNION ALL SELECT 3, -2, '' UNION ALL SELECT 3, -1, '--- ANOMALY DETECTION ---'
  UNION ALL SELECT 3, position, line FROM ({ANOMALY_LINES}))"""

LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax"]
PART_SHAPES = shapes("part", ["p_partkey", "p_size", "p_retailprice"], ["p_name", "p_brand", "p_type"])
PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


def with_(*parts, body):
    return "WITH " + ",\n".join(parts) + "\n" + body


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    # sources, types, roles
    q["preview"] = dq(f"SELECT row_id, order_id, {rounded(*[c for c in NUM if c != 'tier'])}, tier, {', '.join(STR)} "
                      "FROM dq ORDER BY row_id LIMIT 100")
    q["read_csv"] = dq(f"SELECT order_id, {rounded(*[c for c in NUM if c != 'tier'])}, tier, {', '.join(STR)} FROM dq")
    tokens = ", ".join(f"'{x}'" for x in MISSING_TOKENS)
    q["read_csv_breaks"] = "SELECT doc_id, " + ", ".join(
        f"CASE WHEN {c} NOT IN ({tokens}) THEN {c} END AS {c}" for c in ("text", "source")) + " FROM documents"
    q["read_csv_types"] = dq('SELECT position, "column", col_type FROM kinds', DQ_SHAPES, KINDS)
    q["descriptor"] = dq("""SELECT 'dq_orders' AS name, max(rows) AS row_count, count(*) AS col_count,
      string_agg("column" || '=' || col_type, ', ' ORDER BY "column" || '=' || col_type) AS column_types FROM kinds""",
                         DQ_SHAPES, KINDS)
    q["column_types"] = dq('SELECT position, "column", col_type FROM kinds', DQ_SHAPES, KINDS)
    q["type_counts"] = dq("""SELECT t AS col_type, count(k.col_type) AS columns
      FROM unnest(['numeric','categorical','datetime','text','id']) u(t) LEFT JOIN kinds k ON k.col_type = t
      GROUP BY t""", DQ_SHAPES, KINDS)
    q["semantic_roles"] = dq('SELECT "column", role, label FROM roles', DQ_SHAPES, KINDS, ROLES)
    q["semantic_roles_documents"] = with_(
        shapes("documents", ["doc_id", "n_chars"], ["text", "lang", "source"]), KINDS, ROLES,
        body='SELECT "column", role, label FROM roles')
    q["semantic_roles_pages"] = with_(shapes("pages", ["page_id"], ["url", "html"]), KINDS, ROLES,
                                      body='SELECT "column", role, label FROM roles')
    q["role_counts"] = dq("""SELECT list_position(['id','numeric_measure','datetime','categorical_low',
      'categorical_high','free_text','optional_text'], role) - 1 AS position, role, label, count(*) AS columns
      FROM roles GROUP BY role, label""", DQ_SHAPES, KINDS, ROLES)
    # profiles
    q["profile_numeric"] = dq(PROFILE_OUT, number_profile("dq", NUM))
    q["profile_numeric_lineitem"] = with_(number_profile("lineitem", LINEITEM_NUM), body=PROFILE_OUT)
    q["profile_categorical"] = dq("""SELECT s."column", s.n AS count, s.rows - s.n AS null_count,
      s.uniq AS unique_count, r.value AS mode FROM kinds s LEFT JOIN ranked r ON r."column" = s."column" AND r.rank = 1
      WHERE s.col_type = 'categorical'""", DQ_SHAPES, KINDS, counts_of("dq", CAT), RANKED)
    q["top_values"] = dq(TOP_OUT, counts_of("dq", CAT), RANKED)
    q["top_values_lineitem"] = with_(counts_of("lineitem", ["l_returnflag", "l_linestatus"]), RANKED, body=TOP_OUT)
    q["profile_datetime"] = dq(datetime_profile("dq", "event_date"), stamps_of("dq", "event_date", True))
    q["profile_datetime_events"] = with_(stamps_of("events", "ts"), body=datetime_profile("events", "ts"))
    q["profile_datetime_lineitem"] = with_(stamps_of("lineitem", "l_shipdate"),
                                           body=datetime_profile("lineitem", "l_shipdate"))
    q["profile_text"] = dq(text_profile("dq", ["notes"]))
    q["profile_text_documents"] = text_profile("documents", ["text"])
    q["profile_text_conversations"] = text_profile("conversations", ["text"])
    q["profile_id"] = dq(id_profile("dq", ["order_id"]))
    q["profile_id_events"] = id_profile("events", ["event_id", "user_id"])
    kind_counts = ", ".join(f"(SELECT count(*) FROM kinds WHERE col_type = '{t}') AS {t}_columns"
                            for t in ["numeric", "categorical", "datetime", "text", "id"])
    q["dataset_summary"] = dq(f"""SELECT (SELECT count(*) FROM dq) AS total_rows, n_cols AS total_columns,
      missing_cells AS total_missing_cells, total_pct AS missing_pct, (SELECT {memory_mb()} FROM dq) AS memory_mb,
      {kind_counts}, exact_count AS duplicate_row_count FROM totals, dupes""",
                              DQ_SHAPES, KINDS, missing_of("dq", COLUMNS), TOTALS, DUPES)
    q["column_profile"] = dq("""SELECT 'priority' AS "column", 'categorical' AS col_type, count(priority) AS count,
      count(DISTINCT priority) AS unique_count,
      (SELECT priority FROM dq GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode FROM dq""")
    q["profile_dataset"] = dq("""SELECT position, "column", col_type, CASE WHEN "column" = 'event_date'
      THEN (SELECT count(*) FROM dq WHERE TRY_CAST(event_date AS TIMESTAMP) IS NOT NULL) ELSE n END AS count,
      rows - n AS null_count FROM kinds""", DQ_SHAPES, KINDS)
    def stats(col_type, body):
        return f"""SELECT "column", '{col_type}' AS col_type, key, round(TRY_CAST(value AS DOUBLE), 4) + 0.0 AS number,
          CASE WHEN TRY_CAST(value AS DOUBLE) IS NULL THEN value END AS text FROM (UNPIVOT (SELECT "column",
            COLUMNS(* EXCLUDE ("column"))::VARCHAR FROM ({body})) ON COLUMNS(* EXCLUDE ("column")) INTO NAME key VALUE value)"""
    words = """SELECT s."column", s.n AS count, s.rows - s.n AS null_count, s.uniq AS unique_count, r.value AS mode
      FROM kinds s LEFT JOIN ranked r ON r."column" = s."column" AND r.rank = 1 WHERE s.col_type = 'categorical'"""
    pieces = [number_profile("dq", NUM), DQ_SHAPES, KINDS, counts_of("dq", CAT), RANKED, stamps_of("dq", "event_date", True)]
    every_stat = [stats("numeric", PROFILE_OUT), stats("categorical", words), stats("datetime", datetime_profile("dq", "event_date")),
                  stats("text", text_profile("dq", ["notes"])), stats("id", id_profile("dq", ["order_id"]))]
    q["profile_dataset_all"] = dq("\nUNION ALL\n".join(every_stat), *pieces)
    q["column_profile_all"] = dq(f"SELECT * FROM ({every_stat[0]}) WHERE \"column\" = 'skewed'", *pieces)
    # quality
    q["missing"] = dq('SELECT "column", missing_count, missing_pct FROM missing', missing_of("dq", COLUMNS))
    q["missing_embeddings"] = with_(missing_of("embeddings", ["vec_id", "embedding", "label"]),
                                    body='SELECT "column", missing_count, missing_pct FROM missing')
    q["missing_pattern"] = dq('SELECT "column", missing_count, missing_pct, longest_run, pattern FROM patterns',
                              missing_of("dq", COLUMNS), RUNS, PATTERNS)
    q["duplicates"] = dq("""SELECT exact_count, exact_pct, 'order_id' AS id_column,
      (SELECT count(*) FROM near) AS near_groups FROM dupes""", DUPES, NEAR)
    q["duplicates_lineitem"] = """SELECT (sum(n) - count(*))::BIGINT AS exact_count,
      round((sum(n) - count(*)) * 100.0 / sum(n), 2) + 0.0 AS exact_pct, NULL::VARCHAR AS id_column, 0 AS near_groups
      FROM (SELECT count(*) AS n FROM lineitem GROUP BY ALL)""".replace(
          "SELECT count(*) AS n FROM lineitem GROUP BY ALL",
          "SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, "
          "l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate")
    q["near_duplicates"] = dq("SELECT 'order_id' AS id_column, group_row_id, n FROM near", NEAR)
    rest = ", ".join(COLUMNS[1:])
    q["near_duplicate_rows"] = dq(f"""SELECT group_row_id, n, row_id FROM (SELECT row_id,
      min(row_id) OVER w AS group_row_id, count(*) OVER w AS n FROM dq WINDOW w AS (PARTITION BY {rest})) WHERE n >= 2""")
    q["type_violations"] = dq("SELECT * FROM violations", VIOLATIONS)
    q["cardinality"] = dq('SELECT "column", kind, unique_count, unique_pct FROM cardinality', DQ_SHAPES, KINDS, CARDINALITY)
    q["cardinality_labels"] = with_(shapes("labels", ["doc_id", "quality", "toxic"]), KINDS, CARDINALITY,
                                    body='SELECT "column", kind, unique_count, unique_pct FROM cardinality')
    q["whitespace"] = dq("""SELECT "column", padded AS has_leading_trailing, casing AS has_casing_variants
      FROM spelling WHERE padded OR casing""", SPELLING)
    q["whitespace_strict"] = dq("""SELECT "column", padded AS has_leading_trailing, strict AS has_casing_variants
      FROM spelling WHERE padded OR strict""", SPELLING)
    q["negatives"] = dq('SELECT "column", negative_count, negative_pct FROM negatives', negatives_of("dq", NUMBERS))
    q["negatives_customer"] = with_("c AS (SELECT c_acctbal AS amount FROM customer)", negatives_of("c", ["amount"]),
                                    body='SELECT "column", negative_count, negative_pct FROM negatives')
    q["health"] = dq("SELECT * FROM banded", *QUALITY)
    q["issues"] = dq("SELECT * FROM issues", *QUALITY, ISSUES)
    q["issues_actionable"] = dq("""SELECT ordinal, "column", issue_type, CASE action WHEN 'downgrade' THEN 'Low'
      ELSE severity END AS severity, detail FROM judged WHERE action <> 'suppress'""", *QUALITY, ISSUES, ROLES, JUDGED)
    q["issues_suppressed"] = dq("""SELECT ordinal, "column", issue_type, severity, detail FROM judged
      WHERE action = 'suppress'""", *QUALITY, ISSUES, ROLES, JUDGED)
    # insights
    for name, part in zip(["skew", "correlations", "outlier_prevalence", "dominance", "date_gaps", "contradictions"],
                          FINDING_PARTS):
        q[name] = dq(finding_out(part), *FINDING_CTES)
    q["skew_documents"] = with_(*skews("documents", ["n_chars"]), body=finding_out("skews"))
    q["skew_labels"] = with_(*skews("labels", ["quality", "toxic"]), body=finding_out("skews"))
    q["date_gaps_events"] = with_(gaps_of("events", "ts"),
                                  body=f'SELECT "column", n, {rounded("mean_gap", "std_gap")} FROM gapstats')
    q["findings"] = dq("SELECT * FROM findings", *FINDING_CTES, FINDINGS)
    q["findings_explained"] = dq("""SELECT ordinal, finding_type, 'No explanation available.' AS explanation,
      'Review this finding manually.' AS recommended_action FROM findings""", *FINDING_CTES, FINDINGS)
    q["findings_explained_given"] = dq("""SELECT ordinal, finding_type,
      CASE ordinal WHEN 0 THEN 'first' WHEN 3 THEN 'third' ELSE 'No explanation available.' END AS explanation,
      CASE ordinal WHEN 0 THEN 'act' ELSE 'Review this finding manually.' END AS recommended_action FROM findings""", *FINDING_CTES, FINDINGS)
    q["severity_counts"] = dq("""SELECT severity, count(*) AS findings,
      list_position(['high','medium','low'], severity) AS rank FROM findings GROUP BY severity""", *FINDING_CTES, FINDINGS)
    q["finding_totals"] = dq("""SELECT (SELECT count(*) FROM findings) AS insights, count(DISTINCT c) AS affected_columns
      FROM (SELECT unnest(string_split(columns, ', ')) AS c FROM findings)""", *FINDING_CTES, FINDINGS)
    matrix = """SELECT a AS column_a, b AS column_b, round(r, 2) + 0.0 AS r FROM corrs
      UNION ALL SELECT b, a, round(r, 2) + 0.0 FROM corrs UNION ALL SELECT c, c, 1.0 FROM unnest(%r) u(c)"""
    q["corr_matrix"] = dq(matrix % NUMBERS, pairs_sql())
    q["corr_matrix_lineitem"] = with_(pairs_sql("lineitem", LINEITEM_NUM), body=matrix % LINEITEM_NUM)
    flagged = """flagged AS (SELECT c AS "column", row_number() OVER (ORDER BY min(ordinal * 10 + k)) - 1 AS position
      FROM (SELECT ordinal, unnest(string_split(columns, ', ')) AS c, generate_subscripts(string_split(columns, ', '), 1) AS k
        FROM findings WHERE finding_type IN ('distribution_skew', 'outlier_prevalence', 'high_correlation')) GROUP BY c)"""
    every = number_profile("dq", NUMBERS).replace("numbers AS", "every AS", 1)
    q["flagged_hist"] = dq(f"""SELECT f.position, h."column", h.bin, {rounded('low', 'high')}, h.count,
      round(n.skewness, 2) + 0.0 AS skew FROM flagged f JOIN hist h ON h."column" = f."column"
      JOIN every n ON n."column" = h."column" """,
                           *FINDING_CTES, FINDINGS, flagged, histogram("dq", NUMBERS, 40), every)
    # anomalies
    q["iqr"] = dq(RECORD_OUT.format("iqr"), iqr_of("dq", NUM))
    q["iqr_events"] = with_(iqr_of("events", ["value"], "event_id"), body=RECORD_OUT.format("iqr"))
    q["normality"] = dq(NORMALITY_OUT, normality_of("dq", NUM))
    q["normality_supplier"] = with_(normality_of("supplier", ["s_suppkey", "s_nationkey", "s_acctbal"]),
                                    body=NORMALITY_OUT)
    q["zscore"] = dq(RECORD_OUT.format("zscore"), normality_of("dq", NUM), zscore_of("dq", NUM, 3))
    q["zscore_two"] = dq(RECORD_OUT.format("zscore"), normality_of("dq", NUM), zscore_of("dq", NUM, 2))
    q["composite"] = dq("SELECT row_id, round(composite_score, 4) + 0.0 AS composite_score, methods FROM composite", *RECORDS)
    q["method_summary"] = dq("SELECT method_used, count(*) AS records FROM records GROUP BY 1", *RECORDS)
    q["anomaly_panel"] = dq("SELECT * FROM panel", *RECORDS)
    out = f"""SELECT row_id, "column", method, severity, score, {rounded('raw_value')}, expected_range FROM shown"""
    q["anomaly_table"] = dq(out + ' ORDER BY score DESC, row_id, "column", method LIMIT 500', *RECORDS)
    q["anomaly_table_filtered"] = dq(out + " WHERE method = 'IQR' AND severity IN ('moderate', 'low')", *RECORDS)
    q["anomaly_columns"] = dq("""SELECT "column", count(*) AS records,
      string_agg(DISTINCT method, ', ' ORDER BY method) AS methods FROM shown GROUP BY 1""", *RECORDS)
    q["labelled_rows"] = dq(f"""SELECT row_id, {rounded('amount', 'gauss')},
      CASE WHEN composite_score IS NULL THEN 'Normal' ELSE 'Anomaly' END AS label,
      coalesce(round(composite_score, 3), 0.0) AS score FROM dq LEFT JOIN composite USING (row_id)""", *RECORDS)
    q["driver_features"] = dq(f"""SELECT row_number() OVER (ORDER BY place) - 1 AS ordinal, primary_driver_feature
      FROM (SELECT primary_driver_feature, min((CASE method_used WHEN 'iqr' THEN 0 ELSE 1000 END)
        + list_position({COLUMNS!r}, primary_driver_feature)) AS place FROM records GROUP BY 1)""", *RECORDS)
    q["top_anomaly"] = dq('SELECT row_id, round(composite_score, 4) AS composite_score, severity, primary_driver_feature, '
                          '"column", method_used FROM top', *RECORDS)
    q["forest_scores"] = dq("SELECT row_id, round(score, 4) + 0.0 AS score FROM scores", *forest_of("dq", NUM))
    q["forest_records"] = dq(RECORD_OUT.format("forest"), *FOREST)
    q["forest_scores_lineitem"] = with_("li AS (SELECT row_number() OVER () - 1 AS row_id, * FROM lineitem)", *forest_of("li", LINEITEM_NUM),
                                        body="SELECT row_id, round(score, 4) + 0.0 AS score FROM scores")
    q["anomalies_all"] = dq(RECORD_OUT.format("records"), *THREE)
    q["composite_all"] = dq("SELECT row_id, round(composite_score, 4) + 0.0 AS composite_score, methods FROM composite", *THREE)
    q["anomaly_panel_all"] = dq("SELECT * FROM panel", *THREE)
    q["anomaly_table_all"] = dq(out + ' ORDER BY score DESC, row_id, "column", method LIMIT 500', *THREE)
    q["labelled_rows_all"] = q["labelled_rows"].replace(",\n".join(RECORDS), ",\n".join(THREE))
    # plain profile
    q["basic_profile"] = dq("""SELECT m."column", missing_count AS missing_values, (SELECT count(*) FROM dq) AS rows,
      n_cols AS columns, exact_count AS duplicate_rows FROM missing m, totals, dupes""",
                            missing_of("dq", COLUMNS), TOTALS, DUPES)
    q["basic_profile_types"] = dq("""SELECT column_name AS "column", CASE column_type WHEN 'VARCHAR' THEN 'string' ELSE lower(CASE column_type
      WHEN 'INTEGER' THEN 'int' ELSE column_type END) END AS dtype FROM (DESCRIBE SELECT * EXCLUDE (row_id) FROM dq)""")
    q["warnings"] = dq("""SELECT row_number() OVER (ORDER BY g, position) - 1 AS ordinal, warning FROM (
      SELECT 0 AS g, 0 AS position, 'Dataset contains ' || exact_count || ' duplicate row(s).' AS warning
        FROM dupes WHERE exact_count > 0
      UNION ALL SELECT 1, position, CASE WHEN (rows - n) * 100.0 / rows > 30
        THEN 'Column ''' || "column" || ''' is missing ' || (rows - n) || ' value(s) (' || printf('%.1f', (rows - n) * 100.0 / rows)
          || '% of rows) — consider dropping or imputing.'
        ELSE 'Column ''' || "column" || ''' has ' || (rows - n) || ' missing value(s) ('
          || printf('%.1f', (rows - n) * 100.0 / rows) || '% of rows).' END FROM kinds WHERE rows > n
      UNION ALL SELECT 2, position, 'Column ''' || "column" || ''' has only one unique value — it may not be useful.'
        FROM kinds WHERE uniq = 1)""", DQ_SHAPES, KINDS, DUPES)
    q["outlier_counts"] = dq(each(NUMBERS, lambda c, i: f"""SELECT '{c}' AS "column", count(*) AS outliers FROM dq,
      (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, count({c}) AS n FROM dq)
      WHERE n >= 4 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) HAVING count(*) > 0"""))
    q["missing_chart"] = dq('SELECT "column", missing_count FROM missing WHERE missing_count > 0', missing_of("dq", COLUMNS))

    def hist20(table, columns):
        marks = each(columns, lambda c, i: f"SELECT '{c}' AS \"column\", bool_and({c} = floor({c})) AS whole_numbers FROM {table}")
        return (histogram(table, columns, 20), f"marks AS ({marks})"), (
            f"""SELECT position, "column", bin, {rounded('low', 'high')}, count, whole_numbers
            FROM hist JOIN marks USING ("column")""")
    parts, body = hist20("part", ["p_partkey", "p_size", "p_retailprice"])
    q["hist20"] = with_(*parts, body=body)
    parts, body = hist20("dq", ["amount", "amount_tax", "price_low"])
    q["hist20_dq"] = dq(body, *parts)
    bars = 'SELECT "column", rank, value, n AS count FROM ranked WHERE rank <= 10'
    q["value_counts10"] = dq(bars, counts_of("dq", ["status", "priority"]), RANKED)
    q["value_counts10_part"] = with_(counts_of("part", ["p_brand", "p_type"]), RANKED, """few AS (
      SELECT "column" FROM ranked GROUP BY 1 HAVING count(*) <= 20)""",
                                     body=bars + ' AND "column" IN (SELECT "column" FROM few)')
    q["date_like"] = dq(each(STR, lambda c, i: f"""SELECT '{c}' AS "column",
      count(*) FILTER ({c} IS NOT NULL AND TRY_CAST({c} AS TIMESTAMP) IS NULL) = 0 AS date_like FROM dq"""))
    # dates that are not ISO
    q["profile_datetime_us"] = with_(US_DATES, us_stamps(), body=datetime_profile("us", "ship_date"))
    q["type_violations_us"] = with_(US_DATES, body="""SELECT 'ship_date' AS "column", count(*) AS violation_count, (SELECT string_agg(v, ', ' ORDER BY r)
      FROM (SELECT ship_date AS v, min(row_id) AS r FROM us WHERE ship_date IS NOT NULL AND try_strptime(ship_date, '%m/%d/%Y') IS NULL
      GROUP BY 1 ORDER BY 2 LIMIT 5)) AS samples FROM us WHERE ship_date IS NOT NULL AND try_strptime(ship_date, '%m/%d/%Y') IS NULL""")
    q["date_gaps_us"] = with_(US_DATES, us_stamps(), GAPS_OF_STAMPS.format(column="ship_date"), body="""SELECT "column", n,
      round(mean_gap, 4) AS mean_gap, round(std_gap, 4) AS std_gap FROM gapstats""")
    q["date_like_us"] = with_(US_DATES, body=each(["order_id", "ship_date", "paid_date"][1:], lambda c, i: f"""SELECT '{c}' AS "column",
      count(*) FILTER ({c} IS NOT NULL AND try_strptime({c}, '%m/%d/%Y') IS NULL) = 0 AS date_like FROM us"""))
    # questions
    q["ask_preview"] = """SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS ordinal, l_orderkey, l_linenumber,
      '... (' || (SELECT format('{:,}', count(*)) FROM lineitem WHERE l_quantity > 10) || ' total rows)' AS note
      FROM lineitem WHERE l_quantity > 10 ORDER BY 1 LIMIT 50"""
    spelled = lambda c: (f"{c}::VARCHAR" if c in ("p_partkey", "p_size", "p_retailprice")
                         else f"chr(39) || {c} || chr(39)")  # no quotes or escapes in these
    samples = each(PART_COLUMNS, lambda c, i: f"""SELECT {i} AS position, '{c}' AS "column",
      (SELECT string_agg({spelled(c)}, ', ' ORDER BY p_partkey) FROM (SELECT * FROM part WHERE {c} IS NOT NULL
        ORDER BY p_partkey LIMIT 5)) AS samples, {', '.join(f'{fn}({c})::DOUBLE AS {fn}' for fn in ('min', 'max', 'avg'))
        if c in ('p_partkey', 'p_size', 'p_retailprice') else 'NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS avg'}
      FROM {'part' if c in ('p_partkey', 'p_size', 'p_retailprice') else '(SELECT 1)'}""")
    q["schema_context"] = with_(PART_SHAPES, KINDS, ROLES, f"sampled AS ({samples})", body="""SELECT s.position,
      s."column", role, label, samples, round(min, 4) AS min, round(max, 4) AS max, round(avg, 4) AS mean
      FROM sampled s JOIN roles r ON r."column" = s."column" """)
    q["ask_aggregate"] = """SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) + 0.0 AS value
      FROM lineitem GROUP BY 1, 2"""
    q["ask_rank"] = """SELECT l_suppkey, round(sum(l_quantity), 4) + 0.0 AS value FROM lineitem GROUP BY 1
      ORDER BY value DESC, l_suppkey LIMIT 10"""
    q["ask_distribution"] = """SELECT l_returnflag AS value, count(*) AS count,
      round(count(*) * 100.0 / (SELECT count(l_returnflag) FROM lineitem), 2) + 0.0 AS pct
      FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1"""
    q["ask_distribution_numeric"] = with_(histogram("lineitem", ["l_extendedprice"], 20), body=f"""SELECT position,
      "column", bin, {rounded('low', 'high')}, count FROM hist""")
    q["ask_sql"] = """SELECT l_linestatus, round(sum(l_quantity), 4) AS quantity, count(*) AS n FROM lineitem GROUP BY 1"""
    # reports
    q["quality_bullets"] = dq(QUALITY_LINES, *QUALITY)
    q["insight_bullets"] = dq(INSIGHT_LINES, *FINDING_CTES, FINDINGS)
    q["finding_bullets"] = dq("""SELECT 0 AS position, (SELECT count(*) FROM findings) || ' insights found across '
        || count(DISTINCT c) || ' columns' AS line FROM (SELECT unnest(string_split(columns, ', ')) AS c FROM findings)
      UNION ALL SELECT ordinal + 1, '- [' || upper(severity) || '] ' || finding_type || ' on ' || columns || ': '
        || statistic FROM findings""", *FINDING_CTES, FINDINGS)
    q["anomaly_bullets"] = dq(ANOMALY_LINES, *RECORDS)
    q["types_line"] = dq(TYPE_LINE, DQ_SHAPES, KINDS)
    q["at_a_glance"] = dq(GLANCE, *QUALITY, *FINDING_CTES, FINDINGS, *RECORDS)
    q["anomaly_bullets_all"] = dq(METHOD_LINES, *THREE)
    q["at_a_glance_all"] = dq(GLANCE, *QUALITY, *FINDING_CTES, FINDINGS, *THREE)
    q["report_text_all"] = dq(REPORT.replace(ANOMALY_LINES, METHOD_LINES), *QUALITY, *FINDING_CTES, FINDINGS, *THREE)
    q["report_text"] = dq(REPORT, *QUALITY, *FINDING_CTES, FINDINGS, *RECORDS)
    return q
