"""Quality rules: base counts of a text and cross-document line frequency.

Lines are normalised (A-Z lowered, digits to 0, white space squeezed), hashed, and counted by
distinct text within a host, so copies of one document do not make its lines frequent. Lines
found in more documents than the host's limit are boilerplate; a document that loses most of its
words with them is rejected.

Documents are counted by distinct text for the limit, which is a share of the host's distinct texts,
so lines weigh the same at any size; only in hosts of fewer than MIN_LINE_DOCS / MAX_LINE_SHARE texts
does the floor decide. The plain number of documents is returned beside it. Texts of any length are read whole; there are no ties.

Null or empty text: no words, base_failed. A null host is a host of its own. Repeated ids or rows
stay separate rows; repeated texts count once per host. Empty tables give empty results. Extra
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .tables import stage, texts

MIN_LINE_DOCS = 3        # keeps the lines of tiny hosts: a line in so many distinct texts or fewer stays
MAX_LINE_SHARE = 0.02    # of the host's distinct texts
HOT_BROADCAST = 100_000  # frequent lines that may be broadcast: about 4 MB
SALTS = 64
MIN_WORDS = 10
MAX_REPEAT_PCT = 20
MAX_REMOVED_SHARE = 0.8  # of the words; above it the document is depleted

_NORMAL = {**{c: c + 32 for c in range(65, 91)}, **{c: 48 for c in range(49, 58)}, **{c: 32 for c in (9, 11, 12, 13)}}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = " \t\n\v\f\r"

_FACTS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "text_hash long, lines array<struct<hash:long,words:long>>")
_LINES = pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int64())]))


def normal_lines(text: str) -> list[str]:
    return [" ".join(filter(None, line.split(" "))) for line in text.translate(_NORMAL).split("\n")]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def line_hash(line: str) -> int:
    return _signed(xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")))


def _sums(mask, offsets):
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(words: blocks.Words, n: int) -> np.ndarray:
    """Per text: words inside n-word windows that the text has at least twice."""
    text, h, at = words.grams(n, whole_if_short=False)
    order = np.lexsort((h, text))
    t, g = text[order], h[order]
    same = (t[1:] == t[:-1]) & (g[1:] == g[:-1])
    twice = np.zeros(len(t), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(edge, at[order][twice], 1)
    np.add.at(edge, at[order][twice] + n, -1)
    return _sums(np.cumsum(edge[:-1]) > 0, words.first)


def _facts(batches):
    for block in blocks.text_blocks(batches):
        column = block.column(block.schema.get_field_index("text"))
        words = blocks.Words(column)
        data, offsets = words.data, words.offsets
        char = blocks.SPACED[data] & ((data & 0xC0) != 0x80)
        dup, lines, whole = [], [], []
        for text in column.to_pylist():
            text = text or ""
            seen, n = set(), 0
            for line in text.split("\n"):
                if line.strip(_BLANK):
                    n += line in seen
                    seen.add(line)
            dup.append(n)
            whole.append(line_hash(text))
            lines.append([{"hash": line_hash(x), "words": x.count(" ") + 1} for x in normal_lines(text) if x])
        yield pa.RecordBatch.from_arrays([
            block.column(block.schema.get_field_index("doc_id")),
            block.column(block.schema.get_field_index("source")),
            pa.array(words.counts), pa.array(_sums(char, offsets)), pa.array(_sums(_SYMBOL[data], offsets)),
            pa.array(dup, pa.int64()), pa.array(repeated_words(words, 5)), pa.array(whole, pa.int64()),
            pa.array(lines, _LINES)],
            ["doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
             "text_hash", "lines"])


def document_facts(docs: DataFrame, host: str = "source") -> DataFrame:
    """Base counts and hashed lines of each document; one row per input row, no text."""
    rows = texts(docs, F.col(host).cast("string").alias("source"))
    return rows.mapInArrow(_facts, f"doc_id long, source string, {_FACTS}")


def frequent_lines(facts: DataFrame, min_docs: int = MIN_LINE_DOCS,
                   max_share: float = MAX_LINE_SHARE) -> DataFrame:
    """(source, hash, n_docs, n_texts): lines in more distinct texts of the host than its limit, with
    the documents that have them, copies included."""
    seen = facts.select("source", "text_hash").distinct().groupBy("source").agg(F.count("*").alias("texts"))
    lines = (facts.select("source", "text_hash", F.explode(F.array_distinct("lines.hash")).alias("hash"))
             .groupBy("source", "hash", "text_hash").agg(F.count("*").alias("copies"))
             .groupBy("source", "hash").agg(F.sum("copies").alias("n_docs"), F.count("*").alias("n_texts")).where(F.col("n_texts") > min_docs))
    return (lines.withColumnRenamed("source", "host").join(seen, F.col("host").eqNullSafe(F.col("source")))
            .where(F.col("n_texts") > F.col("texts") * max_share).select(F.col("host").alias("source"), "hash", "n_docs", "n_texts"))


def _with_frequent(lines: DataFrame, frequent: DataFrame, how: str, row: str = "row") -> DataFrame:
    """Join of lines (h_source, h_null, hash) with frequent ones. A host has at most its mean number of
    lines / ``max_share`` of these, so they are broadcast if their counted number allows; else both
    sides are dealt over SALTS parts, since one line may be in any share of the documents."""
    hot = stage(frequent.select(F.coalesce("source", F.lit("")).alias("h_source"), F.col("source").isNull().alias("h_null"), "hash"), "quality-lines")
    keys = ["h_source", "h_null", "hash"]
    if hot.count() <= HOT_BROADCAST:
        return lines.join(F.broadcast(hot), keys, how)
    salt = F.pmod(F.xxhash64(row), F.lit(SALTS)).alias("salt")
    every = hot.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return lines.select("*", salt).join(every, [*keys, "salt"], how).drop("salt")


def judge(docs: DataFrame, host: str = "source", min_docs: int = MIN_LINE_DOCS, max_share: float = MAX_LINE_SHARE,
          min_words: int = MIN_WORDS, max_removed: float = MAX_REMOVED_SHARE) -> DataFrame:
    """Base counts, removed lines and words, and the verdict of every document."""
    facts = stage(document_facts(docs, host).withColumn("row", F.monotonically_increasing_id()), "quality-facts")
    lines = facts.select("row", F.coalesce("source", F.lit("")).alias("h_source"),
                         F.col("source").isNull().alias("h_null"), F.explode("lines").alias("line"))
    lines = lines.select("row", "h_source", "h_null", F.col("line.hash").alias("hash"), F.col("line.words").alias("words"))
    removed = (_with_frequent(lines, frequent_lines(facts, min_docs, max_share), "inner")
               .groupBy("row").agg(F.count("*").alias("n_removed_lines"), F.sum("words").alias("n_removed_words")))
    judged = facts.drop("lines", "text_hash").join(removed, "row", "left").fillna(0, ["n_removed_lines", "n_removed_words"])
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (left < min_words) | (F.col("n_removed_words") > max_removed * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted).drop("row")


def remove_lines(docs: DataFrame, frequent: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, source, text) without the frequent lines of the host; blank lines stay.

    A line of any frequency is joined where it lies, or split by its row key.
    """
    rows = stage(texts(docs, F.col(host).cast("string").alias("source"))
                 .withColumn("row", F.monotonically_increasing_id()), "quality-rows")

    def split(batches):
        for block in blocks.text_blocks(batches):
            cols = block.to_pydict()
            out = [(r, i, x, line_hash(n) if n else None, s is None, s or "") for r, t, s in zip(cols["row"], cols["text"], cols["source"])
                   for i, (x, n) in enumerate(zip((t or "").split("\n"), normal_lines(t or "")))]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                             ["row", "at", "line", "hash", "h_null", "h_source"])

    lines = rows.select("row", "text", "source").mapInArrow(split, "row long, at long, line string, hash long, h_null boolean, h_source string")
    kept = (_with_frequent(lines, frequent, "left_anti").groupBy("row")
            .agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("kept")))
    return rows.join(kept, "row", "left").select(
        "doc_id", "source", F.when(F.col("text").isNotNull(), F.coalesce(F.array_join("kept.line", "\n"), F.lit(""))).alias("text"))


def query(spark, sf_dir):
    from .tables import load
    found = judge(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "kept", "n_removed_lines", "n_removed_words")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^ \x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM d),
gram AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g
         FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT r, i FROM gram QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, range(0, 5) t(j) GROUP BY r),
line AS (SELECT r, source, text, unnest(ls) AS raw FROM w),
dup AS (SELECT r, count(*) - count(DISTINCT raw) AS n FROM line
        WHERE regexp_matches(raw, '[^ \x09-\x0D]') GROUP BY r),
norm AS (SELECT r, source, text, trim(regexp_replace(regexp_replace(translate(raw,
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[1-9]', '0', 'g'), '[ \x09-\x0D]+', ' ', 'g'), ' ') AS x
         FROM line),
hosts AS (SELECT source, count(DISTINCT text) AS docs FROM d GROUP BY source),
hot AS (SELECT n.source, x FROM norm n JOIN hosts h ON n.source IS NOT DISTINCT FROM h.source WHERE x <> ''
        GROUP BY n.source, x, docs HAVING count(DISTINCT text) > 3 AND count(DISTINCT text) > docs * 0.02),
gone AS (SELECT r, count(*) AS lines, sum(len(string_split(n.x, ' '))) AS words
         FROM norm n JOIN hot h ON n.source IS NOT DISTINCT FROM h.source AND n.x = h.x GROUP BY r),
f AS (SELECT w.doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
        coalesce(gone.lines, 0) AS n_removed_lines, CAST(coalesce(gone.words, 0) AS BIGINT) AS n_removed_words
      FROM w LEFT JOIN dup USING (r) LEFT JOIN covered USING (r) LEFT JOIN gone USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND n_words - n_removed_words >= 10 AND n_removed_words <= 0.8 * n_words AS kept FROM b
"""
