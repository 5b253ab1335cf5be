"""Byte-level BPE by DuckDB recursive queries inside Spark tasks.

Each Python worker keeps one DuckDB database with the vocabulary, the table of merges and the words
it has met. A block of texts is split into words by the public pattern. Words that the worker does
not know become rows of (word, position, token), which join the merge table for the rank of each
neighbouring pair; a recursive query then contracts every word's leftmost pair of least rank, joins
the merge table again for the two pairs that this makes, and ends when no word has a pair left. The
tokens of a text are an ordered aggregate over its words, and so are the decoded bytes.

No shuffle: each text is encoded where it is read, and its size alone bounds what a task holds
(blocks of about ``BLOCK`` bytes, one longer text by itself; the words a worker keeps are forgotten
beyond ``KNOWN_WORDS``, which costs time and changes no result).

Null text counts as empty and has no tokens; a null id stays null; rows are independent, so repeated
rows and ids give repeated results; very long texts and words are encoded whole, by the same rules;
ties of rank go to the leftmost pair; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import give_back, string_column, text_blocks
from .tables import load, texts

BLOCK = 4 << 20
KNOWN_WORDS = 1_200_000
FRESH_WORDS = 120_000  # encoded by one recursive query
MEMORY_MB = 400  # of a worker's DuckDB
NONE = (1 << 36) - 1
FIRST_RARE_BYTE = 0xD5  # UTF-8 of code points from 0x540: below, all Unicode versions agree on classes

MERGES = """
CREATE TABLE merges AS
SELECT a.id::BIGINT * 16777216 + b.id AS pair, s.id AS rank
FROM (SELECT id, piece, unnest(range(1, length(piece) // 2)) AS k FROM vocab) s
JOIN vocab a ON a.piece = s.piece[:2 * k] JOIN vocab b ON b.piece = s.piece[2 * k + 1:]"""

# A position of a word is one number, rank * 2**24 + token: the token, and the rank of its pair with the next.
# NONE is the rank of a pair that does not merge. Byte pairs, and bytes at a word's end, by their hex digits.
OPENERS = """
CREATE TABLE openers AS
SELECT a.piece || coalesce(b.piece, '') AS two, coalesce(m.rank, {NONE}) * 16777216 + a.id AS here
FROM vocab a CROSS JOIN (SELECT id, piece FROM vocab WHERE length(piece) = 2 UNION ALL SELECT NULL, NULL) b
LEFT JOIN merges m ON m.pair = a.id::BIGINT * 16777216 + b.id
WHERE length(a.piece) = 2"""

# One thread aggregates sorted rows in their order, here and below.
# Each word starts with a sentinel, so a pair always has a position before it. A word that is itself in the
# vocabulary is one token.
CONTRACT = """
WITH RECURSIVE words(w, ats, best) AS (
  SELECT w, [{NONE} * 16777216 + 16777215] || list(here), nullif(min(here) >> 24, {NONE})
  FROM (SELECT w, here
        FROM (SELECT w, p, piece[2 * p + 1:2 * p + 4] AS two
              FROM (SELECT w, f.piece, unnest(range(length(f.piece) // 2)) AS p
                    FROM fresh f LEFT JOIN vocab v ON v.piece = f.piece WHERE v.id IS NULL))
        JOIN openers USING (two) ORDER BY w, p)
  GROUP BY w
  UNION ALL
  SELECT w, ats, nullif(list_min(ats) >> 24, {NONE})
  FROM (SELECT w, ats[:(i - 2)] || [coalesce(l.rank, {NONE}) * 16777216 + before, coalesce(r.rank, {NONE}) * 16777216 + best]
                  || ats[(i + 2):] AS ats
        FROM (SELECT w, ats, best, i, ats[(i - 1)] & 16777215 AS before, ats[(i + 2)] & 16777215 AS after
              FROM (SELECT *, list_position(list_transform(ats, lambda x: x >> 24), best) AS i FROM words WHERE best IS NOT NULL)) x
        LEFT JOIN merges l ON l.pair = x.before * 16777216 + best
        LEFT JOIN merges r ON r.pair = best * 16777216 + x.after))
SELECT w, list_transform(ats[2:], lambda x: (x & 16777215)::INTEGER) AS toks FROM words WHERE best IS NULL
UNION ALL
SELECT w, [v.id] FROM fresh f JOIN vocab v ON v.piece = f.piece"""

# The decoded bytes of a whole word are a piece of text again.
LEARN = """
INSERT INTO known
SELECT w, toks, bytes FROM made JOIN (
  SELECT w, decode(from_hex(string_agg(piece, ''))) AS bytes
  FROM (SELECT w, piece FROM (SELECT w, unnest(toks) AS tok, generate_subscripts(toks, 1) AS p FROM made)
        JOIN vocab ON id = tok ORDER BY w, p)
  GROUP BY w) USING (w)"""

ASSEMBLE = """
SELECT d, flatten(list(toks)) AS ids, encode(string_agg(bytes, '')) AS decoded
FROM (SELECT d, toks, bytes FROM placed JOIN known USING (w) ORDER BY d, k) GROUP BY d"""

DECODE = """
SELECT d, from_hex(string_agg(v.piece, '' ORDER BY p)) AS decoded
FROM (SELECT d, unnest(ids) AS tok, generate_subscripts(ids, 1) AS p FROM given) JOIN vocab v ON v.id = tok GROUP BY d"""


def ranks_file(path: str | None = None) -> bytes:
    """Contents of a rank file, read by the driver and sent along with the tasks (under 1 MB)."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


def pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


class Splitter:
    """Words of the pattern as the tiktoken library finds them.

    Python's regex module may know a later Unicode version than that library. Code points on whose
    class they differ are replaced by others of the right class before matching, one for one.
    """

    def __init__(self, pat: str):
        import regex
        self.regex, self.find, self._stand_in = regex, regex.compile(pat).findall, None

    def stand_in(self) -> dict:
        if self._stand_in is None:
            import tiktoken
            every = "".join(map(chr, [*range(FIRST_RARE_BYTE, 0xD800), *range(0xE000, 0x110000)]))
            found = {}
            for kind, sign in ((r"\p{L}", "ª"), (r"\p{N}", "²")):
                library = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
                theirs = set(library.decode(library.encode_ordinary(every)))
                ours = set(self.regex.findall(kind, every))
                found |= {ord(c): "§" for c in ours - theirs if ord(c) not in found} | {ord(c): sign for c in theirs - ours}
            self._stand_in = found
        return self._stand_in

    def words(self, text: str, rare: bool) -> list[str]:
        if not rare:
            return self.find(text)
        made, at = [], 0
        for w in self.find(text.translate(self.stand_in())):
            made.append(text[at:at + len(w)])
            at += len(w)
        return made


class Worker:
    """DuckDB database of one Python worker."""

    def __init__(self, ranks: bytes, pat: str):
        import duckdb
        pairs = [line.split() for line in ranks.splitlines() if line]
        self.con = duckdb.connect(config={"threads": 1})
        self.con.execute(f"SET memory_limit = '{MEMORY_MB}MB'")
        self.split = Splitter(pat)
        self.put("given", pa.table({"id": pa.array([int(r) for _, r in pairs], pa.int32()),
                                    "piece": [base64.b64decode(t).hex() for t, _ in pairs]}), "vocab")
        self.con.execute(MERGES)
        self.con.execute(OPENERS.format(NONE=NONE))
        self.forget()

    def put(self, name: str, table: pa.Table, stored: str | None = None):
        self.con.register(name, table)
        if stored:
            self.con.execute(f"CREATE TABLE {stored} AS SELECT * FROM {name}")
            self.con.unregister(name)

    def rows(self, sql: str) -> pa.Table:
        return self.con.sql(sql).to_arrow_table()

    def forget(self):
        self.index = defaultdict(count().__next__)
        self.con.execute("CREATE OR REPLACE TABLE known (w BIGINT, toks INTEGER[], bytes VARCHAR)")

    def learn(self, words: list[str], first: int):
        for start in range(0, len(words), FRESH_WORDS):
            part = words[start:start + FRESH_WORDS]
            self.put("fresh", pa.table({"w": pa.array(range(first + start, first + start + len(part)), pa.int64()),
                                        "piece": [w.encode().hex() for w in part]}))
            self.put("made", self.rows(CONTRACT.format(NONE=NONE)))
            self.con.execute(LEARN)
            self.con.unregister("made")
            self.con.unregister("fresh")

    def encode(self, column) -> tuple[list, list]:
        """Token ids and decoded bytes of each text of an Arrow string column."""
        data, offsets = string_column(column)
        if len(self.index) > KNOWN_WORDS:
            self.forget()
        before, placed, counts = len(self.index), [], []
        for a, b in zip(offsets[:-1], offsets[1:]):
            one = data[a:b]
            words = self.split.words(one.tobytes().decode(), bool(len(one)) and int(one.max()) >= FIRST_RARE_BYTE)
            placed.append(np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)))
            counts.append(len(words))
        if len(self.index) > before:
            self.learn(list(self.index)[before:], before)
        self.put("placed", pa.table({"d": np.repeat(np.arange(len(counts)), counts), "k": np.arange(sum(counts)),
                                     "w": np.concatenate(placed) if placed else np.zeros(0, np.int64)}))
        found = self.rows(ASSEMBLE)
        self.con.unregister("placed")
        return spread(found, len(counts), pa.list_(pa.int32())), spread(found, len(counts), pa.binary(), "decoded")

    def decode(self, ids) -> pa.Array:
        """Bytes of each list of ids; unknown ids raise."""
        given = pa.table({"d": np.arange(len(ids)), "ids": ids.cast(pa.list_(pa.int32()))})
        self.put("given", given)
        total, known = self.con.execute("SELECT count(*), count(v.id) FROM (SELECT unnest(ids) AS tok FROM given) LEFT JOIN vocab v ON v.id = tok").fetchall()[0]
        if total != known:
            raise ValueError(f"{total - known} ids are not in the vocabulary")
        found = self.rows(DECODE)
        self.con.unregister("given")
        return spread(found, len(ids), pa.binary(), "decoded")


def spread(found: pa.Table, n: int, kind: pa.DataType, name: str = "ids") -> pa.Array:
    """A value of ``found`` for each of n texts; those it lacks get an empty one."""
    at = np.full(n, found.num_rows)
    at[found.column("d").to_numpy()] = np.arange(found.num_rows)
    empty = pa.array([[] if pa.types.is_list(kind) else b""], kind)
    chunks = [c.cast(kind) for c in found.column(name).chunks]
    return pa.concat_arrays([*chunks, empty]).take(pa.array(at))


_worker: tuple | None = None


def worker(ranks: bytes, pat: str) -> Worker:
    """The worker's database, kept for its later tasks."""
    global _worker
    if _worker is None or _worker[0] != (ranks, pat):
        _worker = (ranks, pat), Worker(ranks, pat)
    return _worker[1]


def encode(docs: DataFrame, ranks: bytes, pat: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row: ids of its text, and the bytes these give again."""
    pat = pat or pattern()

    def run(batches):
        for block in text_blocks(batches, size=BLOCK):
            ids, decoded = worker(ranks, pat).encode(block.column(1))
            yield pa.RecordBatch.from_arrays([block.column(0), ids, decoded], ["doc_id", "ids", "decoded"])

    made = texts(docs, id_col=id_col, text_col=text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


def decode(encoded: DataFrame, ranks: bytes, id_col: str = "doc_id", ids_col: str = "ids", pat: str | None = None) -> DataFrame:
    """(doc_id, decoded) of rows with token ids; null ids count as none, an id outside the vocabulary raises."""
    pat = pat or pattern()

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), worker(ranks, pat).decode(part.column(1))], ["doc_id", "decoded"])
        give_back()

    ids = F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>"))
    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), ids.alias("ids")).mapInArrow(run, "doc_id long, decoded binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encode(load(spark, sf_dir, "documents"), ranks_file())
    return made.select("doc_id", "n_tokens", F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
