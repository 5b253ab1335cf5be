"""Prefix trie of conversations by burst tries.

Turns are numbered without gathering a conversation: rows are range-partitioned by (conversation,
turn), so a long one is spread over partitions and each partition adds a broadcast offset (at most
one row per partition). Sequences are cut into segments of ``SEGMENT`` turns; segments of one depth
form a layer, whose trie heads are digests of all earlier segments. Equal segments under one head
collapse to one row with a weight before anything else.

In a layer every head holds a container of suffixes. A container of more than ``BOX_ROWS`` rows bursts:
its common prefix (that of its least and greatest suffix) becomes a chain of nodes, and the rows move
into one container per next turn id. Containers that are left are sorted and swept once with a stack
into nodes. Totals of subtrees then climb from round to round and from layer to layer. A segment that
only one conversation reaches is a chain and is written down directly, so one very long conversation
costs no layers. Rounds end when no container is too large; there is no cap on them.

``rebuild`` orders turns by number, null first, then by the MD5 of role and text; null role or text
is empty text. Repeated rows are turns of their own. Rows without conv_id take no part; without rows
there are no nodes, not even a root. Turn ids are 128-bit digests of role and text. Texts of any
length count whole. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import load, stage

SEGMENT = 1024
BOX_ROWS = 128
BOX_TURNS = 16 * 1024
BROADCAST_BOXES = 20_000
PIECE_BYTES = 1 << 20
TOP = hashlib.md5(b"").hexdigest()
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]

SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT)),
         lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)),
         4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM t)
), r AS (
  SELECT c.conv_id, 0 AS own, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 WHERE t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id WHERE t.pos > c.h
), s AS (
  SELECT c.conv_id, coalesce(list({'role': r.role, 'text': r.text} ORDER BY own, pos) FILTER (WHERE pos IS NOT NULL), []) AS seq
  FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id
), p AS (
  SELECT conv_id, len(seq) AS n, d, seq[:d] AS path FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM s)
), n AS (
  SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(coalesce(length(path[d].text), 0)) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM p GROUP BY path, d
), k AS (SELECT path[:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1
), w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.path = n.path
), u AS (
  SELECT path[:j] AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS j FROM w) GROUP BY 1
)
SELECT w.conv_id, w.depth, a.conv_id AS parent_conv_id, w.n_convs, w.n_children, u.n_leaves, u.saved_tokens, w.ends_sha256
FROM w JOIN u ON u.path = w.path LEFT JOIN n a ON w.depth > 0 AND a.path = w.path[:w.depth - 1]
"""


def _numbered(batches):
    """(part, conv_id, k, tid, n_chars): k counts a conversation's turns inside this partition."""
    part, last, k = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column(0).to_numpy()
        if not len(conv):
            continue
        starts = np.concatenate([[0], np.flatnonzero(conv[1:] != conv[:-1]) + 1])
        runs = np.diff(np.append(starts, len(conv)))
        at = np.arange(len(conv)) - np.repeat(starts, runs) + 1
        if conv[0] == last:
            at[:runs[0]] += k
        last, k = conv[-1], at[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), part, np.int32)), batch.column(0), pa.array(at), batch.column(1), batch.column(2)],
                                         ["part", "conv_id", "k", "tid", "n_chars"])


def positions(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, tid, n_chars) with positions from 1, and (conv_id, n) of every conversation."""
    taken = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    named = taken.select("conv_id", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("tid"),
                         F.length("text").alias("n_chars"), "turn")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "tid"]
    spread = named.repartitionByRange(*order).sortWithinPartitions(*order).drop("turn")
    numbered = stage(spread.mapInArrow(_numbered, "part int, conv_id long, k long, tid string, n_chars int"), "turns")
    counts = numbered.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shifted = counts.withColumn("before", before).where("before > 0").select("conv_id", "part", "before")
    placed = numbered.join(F.broadcast(shifted), ["conv_id", "part"], "left")  # only a partition's first conversation has one
    return (placed.select("conv_id", (F.col("k") + F.coalesce("before", F.lit(0))).alias("pos"), "tid", "n_chars"),
            counts.groupBy("conv_id").agg(F.sum("n").alias("n")))


def rebuild(conversations: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, tid, n_chars) and ids of conversations whose first h turns are those of the group's first.

    h is the CRC32 of the id's digits modulo ``most``.
    """
    placed, counts = positions(conversations)
    first = (placed.where((F.col("conv_id") % group == 0) & (F.col("pos") < most)).groupBy(F.col("conv_id").alias("base"))
             .agg(F.array_sort(F.collect_list(F.struct("pos", "tid", "n_chars"))).alias("first")))
    info = counts.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"),
                         (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int").alias("h"))
    info = info.join(first, "base", "left")
    info = stage(info.select("conv_id", "h", F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.array().cast(first.schema["first"].dataType)).alias("head")), "groups")
    own = placed.join(info.select("conv_id", "h", (F.size("head") - F.col("h")).alias("shift")), "conv_id").where("pos > h")
    own = own.select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "tid", "n_chars")
    return own.unionByName(info.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.pos", "t.tid", "t.n_chars")), info.select("conv_id")


def _pieces(batches):
    """Ids of a key in this partition, joined, in pieces of bounded size."""
    part = TaskContext.get().partitionId()
    key, ids, size, n, rows = None, [], 0, 0, []

    def close():
        if ids:
            rows.append((key, part, n, ",".join(ids)))

    def out():
        cols = list(zip(*rows))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3])], ["key", "part", "n", "piece"])

    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key or size > PIECE_BYTES:
                close()
                key, ids, size, n = k, [], 0, n + 1
            ids.append(str(c))
            size += 20
            if len(rows) >= 2048 or (rows and size > PIECE_BYTES):
                yield out()
    close()
    if rows:
        yield out()


def _digests(batches):
    """SHA-256 of a key's pieces in order; holds one hash state."""
    key, state, rows = None, None, []
    for batch in batches:
        for k, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key:
                if state:
                    rows.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if len(rows) >= 2048:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["key", "ends"])
            rows = []
    if state:
        rows.append((key, state.hexdigest()))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["key", "ends"])


def end_digests(pairs: DataFrame) -> DataFrame:
    """(key, ends): SHA-256 of each key's conv_ids, ascending, comma-joined.

    Ids of one key lie in as many partitions as they fill; only joined pieces meet, in order, and pass
    through one hash state, since the digest itself is sequential.
    """
    pieces = (pairs.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
              .mapInArrow(_pieces, "key string, part int, n long, piece string"))
    return pieces.repartition("key").sortWithinPartitions("key", "part", "n").select("key", "piece").mapInArrow(_digests, "key string, ends string")


def _sweep(batches):
    """Nodes of sorted containers, and one summary per container (kind 1) for its head.

    A node on the stack: conv, n, children, leaves, saved, chars, ends, records of closed children.
    """
    names = ["kind", "box", "up", "up_conv", "off", "char", *NODE]
    kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(),
             pa.int64(), pa.int64(), pa.string()]
    rows, stack, box, last, about = [], [], None, [], None

    def shut(conv, node, depth):
        """Children of a closed node get their parent's id."""
        rows.extend((0, None, None, None, None, None, c[0], depth + 1, conv, c[1], c[2], c[3], c[4], c[6]) for c in node[7])

    def close(depth):
        while len(stack) > depth + 1:
            node = stack.pop()
            if not node[2]:
                node[3] = 1
            node[4] += (node[1] - 1) * node[5]
            shut(node[0], node, about["off"] + len(stack))
            node[7] = None
            up = stack[-1]
            up[0] = node[0] if up[0] is None else min(up[0], node[0])
            up[1] += node[1]
            up[2] += 1
            up[3] += node[3]
            up[4] += node[4]
            up[7].append(node)

    def finish():
        if box is not None:
            close(0)
            top = stack.pop()
            shut(top[0] if about["off"] else about["head_conv"], top, about["off"])
            rows.append((1, box, about["up"], about["up_conv"], about["off"], top[5], top[0], about["off"], about["up_conv"], top[1], top[2], top[3], top[4], top[6]))

    def out():
        made = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        rows.clear()
        return pa.RecordBatch.from_arrays(made, names)

    for batch in batches:
        for r in batch.to_pylist():
            ids, off = r["ids"], r["off"]
            if r["box"] != box:
                finish()
                box, about, last = r["box"], r, ids[:off]
                stack.append([None, 0, 0, 0, 0, r["chars"][off - 1] if off else 0, None, []])
            common = off
            while common < len(last) and common < len(ids) and last[common] == ids[common]:
                common += 1
            close(common - off)
            stack.extend([None, 0, 0, 0, 0, r["chars"][j], None, []] for j in range(common, len(ids)))
            node = stack[-1]
            node[0], node[1] = r["minc"] if node[0] is None else min(node[0], r["minc"]), node[1] + r["w"]
            node[2], node[3], node[4], node[6], last = node[2] + r["b_children"], node[3] + r["b_leaves"], node[4] + r["b_saved"], r["ends"], ids
        if len(rows) >= 4096:
            yield out()
    finish()
    if rows:
        yield out()


SWEPT = ("kind int, box string, up string, up_conv long, off int, char long, conv_id long, depth long, parent_conv_id long, n_convs long, "
         "n_children long, n_leaves long, saved_tokens long, ends_sha256 string")


def _layer(rows: DataFrame, box_rows: int, box_turns: int) -> tuple[DataFrame, DataFrame]:
    """Nodes below the heads of one layer, with depths relative to it, and (head, children, leaves, saved).

    ``rows``: head, head_conv, ids, chars, w, minc, ends, b_children, b_leaves, b_saved.
    """
    now = rows.select(F.col("head").alias("box"), F.lit(None).cast("string").alias("up"), F.lit(None).cast("long").alias("up_conv"),
                      F.lit(0).alias("off"), "head_conv", "ids", "chars", "w", "minc", "ends", "b_children", "b_leaves", "b_saved")
    kept, rounds = [], []
    while True:
        shared = [F.first(c).alias(c) for c in ("up", "up_conv", "off", "head_conv")]
        sizes = now.groupBy("box").agg(F.count("*").alias("rows"), F.sum(F.size("ids") - F.col("off")).alias("turns"), F.min("ids").alias("low"),
                                       F.max("ids").alias("high"), F.min_by("chars", "ids").alias("chars"), F.sum("w").alias("w"),
                                       F.min("minc").alias("minc"), *shared)
        same = F.array_position(F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b)), False)
        big = sizes.where((F.col("rows") > box_rows) | (F.col("turns") > box_turns)).withColumn("lcp", (same - 1).cast("int"))
        big = stage(big.drop("low", "high"), "burst")
        n_big = big.count()
        if not n_big:
            kept.append(now)
            break
        ends_at = F.when(F.col("lcp") == 0, F.col("head_conv")).otherwise(F.col("minc"))
        to = big.select("box", "lcp", ends_at.alias("at_conv"))
        moved = now.join(F.broadcast(to) if n_big <= BROADCAST_BOXES else to, "box", "left")
        on = F.col("lcp").isNotNull() & (F.size("ids") > F.col("lcp"))
        path = F.array_join(F.slice("ids", F.col("off") + 1, F.greatest(F.col("lcp") + 1 - F.col("off"), F.lit(0))), "")
        moved = stage(moved.select(
            F.when(on, F.md5(F.concat("box", path).cast("binary"))).otherwise(F.col("box")).alias("box"),
            F.when(on, F.col("box")).otherwise(F.col("up")).alias("up"), F.when(on, F.col("at_conv")).otherwise(F.col("up_conv")).alias("up_conv"),
            F.when(on, F.col("lcp") + 1).otherwise(F.col("off")).alias("off"), *now.columns[4:],
            F.when(F.col("lcp").isNull(), 0).when(on, 1).otherwise(2).alias("state")), "containers")
        kept.append(moved.where("state = 0").drop("state"))
        rounds.append((big, moved.where("state = 2").select("box", F.col("ends").alias("ended"))))
        now = moved.where("state = 1").drop("state")

    left = kept[0]
    for part in kept[1:]:
        left = left.unionByName(part)
    swept = stage(left.repartition("box").sortWithinPartitions("box", "ids").mapInArrow(_sweep, SWEPT), "swept")
    nodes, tops = [swept.where("kind = 0").select(NODE)], swept.where("kind = 1").drop("kind")
    summaries = [tops]
    for big, ended in reversed(rounds):
        kids = summaries[-1] if len(summaries) == 1 else tops.unionByName(summaries[-1])
        total = kids.where("up IS NOT NULL").groupBy(F.col("up").alias("box")).agg(
            F.count("*").alias("k"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves"))).alias("leaves"),
            F.sum(F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("char")).alias("saved"))
        full = big.join(total, "box").join(ended, "box", "left")
        tail = lambda i: F.aggregate(F.slice("chars", i, F.greatest(F.col("lcp") - i + 1, F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)
        at_end = F.col("lcp") == F.col("off")
        head = full.select(
            "box", "up", "up_conv", "off", F.when(F.col("off") > 0, F.get("chars", F.col("off") - 1)).otherwise(0).cast("long").alias("char"),
            F.col("minc").alias("conv_id"), F.col("off").cast("long").alias("depth"), F.col("up_conv").alias("parent_conv_id"), F.col("w").alias("n_convs"),
            F.when(at_end, F.col("k")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
            (F.col("saved") + (F.col("w") - 1) * tail(F.col("off") + 1)).alias("saved_tokens"), F.when(at_end, F.col("ended")).alias("ends_sha256"))
        chain = full.where("lcp > off").select("*", F.explode(F.sequence(F.col("off") + 1, F.col("lcp"))).alias("i"))
        nodes.append(chain.select(
            F.col("minc").alias("conv_id"), F.col("i").cast("long").alias("depth"),
            F.when(F.col("i") == 1, F.col("head_conv")).otherwise(F.col("minc")).alias("parent_conv_id"), F.col("w").alias("n_convs"),
            F.when(F.col("i") == F.col("lcp"), F.col("k")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
            (F.col("saved") + (F.col("w") - 1) * tail(F.col("i"))).alias("saved_tokens"), F.when(F.col("i") == F.col("lcp"), F.col("ended")).alias("ends_sha256")))
        summaries.append(stage(head, "heads"))
    heads = summaries[0]
    for part in summaries[1:]:
        heads = heads.unionByName(part)
    nodes.append(heads.where("off > 0").withColumns({
        "n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long"),
        "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("char")}).select(NODE))
    made = nodes[0]
    for part in nodes[1:]:
        made = made.unionByName(part)
    return made, heads.where("off = 0").select(F.col("box").alias("head"), F.col("n_children").alias("b_children"), F.col("n_leaves").alias("b_leaves"), F.col("saved_tokens").alias("b_saved"))


def build(turns: DataFrame, members: DataFrame, segment: int = SEGMENT, box_rows: int = BOX_ROWS, box_turns: int = BOX_TURNS) -> DataFrame:
    """Nodes of the trie of sequences (conv_id, pos from 1 without gaps, tid, n_chars); ``members`` lists all conv_ids, turnless ones too."""
    box_turns = max(box_turns, 2 * segment)  # so a container that bursts has at least two rows
    cut = turns.groupBy("conv_id", F.floor((F.col("pos") - 1) / segment).cast("int").alias("seg")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "tid", "n_chars"))).alias("t"))
    cut = cut.select("conv_id", "seg", F.col("t.tid").alias("ids"), F.col("t.n_chars").alias("chars"), F.md5(F.array_join("t.tid", "").cast("binary")).alias("dg"))
    order = Window.partitionBy("conv_id").orderBy("seg")
    before = F.collect_list("dg").over(order.rowsBetween(Window.unboundedPreceding, -1))
    segs = cut.withColumns({"before": before, "last": F.lead("seg").over(order).isNull()})
    segs = stage(segs.select("conv_id", "seg", "ids", "chars", "dg", "last", F.md5(F.array_join("before", "").cast("binary")).alias("head"),
                             F.md5(F.concat(F.array_join("before", ""), "dg").cast("binary")).alias("next")), "segments")
    whole = segs.where("last").select(F.col("next").alias("key"), "conv_id")
    bare = members.join(segs.where("seg = 0").select("conv_id"), "conv_id", "left_anti").select(F.lit(TOP).alias("key"), "conv_id")
    ends = stage(end_digests(whole.unionByName(bare)), "ends")

    rows = segs.groupBy("seg", "head", "dg", "next").agg(F.first("ids").alias("ids"), F.first("chars").alias("chars"), F.count("*").alias("w"),
                                                         F.min("conv_id").alias("minc"), F.max("last").alias("ended"))
    rows = rows.join(ends.withColumnRenamed("key", "next"), "next", "left")
    total, least = members.agg(F.count("*"), F.min("conv_id")).first()
    if not total:
        return turns.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    rows = stage(rows, "rows")
    deep = rows.where("seg > 0")
    over = deep.groupBy("head").agg((F.sum("w") == 1).alias("alone"))
    above = rows.select(F.col("next").alias("head"), F.col("minc").alias("head_conv"), (F.col("seg") + 1).alias("seg"))
    deep = stage(deep.join(over, "head").join(above, ["head", "seg"]), "deep")
    deepest = deep.where("NOT alone").agg(F.max("seg")).first()[0] or 0

    lone = deep.where("alone").select("*", F.posexplode("chars").alias("i", "char"))
    lone = lone.withColumn("tip", (F.col("i") + 1 == F.size("chars")) & F.col("ended"))
    nodes = [lone.select(F.col("minc").alias("conv_id"), (F.col("seg") * segment + F.col("i") + 1).cast("long").alias("depth"),
                         F.when(F.col("i") == 0, F.col("head_conv")).otherwise(F.col("minc")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
                         F.when(F.col("tip"), 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
                         F.lit(0).cast("long").alias("saved_tokens"), F.when(F.col("tip"), F.col("ends")).alias("ends_sha256"))]
    below = None
    for seg in range(deepest, -1, -1):
        here = deep.where(f"seg = {seg} AND NOT alone") if seg else rows.where("seg = 0").withColumn("head_conv", F.lit(least))
        single = deep.where(f"seg = {seg + 1} AND alone").select("head", *(F.lit(n).cast("long").alias(c) for c, n in (("b_children", 1), ("b_leaves", 1), ("b_saved", 0))))
        under = single if below is None else below.unionByName(single)
        here = here.join(under.withColumnRenamed("head", "next"), "next", "left").fillna(0, ["b_children", "b_leaves", "b_saved"])
        made, below = _layer(here, box_rows, box_turns)
        nodes.append(made.withColumn("depth", F.col("depth") + seg * segment))

    root = ends.where(F.col("key") == TOP).select(F.col("ends").alias("ends_sha256")).unionByName(
        turns.sparkSession.range(1).select(F.lit(None).cast("string").alias("ends_sha256"))).agg(F.max("ends_sha256").alias("ends_sha256"))
    seen = below.agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("b_children", "b_leaves", "b_saved"))).first()
    nodes.append(root.select(*(F.lit(v).cast("long").alias(c) for c, v in zip(NODE[:-1], (least, 0, None, total, seen[0], max(seen[1], 1), seen[2]))), "ends_sha256"))
    out = nodes[0]
    for part in nodes[1:]:
        out = out.unionByName(part)
    return out.fillna({"ends_sha256": NO_ENDS})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(*rebuild(load(spark, sf_dir, "conversations")))
