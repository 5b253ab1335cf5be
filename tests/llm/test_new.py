"""Prefix trie, hard negatives and byte-level BPE against plain Python and the tokenizer library."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tabassay.llm import byte_bpe, hard_negatives, prefix_trie

RANKS = byte_bpe.ranks_file()


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, RANKS.splitlines())}
    return tiktoken.Encoding("own", pat_str=byte_bpe.pattern(), mergeable_ranks=ranks, special_tokens={})


ODD = ["'s 'S it's’t  \n\t a\r\n\r\n ", "\x85a\xa0b\x1c\x1dc", "١٢٣ ²³½ 12 3a4", "全角文字と仮名。テスト", "a" * 700, "ab" * 300 + "=" * 90, "🎉👩‍👩‍👧 é é"]


def test_bpe_hard_rows(spark, library, hard, none):
    got = {}
    for r in byte_bpe.encode(hard.where("length(text) < 50000 OR text IS NULL"), RANKS).collect():
        got.setdefault(r.doc_id, []).append((r.n_tokens, list(r.ids), bytes(r.decoded).decode()))
    want = {}
    for r in hard.where("length(text) < 50000 OR text IS NULL").collect():
        ids = library.encode_ordinary(r.text or "")
        want.setdefault(r.doc_id, []).append((len(ids), ids, r.text or ""))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}
    assert byte_bpe.encode(none, RANKS).count() == 0


def test_bpe_unicode_classes(library):
    """Every code point alone and between others, in the classes of the library, in small rounds of the cache."""
    points = [chr(c) for c in [*range(0x500, 0xD800, 3), *range(0xE000, 0x1FFFF, 5)]]
    texts = ODD + ["a" + "".join(points[k:k + 9]) + " 1" + points[k] for k in range(0, len(points), 9)]
    one = byte_bpe.Worker(RANKS, byte_bpe.pattern())
    for start in range(0, len(texts), 500):
        ids, decoded = one.encode(pa.array(texts[start:start + 500]))
        assert ids.to_pylist() == [library.encode_ordinary(t) for t in texts[start:start + 500]]
        assert [b.decode() for b in decoded.to_pylist()] == texts[start:start + 500]
        one.forget()
    assert one.decode(ids).to_pylist() == decoded.to_pylist()


def test_bpe_decode(spark, none):
    df = spark.createDataFrame([(1, [72, 1]), (2, []), (3, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(df, RANKS).collect()}.keys() == {1, 2, 3}
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode(spark.createDataFrame([(1, [50256])], "doc_id long, ids array<int>"), RANKS).collect()


def plain_negatives(rows, anchors, share=80):
    rows = [(i, n, x, [math.floor(256 * v) for v in vec]) for n, (i, x, vec) in enumerate(rows)
            if i is not None and x is not None and vec is not None and all(v is not None and math.isfinite(v) for v in vec)]
    made = []
    for a in rows:
        if a[0] % anchors:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(a[3], b[3])), b[0], b[1], b[2]) for b in rows if b[1] != a[1]), key=lambda s: s[:3])
        for s, p, _, _ in [s for s in scored if s[3] == a[2]][:5]:
            inside = [t for t in scored if t[3] != a[2] and share * -s <= 100 * -t[0] <= 100 * -s][:5]
            made += [(a[0], p, k + 1, t[1], -s, -t[0]) for k, t in enumerate(inside)]
    return sorted(made)


@pytest.mark.parametrize("scale", [1, 3000])
def test_negatives_ties_and_odd_rows(spark, scale):
    r = random.Random(5)
    base = [[scale * r.choice((-0.5, 0.001, 0.25, 1.0)) for _ in range(6)] for _ in range(12)]
    rows = [(i, r.randrange(3), list(r.choice(base))) for i in range(120)] + [(10, 1, base[0]), (10, 1, base[0]), (20, 2, [])]
    rows += [(130, 1, base[1][:3]), (140, None, base[1]), (None, 1, base[1]), (150, 1, None), (160, 1, [float("nan")] * 6), (170, 1, [float("inf")] + base[1][1:]),
             (180, 1, [None] + base[1][1:])]
    df = spark.createDataFrame([(i, x, v, "clash") for i, x, v in rows], "vec_id long, label int, embedding array<float>, score string").coalesce(1)
    want = plain_negatives([(i, x, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, x, v in rows], 10)
    for block in (3, 8192):
        got = hard_negatives.mine(hard_negatives.prepare(df), F.col("vec_id") % 10 == 0, anchor_block=block).collect()
        assert sorted(map(tuple, got)) == want
    assert len(want) > 100
    assert hard_negatives.mine(hard_negatives.prepare(df.where("false")), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(hard_negatives.prepare(df), F.col("vec_id") == 1000).count() == 0


def test_negatives_beyond_long(spark):
    df = spark.createDataFrame([(0, 1, [1e12, 1.0])], "vec_id long, label int, embedding array<float>")
    with pytest.raises(ArithmeticError):
        hard_negatives.mine(hard_negatives.prepare(df), F.col("vec_id") % 10 == 0)


@pytest.mark.parametrize("most", [1, 300, 10 ** 5, 10 ** 8])
def test_exact_products(most):
    r = np.random.default_rng(3)
    a, b = r.integers(-most, most + 1, (7, 1500)), r.integers(-most, most + 1, (11, 1500))
    a[0], b[0] = -most, most
    primes = hard_negatives.primes_for(most * most * 1500)
    left, right = (hard_negatives.Residues(x, primes).parts for x in (a, b))
    assert (hard_negatives.scores(left, right, primes) == a @ b.T).all()


def plain_trie(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns.setdefault(conv, []).append(((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in turns.items()}
    made = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + x[h:])
    nodes = {}
    for c, s in made.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + ((len(nodes[p]) - 1) * len(p[-1][1]) if p else 0)
    ends = {p: hashlib.sha256(",".join(map(str, sorted(c for c in x if len(made[c]) == len(p)))).encode()).hexdigest() for p, x in nodes.items()}
    return sorted((min(x), len(p), min(nodes[p[:-1]]) if p else -1, len(x), len(kids.get(p, [])), leaves[p], saved[p], ends[p]) for p, x in nodes.items())


def trie_rows():
    r = random.Random(9)
    texts = ["", "a", "bb", "ccc", "é" * 4, None]
    rows = [(c, t, r.choice(("u", "v", None)), r.choice(texts[:4])) for c in range(0, 130) for t in range(r.randrange(1, 7))]
    rows += [(c, t, "u", "same") for c in range(1000, 1060) for t in range(9)]  # a hot group of copies, with a long shared path
    rows += [(c, t, "u", f"{t if t < c - 2000 else -t}") for c in range(2001, 2012) for t in range(12)]  # leaves the path one by one
    rows += [(-7, 0, "u", "a"), (-107, 1, None, None), (-100, 0, "u", "b"), (3300, None, "u", "null turn"), (3300, 0, "u", "x"), (3300, 0, "u", "x"), (3301, 0, "u", "q"),
             (None, 0, "u", "a"), (3500, 1, "v", "z" * 5000), (3501, 0, "u", "only")]
    return rows


@pytest.mark.parametrize("segment, box", [(1024, 128), (4, 6), (3, 1)])
def test_trie(spark, segment, box):
    rows = trie_rows()
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, depth int").repartition(5)
    got = prefix_trie.build(*prefix_trie.rebuild(df), segment=segment, box_rows=box).collect()
    assert sorted(tuple(-1 if v is None else v for v in x) for x in got) == plain_trie(rows)


def test_trie_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.build(*prefix_trie.rebuild(df)).count() == 0
    one = spark.createDataFrame([(1, 0, "u", "x")], "conv_id long, turn long, role string, text string")  # crc32 of 1 takes the only turn
    got = prefix_trie.build(*prefix_trie.rebuild(one)).collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_children) for r in got] == [(r[0], r[1], r[3], r[4]) for r in plain_trie([(1, 0, "u", "x")])]


def test_end_digests_in_pieces(spark, monkeypatch):
    pairs = spark.range(3000).selectExpr("IF(id % 3 = 0, 'rare' || id, 'hot') AS key", "id * 7 AS conv_id").repartition(4)
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 400)
    got = {r.key: r.ends for r in prefix_trie.end_digests(pairs).collect()}
    hot = ",".join(str(i * 7) for i in range(3000) if i % 3)
    assert len(got) == 1001 and got["hot"] == hashlib.sha256(hot.encode()).hexdigest() and got["rare6"] == hashlib.sha256(b"42").hexdigest()
