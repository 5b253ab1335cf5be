"""The registered queries: against DuckDB where SQL can express them, else against brute force."""

import hashlib
import re
import shutil
import zlib

import pytest
from compare import compare, connect

import __spark_entry__ as entry
import corpus_pipeline
from tabassay.llm import pii, registry, sentencepiece_codec, sharding
from tabassay.llm.tables import load

from .conftest import prose
from .test_exact import plain_pii, words

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op2_toxicity": "doc_id held_out score predicted",
    "op3_html_extraction": "page_id url text n_chars", "op4_language_id": "doc_id held_out lang_pred score",
    "op5_minhash_dedup": "doc_id n_shingles component_id kept",
    "op6_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op7_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op8_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op9_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op10_sentencepiece": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op11_prefix_trie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op12_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
    "op13_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256"}


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in load(spark, SF, "documents").collect()}


def test_registered():
    made = entry.queries()
    assert set(COLUMNS) == set(registry.queries()) and {*COLUMNS, "pipeline"} <= set(made)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "sentencepiece"]


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.columns[:len(COLUMNS[name].split())] == COLUMNS[name].split()
    table = "pages" if name.startswith("op3") else "documents"
    sql = registry.oracle_sql().get(name)
    if sql:
        assert compare(spark, connect(SF), SF, name, registry.queries()[name], sql)[0] == "ok"
    else:
        assert df.count() == load(spark, SF, table).count()


def test_pii_digests(spark, docs):
    for r in pii.query(spark, SF).collect():
        found = plain_pii(docs[r.doc_id])
        text = ",".join(f"{k}:{s}:{e}" for s, e, k in found)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in found) for k in pii.BASE]


def test_sharding_columns(spark, docs):
    for r in sharding.query(spark, SF).collect():
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "key") and 0 <= r.shard < 24


def test_proximity_query(spark):
    made = entry.queries()["op9_proximity"](spark, SF).collect()
    exact = entry.queries()["op9_decontamination"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit) for r in made) == sorted((r.doc_id, r.n_words, r.n_hit) for r in exact)
    assert any(r.n_near for r in made)


def test_pipeline(spark, docs):
    """The last stage against the library on what the others left."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_codec.model_file())
    current = load(spark, SF, "documents")
    kinds = current.columns
    for _, step in corpus_pipeline.STAGES[:-1]:
        current = corpus_pipeline.stage(step(spark, current, SF), "test")
        assert current.columns == kinds
    left = {r.doc_id: r.text for r in current.collect()}
    assert 0.6 * len(docs) < len(left) < len(docs)
    assert all(not plain_pii(t) for t in left.values())
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: list(r.ids) for r in got} == {i: sp.encode(t, add_eos=True) for i, t in left.items()}


def plain_near(texts):
    """Ids that stay: the least of each group of chained pairs with 5-word Jaccard 0.8 or more."""
    sets = {i: {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} if (w := words(t)) else set() for i, t in texts.items()}
    group = {i: i for i in texts}
    for a in texts:
        for b in texts:
            same = len(sets[a] & sets[b])
            if a < b and same and 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    return {i for i, g in group.items() if i == g}


def plain_leaks(texts, tests):
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    windows = {tuple(w[k:k + 10]) for w in map(split, tests) for k in range(max(len(w) - 9, 1) if w else 0)}
    sizes = {len(g) for g in windows}
    return {i for i, t in texts.items() if any(tuple(w[k:k + n]) in windows for w in [split(t)] for n in sizes for k in range(len(w) - n + 1))}


def plain_mask(text):
    """The four base kinds, none overlapping here."""
    for a, b, kind in reversed(plain_pii(text)):
        text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
    return text


def test_pipeline_equals_plain_python(spark, docs, tmp_path):
    """Ids and texts of stages 2, 3 and 4, and the token ids of run(), on documents with planted
    copies, chains, pairs just below the limit, leaks of all and of part of a window, and personal data."""
    import sentencepiece
    leak = load(spark, SF, "benchmark").where("text IS NOT NULL").orderBy("item_id").first().text.split()
    base, n = prose(70, 100), 10 ** 6
    chain = [base] + [" ".join(w if k not in at else "changed" for k, w in enumerate(base.split())) for at in ((3,), (3, 96), (3, 50, 96), (20, 30, 40, 60))]
    planted = chain + [base, prose(71, 80) + " " + " ".join(leak[:10]), prose(72, 80) + " " + " ".join(leak[:9]) + " end",
                       " ".join(leak), prose(73, 40) + " mail a.b@c.de or 10.0.0.1, 4111 1111 1111 1111, +1 (555) 010-9999 now",
                       prose(74, 40) + " from 300.1.1.1 and 4111 1111 1111 1112 here", ""]
    kinds = load(spark, SF, "documents")
    more = spark.createDataFrame([(n + i, t, "en", "planted", len(t)) for i, t in enumerate(planted)], "doc_id long, text string, lang string, source string, n_chars long")
    kinds.unionByName(more.select(kinds.columns)).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    tests = [r.text for r in load(spark, SF, "benchmark").collect()]
    read = lambda df: {r.doc_id: r.text or "" for r in df.collect()}
    made = [load(spark, str(tmp_path), "documents")]
    for _, step in corpus_pipeline.STAGES[:-1]:
        made.append(corpus_pipeline.stage(step(spark, made[-1], str(tmp_path)), "test"))
    clean, near, left, masked = map(read, made[1:])
    assert {n + i for i in range(len(planted))} <= set(clean)
    own = plain_near(clean)
    expected = {i: t for i, t in clean.items() if i in own}
    assert near == expected and {i - n for i in set(clean) - own if i >= n} >= {1, 5}
    gone = plain_leaks(expected, tests)
    expected = {i: t for i, t in expected.items() if i not in gone}
    assert left == expected and {i - n for i in gone if i >= n} >= {6} and n + 7 in left
    expected = {i: plain_mask(t) for i, t in expected.items()}
    assert masked == expected and masked[n + 9].endswith(" mail [EMAIL] or [IP], [CARD], [PHONE] now")
    sp = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_codec.model_file())
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: sp.encode(t, add_eos=True) for i, t in expected.items()}
