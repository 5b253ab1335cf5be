"""Nulls, empty and very long texts, repeated rows and ids, empty tables, clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from tabassay.llm import (decontaminate, html_extract, language_id, minhash_dedup, pii, quality_rules,
                          sentencepiece_codec, sharding, suffix_dedup, toxicity)

MODEL = sentencepiece_codec.model_file()

OPERATORS = {
    "pii": lambda d, i, lab: pii.find_pii(d),
    "toxicity": lambda d, i, lab: toxicity.score(d, toxicity.fit(d, lab), out_col="tox"),
    "language": lambda d, i, lab: language_id.predict(d, language_id.fit(d)),
    "minhash": lambda d, i, lab: minhash_dedup.near_duplicates(d, 3, 85),
    "sharding": lambda d, i, lab: sharding.place(d, sharding.tree(24), sharding.tree(25)),
    "quality": lambda d, i, lab: quality_rules.judge(d),
    "suffix": lambda d, i, lab: suffix_dedup.remove_repeats(d),
    "decontaminate": lambda d, i, lab: decontaminate.decontaminate(d, i),
    "sentencepiece": lambda d, i, lab: sentencepiece_codec.encode(d, MODEL),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_hard_and_empty(name, hard, none, items, labels, hard_rows):
    got = OPERATORS[name](hard, items, labels).collect()
    assert len(got) == len(hard_rows)
    assert OPERATORS[name](none, items, labels).count() == 0


def test_no_items_no_labels(hard, items, labels, hard_rows):
    found = decontaminate.decontaminate(hard, items.where("false"))
    assert found.where("contaminated").count() == 0 and found.count() == len(hard_rows)
    model = toxicity.fit(hard, labels.where("false"))
    assert model.stems == {}
    assert 0 <= toxicity.score(hard, model, out_col="tox").agg(F.max("tox")).first()[0] <= 1
    assert {r.lang_pred for r in language_id.predict(hard, language_id.fit(hard.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}


def test_html_edges(spark):
    rows = [(1, "http://a/x", None), (2, None, ""), (3, "http://a/y", "<p>one<p>two &amp; <b>th</b>ree<br>four"), (3, "http://a/y", "plain"),
            (None, "x", "<article><h1>T</h1><div class='comments'>no</div><p>yes</article><footer>f</footer>"),
            (5, "http://b/", "<" * 5000), (6, "http://b/", "<p " + "a='" * 3000), (7, "http://b/", "<script>var a='<p>x</p>'</script><!-- c --><p>k</p><!--"),
            (8, "http://b/", "<div>" * 3000 + "deep" + "</div>" * 3000), (9, "http://c/", "<nav>m</nav><header>h</header><form>f</form><p>  a \n b&nbsp;c </p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("text", F.lit("t"))
    got = [(r.page_id, r.text) for r in html_extract.extract(df).collect()]
    assert len(got) == len(rows)
    texts = {}
    for i, t in got:
        texts.setdefault(i, []).append(t)
    assert texts[1] == [""] and texts[2] == [""] and sorted(texts[3]) == ["one\n\ntwo & three four", "plain"]
    assert texts[None] == ["T\n\nyes"] and texts[7] == ["k"] and texts[8] == ["deep"] and texts[9] == ["a b c"]
    assert html_extract.extract(df.where("false")).count() == 0


@pytest.mark.parametrize("few", [100_000, 0])
def test_style_tree_removes_what_pages_share(spark, monkeypatch, few):
    monkeypatch.setattr(html_extract, "LOW_NODES", few)
    page = lambda i: (i, f"http://h/{i}", f"<body><div class='x'>Same words here</div><div class='y'><p>Own text {i * 7}</p></div></body>")
    df = spark.createDataFrame([page(i) for i in range(8)], "page_id long, url string, html string")
    assert {r.text for r in html_extract.extract(df).collect()} == {f"Own text {i * 7}" for i in range(8)}


@pytest.mark.parametrize("few", [100_000, 0])
def test_style_tree_sees_all_text(spark, monkeypatch, few):
    """Own text beside an article stays, shared text there goes; many menu entries do not take a page's only text with them."""
    monkeypatch.setattr(html_extract, "LOW_NODES", few)
    menu = "".join(f"<div class='m{chr(97 + k)}'>Entry {k}</div>" for k in range(20))
    rows = [(i, f"http://h/{i}", f"<nav>new {i}</nav><div id='con'><p>Own text {i * 7}</p></div><div class='x'>Same</div>"
                                 f"<article><p>Teaser {i * 3}</p></article>") for i in range(8)]
    rows += [(i, f"http://k/{i}", f"<body>{menu}<p>Own text {i * 7}</p></body>") for i in range(8, 16)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Own text {i * 7}" + (f"\n\nTeaser {i * 3}" if i < 8 else "") for i in range(16)}


def test_pipeline_stages(hard, hard_rows, items, labels):
    kept = toxicity.keep_clean(hard, labels)
    assert kept.columns == hard.columns
    one = minhash_dedup.keep_one(hard)
    ids = [r.doc_id for r in one.select("doc_id").collect()]
    assert one.columns == hard.columns and 2 not in ids and 3 not in ids and ids.count(None) == 2 and ids.count(1) == 2
    left = decontaminate.keep_uncontaminated(hard, items)
    assert left.columns == hard.columns and not {7, 8, 13, 14} & {r.doc_id for r in left.select("doc_id").collect()}
    masked = pii.mask_pii(hard)
    assert masked.columns == hard.columns
    text = masked.where("doc_id = 12 AND text LIKE 'mail%'").first().text
    assert text == "mail [EMAIL] or [IP], [CARD], [PHONE]; password = [SECRET]"
    assert masked.where("text IS NULL").count() == hard.where("text IS NULL").count()
