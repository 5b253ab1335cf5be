"""No caps and no lost pages: many languages, line limits as shares, wrappers around articles, row keys."""

import random
import string

import pytest
from pyspark.sql import functions as F

from tabassay.llm import decontaminate, html_extract, language_id, quality_rules
from tabassay.llm.tables import load

from .conftest import prose

ARTICLE = "<article><h1>A title</h1><p>First words.</p><p>Second words.</p></article>"
KEPT = ["A title", "First words.", "Second words."]


@pytest.mark.parametrize("page", [
    f"<body class='page right-sidebar'>{ARTICLE}<footer>f</footer></body>", f"<html class='no-comments'><body class='has-sidebar no-comments'>{ARTICLE}",
    f"<body><form action='x'>{ARTICLE}<input></form></body>", f"<div id='search-app'><nav>m</nav>{ARTICLE}</div>",
    f"<div class='comments'><article class='comment'><p>x</p></article></div>{ARTICLE}",
    "<form><nav>m</nav><h1>A title</h1><p>First words.</p><p>Second words.</p></form>"])
def test_wrappers_lose_no_page(page):
    assert [t for t, _, kept, *_ in html_extract.Page(page).blocks() if kept] == KEPT


def test_tree_alone_removes_boilerplate(spark):
    """By the host's largest gap, without any rule; with rules no content goes."""
    pages = load(spark, "/root/testdata/sf0.1", "pages")
    parsed = html_extract.stage_texts(html_extract.parse(pages).withColumn("host", F.coalesce("host", F.lit(""))), "test")
    low = {(r.host, r.node) for r in html_extract.low_nodes(html_extract.style_tree(parsed).withColumn("main", F.lit(False))).where("is_low").collect()}
    gone = {True: 0, False: 0}
    total = {True: 0, False: 0}
    texts = {r.page_id: r.text.split("\n\n") for r in html_extract.extract(pages).collect()}
    hosts = {r.page_id: r.host for r in parsed.select("page_id", "host").collect()}
    for p in pages.collect():
        found = html_extract.Page(p.html).blocks()
        assert [t for t, _, kept, *_ in found if kept] == texts[p.page_id]
        for _, path, kept, *_ in found:
            total[kept] += 1
            gone[kept] += (hosts[p.page_id], html_extract._hash("/".join(path))) in low
    assert gone[False] >= 0.98 * total[False] and gone[True] <= 0.005 * total[True]


def test_low_nodes_equal_plain_python(spark):
    r = random.Random(2)
    rows = [(f"h{k % 7}", k, 5 + k % 7 * 10, round(r.choice((0.1, 0.12, 0.5, 0.52, 0.9)) + r.random() / 50, 3), False, k % 3 == 0) for k in range(90)]
    got = {x.node for x in html_extract.low_nodes(spark.createDataFrame(rows, "host string, node long, pages long, importance double, beside boolean, main boolean")).where("is_low").collect()}
    want = set()
    for h in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == h), key=lambda x: (x[3], x[1]))
        gap, i = max(((b[3] - a[3], -k) for k, (a, b) in enumerate(zip(own, own[1:]))))
        if gap >= max(html_extract.MIN_GAP, html_extract.GAP_PAGES / max(x[2] for x in own)):
            want |= {x[1] for x in own if x[3] <= own[-i][3] and (not x[5] or gap >= html_extract.MAIN_GAP)}
    assert got == want and want


def test_many_languages_are_learned(spark):
    r = random.Random(4)
    letters = {f"x{k:03d}": "".join(r.sample(string.ascii_lowercase, 6)) for k in range(250)}
    rows = [(i * 250 + k, " ".join("".join(r.choice(a) for _ in range(5)) for _ in range(40)), lang)
            for i in range(12) for k, (lang, a) in enumerate(letters.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language_id.fit(docs, max_docs=3000)
    assert sum(len(d.names) for d in model.languages.values()) == 250
    got = {x.doc_id: x.lang_pred for x in language_id.predict(docs, model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.9 * len(rows)


def test_line_limits_are_shares(spark):
    """The same verdicts on the table and on four copies of it with other ids and texts."""
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    one = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert sum(r.n_removed_lines for r in one.values()) > 50
    more = docs.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).withColumn("k", F.col("i").cast("long")).select(
        (F.col("doc_id") + 10 ** 9 * F.col("k")).alias("doc_id"), "source", F.concat("text", F.lit("\n"), F.md5(F.concat_ws("-", "doc_id", "k"))).alias("text"))
    four = quality_rules.judge(more).collect()
    same = [one[r.doc_id % 10 ** 9].kept == r.kept for r in four if one[r.doc_id % 10 ** 9].n_words >= 10]
    assert sum(same) >= 0.99 * len(same)
    facts = quality_rules.document_facts(more)  # a host of 150 texts or more: only the share decides
    big = facts.groupBy("source").count().where("count >= 600").select("source")
    assert all(r.n_texts > 0.02 * 150 for r in quality_rules.frequent_lines(facts.join(big, "source")).collect())
    facts = quality_rules.document_facts(docs.unionByName(docs))
    assert all(r.n_docs >= 2 * r.n_texts for r in quality_rules.frequent_lines(facts).collect())


@pytest.mark.parametrize("few", [100_000, 0])
def test_frequent_lines_both_ways(spark, monkeypatch, few):
    monkeypatch.setattr(quality_rules, "HOT_BROADCAST", few)
    rows = [(i, f"Shared line here\n{prose(i, 30)}", "h") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.n_removed_lines for r in quality_rules.judge(docs).collect()} == {1}
    left = quality_rules.remove_lines(docs, quality_rules.frequent_lines(quality_rules.document_facts(docs))).collect()
    assert {r.doc_id: r.text for r in left} == {i: prose(i, 30) for i, _, _ in rows}


def test_contaminated_rows_stand_alone(spark, items):
    leak = prose(4, 25)
    rows = [(1, f"{prose(8, 20)} {leak}", "x"), (1, prose(9, 30), "x"), (None, leak, "x"), (None, prose(10, 30), "x"), (2, None, "x"), (3, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    left = decontaminate.keep_uncontaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in left.collect()) == sorted((str(i), t or "") for i, t, _ in (rows[1], *rows[3:]))
