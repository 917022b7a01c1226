"""HTML extraction, Merkle manifest and ranked search against brute force and hand-made pages."""

from __future__ import annotations

import html
import os
import random
import re
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from funnelkit.llm import htmltext, lexical, merkle, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, source string, lang string, n_chars long, text string, tree string, i long, n long, digest string, claim string"
#: Nulls, empties, repeated ids and rows, a very long text.
ROWS = [
    (1, "a", "en", 3, "one"), (2, "a", "en", None, "two words"), (2, "b", "en", 9, "two words"), (2, "b", "en", 9, "two words"), (None, None, None, None, None),
    (None, "a", "en", 0, ""), (3, None, "fr", 5, "été £ 日本 🙂"), (4, "a", "", 7, "lang is empty"), (5, "a", "é", 7, "x" * 200000), (6, "a", "z", 1, "A"), (7, "a", "en", 2, None),
]


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def documents(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, 2, "h", "c") for r in rows], DOCUMENTS)


# 11 Merkle manifest

@pytest.mark.parametrize("n", range(1, 40))
def test_positions(n):
    """Every node's place in closed form, against the log of one builder and of blocks."""
    leaves = [f"{k:064x}".encode() for k in range(n)]
    levels = brute._levels([x.decode() for x in leaves])
    top = merkle.height(n, 60)
    log = merkle.complete(leaves, top)
    assert len(levels) == top + 1 and sorted(log) == sorted(x.encode() for level in levels for x in level)
    for level, nodes in enumerate(levels):
        for k, node in enumerate(nodes):
            assert log[merkle.position(level, k, n)] == node.encode()
    for bits in (1, 2, 3):
        for start in range(0, n, 1 << bits):
            part = merkle.complete(leaves[start: start + (1 << bits)], merkle.height(n, bits))
            first = merkle.position(0, start, n)
            assert log[first: first + len(part)] == part or n <= 1 << bits


def test_manifest(spark):
    for rows in (ROWS, ROWS[:1], [(k, "s", "en" if k % 3 else "fr", k, f"text {k}") for k in range(37)]):
        wanted = ordered(brute.manifest(rows))
        for bits in (1, 2, 8):
            got = merkle.verified(merkle.build(documents(spark, rows).repartition(3), claim=merkle.tampered(), bits=bits))
            assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
            assert ordered(got.collect()) == wanted, bits
    assert any(not r[-1] for r in wanted) and any(r[-1] for r in wanted)


def test_manifest_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert ordered(queries.op11_merkle_manifest(spark, SF).collect()) == ordered(brute.manifest(rows))


def test_manifest_empty_and_hot(spark):
    assert merkle.verified(merkle.build(documents(spark, ROWS).filter("false"))).count() == 0
    same = documents(spark, [ROWS[0]] * 90 + [(9, "a", "en", 1, "other")])
    got = merkle.verified(merkle.build(same, bits=3)).collect()
    assert len(got) == 91 and all(r.verified for r in got)
    assert ordered(got) == ordered((*r[:5], r[3], True) for r in brute.manifest([ROWS[0]] * 90 + [(9, "a", "en", 1, "other")]))


# 12 HTML extraction

def from_template(page):
    """The article of a page of the given tables, which all have one article element."""
    article = page[page.index("<article>") + 9: page.index("</article>")]
    parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("<p>|</p>|</h1>", article))
    return "\n".join(x for x in parts if x)


def test_given_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = queries.op12_html_text(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.url == pages[r.page_id].url and r.text == from_template(pages[r.page_id].html) and r.n_chars == len(r.text)


STORY = ["The council met on Monday, and after a long debate, it agreed to the plan.", "Short one.",
         "Two members, both new, spoke against it, but the others &mdash; nine in all &mdash; did not follow them."]
PLAIN = "\n".join(html.unescape(x) for x in STORY)
BODY = "".join(f"<p>{x}</p>" for x in STORY)
LINKS = "".join(f'<li><a href="/{k}">Section number {k}</a></li>' for k in range(8))
NOISE = "This long sentence, with its commas, and yet more commas, is not a part of the story, and goes on, and on."


@pytest.mark.parametrize("page", [
    f"<body><ul>{LINKS}</ul><div id=main-content>{BODY}</div><div class=sidebar><p>{NOISE}</p></div></body>",
    f"<body class='has-sidebar ads-on'><div id=top><ul>{LINKS}</ul></div><div class='post with-sidebar'>{BODY}</div></body>",
    f"<div class='cookie-notice'>{NOISE}{NOISE}</div><table><tr><td><ul>{LINKS}</ul><td>{BODY}</table>",
    f"<main><article>{BODY}<section class=comments><article class=comment><p>{NOISE}<p>{NOISE}</article></section></article></main>",
    f"<article>{BODY}<footer>{NOISE}</footer><aside>{NOISE}</aside><form><p>{NOISE}<input value='a>b'></form></article>",
    f"<form id=aspnet><header><h1>My site</h1></header><article>{BODY}</article></form><footer><p>{NOISE}</footer>",
    f"<body>{BODY}<div class=adBox><p>{NOISE}</div><div hidden><p>{NOISE}</div><div style='color:red; display : none'><p>{NOISE}</div></body>",
    f"<article><div><p>{STORY[0]}</div><div><p>{STORY[1]}</div><div><p>{STORY[2]}</div><ul>{LINKS}</ul></article>",
    f"<div role=navigation>{NOISE}</div><div>{BODY}</div><script>if (a < b) document.write('<p>{NOISE}</p>')</script><style>p {{}}</style>",
    f"<nav>{NOISE}<p>{NOISE}</nav><!-- <p>{NOISE} --><article>{BODY.replace('</p>', '')}",
    f"<article>{BODY.replace('<p>', '<p><b><i>').replace('</p>', '</b>')}</article>",
    f"<div class=a>{STORY[0]}<br><br>{STORY[1]}<br/> <br>{STORY[2]}</div><textarea><p>{NOISE}</textarea>",
])
def test_main_text(page):
    assert htmltext.extract(page)[0] == PLAIN


def test_extract_cases():
    cases = {
        None: "", "": "", "no markup &amp; so on": "no markup & so on", "<p>": "", "<": "<", "a < b <c": "a < b", "<p>a<br>b</p>": "a b", "<!-- x": "",
        "<script>a": "", "<article></article>": "", "<article><p>One.</article><div>Much longer, and with commas, but not the article.</div>": "One.",
        "<article><h1>Title</h1>\n\n <p> a\n\tb&nbsp;c&#8211;d &zzz; &amp </p></article>": "Title\na b c–d &zzz; &",
        "<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table><pre>p\n  q</pre></article>": "one\ntwo\nx\ny\np q",
        "<article><p>Text with <a href=/x>one link</a> in it.</p></article>": "Text with one link in it.",
        "<p title='a>b'>x</p><p title=\"unclosed>y": "x\ny",
    }
    for page, wanted in cases.items():
        assert htmltext.extract(page)[0] == wanted, page


def test_extract_long_pages():
    assert htmltext.extract("<div>" * 20000 + "deep")[0] == "deep"
    assert htmltext.extract("<b><p>" * 20000 + "x")[0] == "x"
    assert htmltext.extract("<article>" + "<p>word, word</p>" * 30000 + "</article>")[0] == "\n".join(["word, word"] * 30000)
    assert len(htmltext.extract("<" * 100000 + "\"'" * 100000)[0]) > 0
    assert htmltext.extract("<a href=\"" * 5000 + "'" * 5000) is not None


def test_main_text_frame(spark):
    schema = "page_id long, html string, text string, row string, n_chars int, found string"
    frame = spark.createDataFrame([(1, "<p>One.</p>", "t", "r", 1, "f"), (1, "<p>One.</p>", "t", "r", 1, "f"), (None, None, None, None, None, None)], schema)
    got = htmltext.main_text(frame)
    assert ordered(got.select("row.page_id", "text", "n_chars").collect()) == ordered([(1, "One.", 4), (1, "One.", 4), (None, "", 0)])
    assert htmltext.main_text(frame.filter("false")).count() == 0


# 13 ranked search

def search_rows(seed, docs, words):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    rows = [(k % (docs * 2 // 3), " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(words)], k=rng.choice([1, 5, 30, 300])))) for k in range(docs)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 6, 90])))) for k in range(12)]
    return rows, items


@pytest.mark.parametrize("seed", range(3))
def test_search(spark, seed, monkeypatch):
    rows, items = search_rows(seed, 300, 120)
    rows += [(None, "w1 w2 W3, w3"), (9000, None), (9001, ""), (9002, " ., "), (9003, "w5 " * 30000), (9003, "w5 " * 30000)]
    items += [(3, items[3][1]), (3, "w9 other"), (20, None), (21, ""), (22, "unknown zz"), (None, "w1 w1 w2")]
    monkeypatch.setattr(lexical, "CHUNK", (1, 16, 256)[seed])
    frame = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], "doc_id long, text string, item_id string, score int, n int").repartition(5)
    asked = spark.createDataFrame([(*r, 1, "d") for r in items], "item_id long, text string, rank int, doc_id string")
    found = lexical.search_all(frame, asked)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert ordered(found.collect()) == ordered(brute.search(rows, items))


def test_search_parts_and_empty(spark, monkeypatch):
    rows, items = search_rows(7, 60, 40)
    frame, asked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(lexical, "PART_BYTES", 400)
    assert ordered(lexical.search_all(frame, asked).collect()) == ordered(brute.search(rows, items))
    assert lexical.search_all(frame.filter("false"), asked).count() == 0
    assert lexical.search_all(frame, asked.filter("false")).count() == 0


def test_search_stops_early():
    """Masks that cannot reach the last kept place are never scored."""
    rng = np.random.default_rng(0)
    n = 4000
    terms = [[0] if k % 40 else [0, 1, 2] for k in range(n)]
    counts = [[1] * len(t) for t in terms]
    block = lexical.Block(pa.array(rng.permutation(n)), np.full(n, 50), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), n, 50 * n)
    best = lexical.Best(20)
    weights = np.array([10, 3000, 3000])
    scored = lexical.search(block, [(0, 1), (1, 1), (2, 1)], weights, np.zeros(3, np.int64), best, chunk=50)
    assert scored == 100 and len(best.doc) == 20
    assert lexical.search(block, [(0, 1)], weights, np.zeros(3, np.int64), best, chunk=50) == 0


def test_search_block_equals_scores():
    assert lexical.weight(0, 0) == 693 and lexical.weight(10, 10) >= 0
