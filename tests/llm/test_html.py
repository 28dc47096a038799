import itertools
import random

import numpy as np

from tessera.llm import html


def test_blocks_and_implied_tags():
    page = "<!DOCTYPE html><head><title>no</title><script>var a='<p>no</p>';</script><body>loose &amp; text<ul><li>one<li>two<ul><li>in</ul><li>three</ul><p>a <b>b<br>c<p>d</b> e<!-- no --></p><td>f&nbsp;&#233;</td><pre> x\n y </pre><textarea>no</textarea><p title='>'>last</p>"
    assert [b.text for b in html.blocks(page)] == ["loose & text", "one", "two", "in", "three", "a b c", "d e", "f é", "x y", "last"]
    assert html.blocks("") == [] and html.blocks("<p> \n</p>") == []
    assert [b.text for b in html.blocks("a < b <p>c</p")] == ["a < b", "c</p"]


def test_viterbi_finds_the_best_of_all_labelings():
    r = random.Random(2)
    for _ in range(40):
        found = [html.Block("w" * r.randint(1, 4), (("p", (str(i),)),), 0.0) for i in range(r.randint(1, 7))]
        weights = {f"word {i}": r.uniform(-2, 2) for i in range(7)}
        chain = html.Chain(weights, (r.uniform(-1, 1), r.uniform(-1, 1)), tuple((r.uniform(-1, 1), r.uniform(-1, 1)) for _ in range(2)))
        unit = [sum(weights.get(f, 0) for f in html.path_features(b.path) + html.text_features(b)) for b in found]

        def total(y, unit=unit, chain=chain):
            return chain.start[y[0]] + sum(u * v for u, v in zip(unit, y, strict=True)) + sum(chain.step[a][b] for a, b in itertools.pairwise(y))

        best = max(itertools.product((0, 1), repeat=len(found)), key=total)
        assert np.isclose(total(chain.labels(found, {})), total(best))


def test_held_out_layouts():
    chain, r = html.train(), random.Random(77)
    right = n = 0
    for _ in range(150):
        found, labels = html.labelled(html.training_page(r))
        right += sum(a == b for a, b in zip(chain.labels(found, {}), labels, strict=True))
        n += len(labels)
    assert right / n > 0.97


PAGE = """<html><body><div class="cookie-banner">We use cookies.</div><header><h2>Site name</h2></header><nav><a href=/>Home</a> <a href=/x>News</a></nav>
<main><article><h1>The  title</h1><p>First &lt;paragraph&gt; with   words and more of them.</p><div class="ad">Buy now, it is cheap and good.</div><p>Second paragraph.</p></article>
<section id="comments"><div class="comment"><p>I do not agree with this at all.</p></div></section></main>
<aside class="sidebar"><p>Related stories that you may like to read.</p></aside><form><label>Name</label><input></form><footer><p>Copyright of somebody.</p></footer></body></html>"""


def test_pages(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x"), (4, "w", "<nav><a>x</a></nav>", "x"), (1, "u", PAGE, "x")]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [r["text"] for r in got if r["page_id"] == 1] == ["The title\n\nFirst <paragraph> with words and more of them.\n\nSecond paragraph."] * 2
    assert {r["page_id"]: r["text"] for r in got if r["page_id"] != 1} == {2: "", None: "", 4: ""}
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
