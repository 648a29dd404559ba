import html
import random
import re
import time

import pytest

from sparsight.llm import html as H
from sparsight.llm.labelled_pages import MARK, labelled_pages


def of_article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1|li|ul|div)\b[^>]*>", inner)]
    return "\n\n".join(b for b in blocks if b)


def test_pages_give_their_articles(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = H.op8_dom_marginals(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == of_article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_accuracy_on_unseen_layouts():
    model = H.trained()
    assert H.evaluate(model, labelled_pages(300, 99)) > 0.955
    assert all(MARK not in f for f in model.weight)


def test_marginals_are_exact():
    model, tree = H.trained(), H.parse("<div class=menu><p>one two. three<p>four</div><article><h1>t</h1>more words here.</article>")
    size, linked = H.extents(tree)
    n, parent = len(tree.parent), tree.parent
    evidence = [0.0] + [sum(model.weight.get(f, 0.0) for f in H.features(tree, k, size, linked)) for k in range(1, n)]
    total, yes = 0.0, [0.0] * n
    for code in range(2**n):
        label = [code >> k & 1 for k in range(n)]
        p = 0.0
        for k in range(1, n):
            p += model.move[label[parent[k]], tree.text[k] is None][label[k]] + evidence[k] * label[k]
        w = 2.718281828459045**p
        total += w
        for k in range(n):
            yes[k] += w * label[k]
    assert all(abs(y / total - m) < 1e-9 for y, m in zip(yes, model.marginals(tree)))


def test_markup_of_all_kinds():
    def runs(page):
        return [t for t in H.parse(page).text if t is not None]

    assert runs("") == runs("<p>") == runs("<!-- a <p> b") == runs("<script>if (a<b) '<p>x</p>'</script>") == []
    assert runs("<p>a</p><script>b") == runs("<p>a</p><!-- b") == runs("<p>a</p><!-- b <i>") == runs("<p>a<!-- b") == ["a"] and runs("<p>a</p>b") == ["a", "b"]
    assert runs('<a title="' * 20000) and runs("<p class='x\" " * 20000)
    assert runs("a<b>b</b>c &amp; &#233;&nbsp;&lt;d") == ["abc & é <d"]
    assert runs("<p>one<p>two<div>three</div>four") == ["one", "two", "three", "four"]
    assert runs('<a title="x > y" href=\'>\'>in</a> out <br/> more') == ["in out more"]
    assert runs("<ul><li>a<li>b<ul><li>c</ul>d</ul>") == ["a", "b", "c", "d"]
    assert runs("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert runs("</p></div>x <  y <3 <") == ["x < y <3 <"]
    assert runs("<p>" * 20000 + "deep" + "<div>" * 20000 + "deeper") == ["deep", "deeper"]


def test_odd_rows(spark, tmp_path):
    rows = [(1, "u", None, 1), (2, None, "", 2), (None, "u", "<article><p>Some words that go on for a while, as texts do.</p></article>", 3), (4, "u", "no mark-up, only a sentence of words.", 4), (4, "u", "<nav><a href=x>a</a></nav>" * 3000, 5)]
    spark.createDataFrame(rows, "page_id long, url string, html string, text long").write.parquet(str(tmp_path / "pages.parquet"))
    out = {(r.page_id, r.n_chars > 0) for r in H.op8_dom_marginals(spark, str(tmp_path)).collect()}
    assert (1, False) in out and (2, False) in out and (None, True) in out and (4, False) in out
    spark.read.parquet(str(tmp_path / "pages.parquet")).limit(0).write.parquet(str(tmp_path / "e" / "pages.parquet"))
    assert H.op8_dom_marginals(spark, str(tmp_path / "e")).count() == 0


def slow_stack(page):
    """Depths of elements as the search of the whole stack gives them."""
    stack, out = [], []
    for m in re.finditer(r"<(/?)(\w+)>", page):
        tag = m[2]
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k] == tag:
                    del stack[k:]
                    break
            continue
        ends = H.SIBLINGS.get(tag, ("p",) if tag in H.CLOSES_P else ())
        for k in range(len(stack) - 1, -1, -1):
            if stack[k] in ends:
                del stack[k:]
            elif stack[k] in H.SCOPE:
                break
        stack.append(tag)
        out.append((tag, len(stack)))
    return out


def test_unclosed_and_unmatched_tags_nest_as_before():
    rng = random.Random(4)
    tags = "p div li ul td tr table section center dt dd dl".split()
    for _ in range(300):
        page = "".join(rng.choice(["<{}>", "<{}>", "</{}>"]).format(rng.choice(tags)) for _ in range(rng.randint(1, 60)))
        tree = H.parse(page)
        depth = [0]
        for parent in tree.parent[1:]:
            depth.append(depth[parent] + 1)
        assert list(zip(tree.tag, depth))[1:] == slow_stack(page), page


@pytest.mark.parametrize("page", ["<center>" * 125_000, "<div>" * 60_000 + "</section>" * 60_000, "<li>" * 250_000, "<table><tr><td>" * 60_000, "<p>a<div>b</section>" * 50_000])
def test_a_megabyte_of_unclosed_blocks_takes_linear_time(page):
    began = time.process_time()
    H.parse(page)
    assert time.process_time() - began < 15
