"""Wrapper induction: matching against brute force, pages of a megabyte, and one rule for any number of pages of a host."""

import random
import time
from functools import lru_cache

import pytest

from siltgrid.llm import html


def tree(rng, depth):
    n = rng.randint(0, 4) if depth else 0
    return rng.choice("abc") + ("(" + ",".join(tree(rng, depth - 1) for _ in range(n)) + ")" if n else "")


def brute_size(a, b):
    left, right = html.read_skeleton(a), html.read_skeleton(b)

    @lru_cache(None)
    def best(i, j):
        if left[i][0] != right[j][0]:
            return 0
        table = [[0] * (len(right[j][1]) + 1) for _ in range(len(left[i][1]) + 1)]
        for x, p in enumerate(left[i][1], 1):
            for y, q in enumerate(right[j][1], 1):
                table[x][y] = max(table[x - 1][y], table[x][y - 1], table[x - 1][y - 1] + best(p, q))
        return 1 + table[-1][-1]

    return best(0, 0)


@pytest.mark.parametrize("cells", [1_000_000, 5])
def test_matches_are_the_largest(monkeypatch, cells):
    monkeypatch.setattr(html, "CELLS", cells)
    html.match_trees.cache_clear()
    rng = random.Random(cells)
    for _ in range(800):
        a, b = f"#({tree(rng, 3)},{tree(rng, 3)})", f"#({tree(rng, 3)},{tree(rng, 2)})"
        match, left, right = html.match_trees(a, b), html.read_skeleton(a), html.read_skeleton(b)
        assert sum(j >= 0 for j in match) == brute_size(a, b)
        above = [{c: i for i, (_, children) in enumerate(t) for c in children} for t in (left, right)]
        used = [j for j in match if j >= 0]
        assert used == sorted(set(used))
        assert all(left[i][0] == right[j][0] and (i == 0 or match[above[0][i]] == above[1][j]) for i, j in enumerate(match) if j >= 0)
    html.match_trees.cache_clear()


def timed(f):
    began = time.perf_counter()
    out = f()
    assert time.perf_counter() - began < 20  # seconds for a megabyte; quadratic reading took minutes
    return out


def test_a_megabyte_of_alternating_blocks():
    flat = "<h2>a</h2><p>b</p>" * 55_000
    skeleton = timed(lambda: html.number(html.parse(flat))[0])
    assert timed(lambda: html.match_trees(skeleton, skeleton)) == tuple(range(110_001))
    other = html.number(html.parse("<p>z</p>" + flat[:599_994] + "<h3>x</h3>" + flat[:99_990]))[0]
    match = timed(lambda: html.match_trees(other, skeleton))
    assert sum(j >= 0 for j in match) == len(match) - 1  # but for the h3
    assert len(timed(lambda: html.content(html.parse(flat)))) == 110_000


@pytest.mark.parametrize("page", ["<a b=1 " * 150_000, '<a "' * 250_000, '<a ">x' * 170_001, "<!x " * 200_000, "<p '" * 200_001 + ">"])
def test_a_megabyte_of_unclosed_tags(page):
    timed(lambda: html.parse(page))


def test_a_megabyte_of_self_closing_tags():
    assert html.content(timed(lambda: html.parse("x" + "".join(f"<t{i}/>" for i in range(90_000)) + "y")))[-1].endswith("y")


def test_odd_markup_is_read_as_before():
    text = lambda page: html.content(html.parse(page))
    assert text("a < b <3 <p title='>'>c</p> d <!-- x > y --> e <!doctype z>f<!-- open <p>g") == ["a < b <3", "c", "d e f"]
    assert text("<script>if (a < b) '</p>'</script>t<style/>u</style>v") == ["tv"]
    assert text("one <p>two <b class='x'>three</b> four") == ["one", "two three four"]


@pytest.mark.parametrize("pages", [1, 3, 6, 60])
def test_one_rule_for_any_number_of_pages(spark, pages):
    page = "<body><article><header><h1>Title {0}</h1></header><h2>Ingredients</h2><p>Dish {0} needs salt and {0} eggs.</p></article><div class=stats>Visitors today {0}</div></body>"
    rows = [(i, f"http://h.test/{i}", page.format(i)) for i in range(pages)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {i: f"Title {i}\n\nIngredients\n\nDish {i} needs salt and {i} eggs." for i in range(pages)}


def test_main_text_beside_teasers(spark):
    """Where articles are teasers, the longer text that varies beside them is kept."""
    page = "<div class=body><p>Story {0} begins here and goes on for longer than any teaser would.</p></div><article><h2>Next {0}</h2></article>"
    rows = [(i, f"http://t.test/{i}", page.format(i)) for i in range(6)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(f"Story {i} begins" in got[i] for i in range(6))
