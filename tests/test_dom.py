"""Facts from visible markup, over a page written for the purpose."""

import json

import pytest

from factloom.functions import dom

PAGE = """<html><head><title>Tent - Shop</title><meta name="description" content="A tent for four people, and a dog.">
<meta property="og:image" content="https://x.test/a_200x300.jpg"></head><body>
<ul class="Breadcrumbs"><li>Home</li><li>&gt;</li><li>Camping Gear</li><li>Camping Gear</li><li>Tent</li></ul>
<h1>Big <i>tent</i></h1><div class="price-box"><span class="price">$1,299.00</span> <b class="cost">1200 EUR</b></div><em itemprop="price" content="1250">x</em>
<img src="https://x.test/A.jpg"><img src="/logo.png"><img src="/b.png" width="50"><img data-src="/c.png" width="400"><img src="data:xx">
<table><tr><th>Weight (kg)</th><td> 4 </td></tr><tr><td>1</td><td>2</td><td>3</td></tr></table><dl><dt>Colour</dt><dd>red</dd><dt>Left</dt></dl>
<select name="Size"><option value="">-</option><option>S</option><option value="m">M</option><option>S</option></select>
<input type="radio" name="pole" value="a"><input type="radio" name="pole" value="b"><input type="radio" name="pole" value="a">
</body></html>"""


@pytest.fixture(scope="module")
def rows(spark):
    return dom.dom_facts(spark.createDataFrame([(0, PAGE), (1, None), (2, "")], "page_id long, html string")).orderBy("ordinal").collect()


def test_values(rows):
    assert {r.page for r in rows} == {0}
    got = [(r.raw_key, r.value, r.confidence) for r in rows]
    assert got == [
        ("base_price", "1250.0", 0.90), ("image_url", "https://x.test/a_200x300.jpg", 0.80), ("image_url", "/c.png", 0.60), ("category_path", "home/camping_gear", 0.70),
        ("weight_kg", "4", 0.70), ("colour", "red", 0.70), ("size", json.dumps(["S", "m"], separators=(",", ":")), 0.65), ("pole", '["a","b"]', 0.65), ("title", "Big tent", 0.75),
        ("description", "A tent for four people, and a dog.", 0.70),
    ]


def test_prices_of_lower_rank_are_kept(rows):
    assert rows[0].alternatives == ["1200.0", "1299.0", "1299.0"]


NESTED = [
    "<select name='size'>" + "".join(f"<option value='{i}'>size number {i} of a very long list of sizes</option>" for i in range(600)) + "</select>",
    "<dl>" + "".join(f"<dt>Key {i}</dt><dd>{'value ' * 20}{i}</dd>" for i in range(300)) + "</dl>",
    '<div class="breadcrumb"><div><div>Home</div></div><div>Lamps</div><div><div>Desk</div></div></div>',
    '<div class="price"><div>now</div><div>$<b>12.50</b></div></div>',
    '<div id="Description"><div>A lamp</div><div> for the desk, with a long arm.</div></div><p>',
]


def test_nested_and_long_elements(spark):
    rows = dom.dom_facts(spark.createDataFrame(list(enumerate(NESTED)), "page_id long, html string")).collect()
    got = {(r.page, r.raw_key): r.value for r in rows}
    assert json.loads(got[0, "size"]) == [str(i) for i in range(600)]
    assert len([k for k in got if k[0] == 1]) == 300 and got[1, "key_299"].endswith("299")
    assert got[2, "category_path"] == "home/lamps" and got[3, "base_price"] == "12.5" and got[4, "description"] == "A lamp for the desk, with a long arm."


def test_elements_that_are_not_closed(spark):
    pages = ["<table><tr><th>A<td>1<tr><td>B<td>2 <table><tr><td>C<td>3</table></table><dl><dt>D<dd>4<dt>E<dd>5</dl>", "<ul class=breadcrumb><li>One<li>Two<li>Three</ul><select name=s><option>x<option>y</select>"]
    rows = dom.dom_facts(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).collect()
    got = [{(r.raw_key, r.value) for r in rows if r.page == i} for i in range(2)]
    assert got == [{("a", "1"), ("c", "3"), ("d", "4"), ("e", "5")}, {("category_path", "one/two"), ("s", '["x","y"]')}]


def test_sweep_is_the_tree(sf_dir):
    """Names, nesting and texts of all elements are those of the element tree, on real pages and odd ones."""
    import pyarrow.parquet as pq

    from factloom.functions import elements, tree

    pages = pq.read_table(f"{sf_dir}/pages.parquet")["html"].to_pylist()[:100]
    pages += ["<div><div>a</div>b</div>c", "<p>x</b>y</p>", "<a href='>'>q</a><!-- <b> -->z<br/>w", "<script>if (a<b) {}</script>t<style>p{}</style>", "a < b <i>c", "&amp;<b>&lt;&#233;</b>", ""]
    for page in pages:
        text, named, place = elements.sweep(page)
        root = tree.read(page)
        want = list(root.below())
        assert [n for n, _, _ in named] == [e.name for e in want]
        for (name, _, _), (last, up, start, end, inner, *_), e in zip(named, place, want, strict=True):
            assert inner == sum(isinstance(x, tree.Element) for x in e.inside)
            if name not in elements.RAW:
                assert text[start:end].strip() == e.text(), (name, page[:50])
            assert (named[up][0] if up >= 0 else "") == e.up.name and len(list(e.below())) == last - want.index(e)


def test_deep_pages_take_time_in_proportion(spark):
    import time

    pages = ["<table><tr><td>" * 40_000 + "<th>k<td>v", "<div class=description>" * 60_000 + "long enough to be one of them", "<select name=a><option>x" * 40_000, "<ul class=breadcrumb><li>a" * 30_000]
    began = time.time()
    rows = dom.dom_facts(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).collect()
    assert time.time() - began < 60 and {r.page for r in rows} >= {1, 2}
