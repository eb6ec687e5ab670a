from affinis.functions.html import div_texts
from affinis.sources import pages as pg


def texts(html, name="m"):
    return div_texts(html, (name,))[name]


def test_children_are_joined_by_spaces():
    assert texts('<div class="m">a<b>b</b>c</div>') == ["a b c"]
    assert texts('<div class="x m">a<br>b<br/>c</div>') == ["a b c"]
    assert texts('<div class="m"><b>x<i>y</i>z</b> t</div>') == ["xyz  t"]
    assert texts('<div class="m"></div>') == [""]
    assert texts('<p class="m">no</p><div class="mm">no</div>') == []


def test_entities_comments_scripts():
    assert texts('<div class="m">a &amp; b<!-- no -->c<script>var x="</p>";</script>d</div>') == ["a & b c d"]


def test_unclosed_and_stray_tags():
    assert texts('<div class="m"><p>one<p>two</div>after') == ["onetwo"]
    assert texts('<div class="m">a</span>b</div>c') == ["a b"]


def test_nested_wanted_elements():
    assert texts('<div class="m">a<div class="m">b</div>c</div>') == ["a b c", "b"]


def test_parse_pages(spark):
    html = '<div class="h">top <b>x</b></div><div class="m">one</div><div class="e">1 200 readers</div><div class="m">two</div>'
    df = spark.createDataFrame([(1, html), (2, "nothing"), (3, None)], "page_id bigint, html string")
    parsed = pg.parse_pages(df, "page_id", "h", "m", "e")
    rows = {r.page_id: r for r in parsed.collect()}
    assert rows[1].header == "top  x" and rows[1].messages == ["one", "two"]
    assert rows[2].header == "" and rows[2].messages == [] and rows[3].messages == []
    texts_of = [(r.pos, r.text) for r in pg.page_texts(parsed, "page_id").where("page_id = 1").collect()]
    assert texts_of == [(0, "one"), (1, "two"), (2, "top  x")]
    counts = {r.page_id: r.subscribers for r in pg.subscribers(parsed, "page_id").collect()}
    assert counts == {1: 1200, 2: -1, 3: -1}
