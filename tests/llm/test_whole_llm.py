"""Rows that repeat or have no id; markup that is broken or hidden."""

from folioscope.llm import html_extract, jaccard_join, suffix_dedup


def test_one_row_of_each_group_stays(spark):
    """Repeated rows and rows without an id, within a group and across groups."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(90)) for x in ("alpha", "beta", "gamma", "delta"))
    rows = [(1, a, "en"), (1, a, "en"), (1, a, "de"), (2, a + " end", "en"), (None, b, "en"), (None, b, "en"), (None, b + " end", "en"), (None, c, "en"), (3, c, "en"), (None, d, "en"), (4, c + " end", "en"), (3, d, "en"), (8, None, "en"), (8, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    out = jaccard_join.stage(spark, docs, "")
    got = [(r.doc_id, (r.text or "")[:4]) for r in out.collect()]
    assert out.columns == docs.columns
    assert sorted(got, key=str) == sorted([(1, "alph"), (None, "beta"), (3, "gamm"), (3, "delt"), (8, ""), (8, "")], key=str)
    assert [r.lang for r in out.collect() if r.doc_id == 1] == ["de"]
    left = {(r.doc_id, (r.text or "")[:4]): r.text for r in suffix_dedup.stage(spark, out, "").collect()}
    assert left[1, "alph"] == a and left[None, "beta"] in (b, b + " end")


def words_of(html):
    return " ".join(x for x in html_extract.Page(html).text if x)


def test_unclosed_controls_hide_nothing():
    article = "<article><h1>Head</h1><p>One text.<p>Two texts.</article>"
    for name in ("button", "select", "svg", "math", "object", "template"):
        for menu in (f"<nav><{name}>Menu</nav>", f"<{name}>Menu", f"<div><a href=/>x</a> <{name} class=m><option>A</div>", f"<{name}>A<{name}>B"):
            assert words_of(f"<body>{menu}{article}</body>").endswith("Head One text. Two texts."), (name, menu)
    assert words_of(f"<button>Menu{article}<button>Share</button> after").endswith("Head One text. Two texts. after")


def test_closed_controls_are_left_out():
    for name in ("button", "select", "svg", "object", "template"):
        for inner in ("x", "<div>x</div>", "<div>x", "<p>x</p> y", "<b>x", "<p>a<div>b</div>c<svg><path/>z</svg>"):
            assert words_of(f"<p>Some <a href=/>link</a> <{name}>{inner}</{name}> rest.</p><p>End.").split() == "Some link rest. End.".split(), (name, inner)
    assert words_of("<p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn><mspace/><annotation>x=2</annotation></math> holds.</p>") == "Where x=2 holds."
    assert words_of("<p>A<script>b<c</script>d<textarea>e</p>") == "Ad"


def test_article_after_an_unclosed_button(spark):
    text = " ".join(f"word{k}" + ("." if k % 9 == 8 else "") for k in range(120))
    rows = [(k, "u", f"<html><body><nav><{x}>Menu<ul><li><a href='/a'>Home</a></li></ul></nav><article><h1>Title one</h1><p>{text}</article><footer>&copy; me</footer>") for k, x in enumerate(("button", "select", "b"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.text for r in html_extract.extracted(df, html_extract.fit([text])).collect()}
    assert got == {f"Title one {text}"}
