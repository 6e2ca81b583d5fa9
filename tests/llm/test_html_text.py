import pytest
from pitsight.llm import html_text as H

BODY = "<p>{0} words that make a paragraph of some length, with a comma or two.</p>"
ARTICLE = "".join(BODY.format(n) for n in ("First", "Second", "Third"))
WANTED = "\n\n".join(f"{n} words that make a paragraph of some length, with a comma or two." for n in ("First", "Second", "Third"))


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><nav><a href=/>Home</a></nav><article>{ARTICLE}</article><footer>Imprint</footer></body></html>",
        f"<body><header><h1>Site</h1></header><div id=content>{ARTICLE}</div><aside>Related <a href=x>link</a></aside></body>",
        f"<body><div class='sidebar'><a href=1>one</a> <a href=2>two</a></div><main>{ARTICLE}</main><div class='ad-box'>Buy</div>",
        f"<body><div class=cookie-notice>We use cookies.</div><div>{ARTICLE}<form><input><p>Subscribe now, dear reader.</p></form></div></body>",
        f"<body><article>{ARTICLE}<section class='comments'><p>{'A reader says a lot about it. ' * 20}</p></section></article></body>",
        f"<body><article>{ARTICLE}<script>if (a < b) document.write('<p>no</p>')</script><style>p{{}}</style><!-- <p>no</p> --></article>",
        f"<BODY><ARTICLE>{ARTICLE}</ARTICLE>",
        f"<body><div style='display:none'>{'Hidden text. ' * 50}</div><div>{ARTICLE}</div></body>",
    ],
)
def test_article_without_surroundings(page):
    assert H.main_text(page) == WANTED


def test_blocks_references_and_space():
    page = "<body><article><h1>A &amp; B</h1><p>caf&eacute; &#8211; <b>bold\n text<br>next</p>  <ul><li>one<li>two</ul><p>last &lt;tag&gt;"
    assert H.main_text(page) == "A & B\n\ncafé – bold text next\n\none\n\ntwo\n\nlast <tag>"


@pytest.mark.parametrize("page", [None, "", "<html></html>", "<body><nav>menu</nav></body>", "<script>x</script>"])
def test_nothing(page):
    assert H.main_text(page) == ""


def test_broken_markup_and_depth():
    deep = "<div>" * 5000 + "<p>Deep down there is a sentence.</p>" + "</div>" * 5000
    assert H.main_text(f"<body>{deep}</body>") == "Deep down there is a sentence."
    assert H.main_text("plain text, no markup") == "plain text, no markup"
    assert H.main_text("<p>1 < 2 and <b>more</p></i>") == "1 < 2 and more"


def test_whole_text_of_a_long_page():
    n = 20_000
    text = H.main_text("<body><article>" + "".join(f"<p>Sentence number {i} of many.</p>" for i in range(n)) + "</article></body>")
    assert text.count("\n\n") == n - 1 and text.endswith(f"number {n - 1} of many.")


def test_extract_keeps_rows_and_other_columns(spark):
    rows = [(1, "u", f"<body><article>{ARTICLE}</article></body>", "old"), (1, "u", f"<body><article>{ARTICLE}</article></body>", "old"), (None, None, None, None), (3, "v", "", "old")]
    out = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert out.columns == ["page_id", "url", "text"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([(1, "u", WANTED), (1, "u", WANTED), (None, None, ""), (3, "v", "")], key=str)
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("wrapper", ["div class='content-with-sidebar'", "div id='page-nav-left'", "form action=/"])
def test_wrapper_with_a_layout_name_keeps_its_article(wrapper):
    page = f"<body><div>Site name</div><{wrapper}><div>{ARTICLE}</div><div class=sidebar><p>Other things.</p></div></{wrapper.split()[0]}></body>"
    assert H.main_text(page) == WANTED


def test_sidebar_beside_an_article_stays_out():
    page = f"<body><div>{ARTICLE}</div><div class=sidebar><p>Some words of a sidebar.</p></div></body>"
    assert H.main_text(page) == WANTED


def test_loose_text_of_containers():
    page = f"<body><div>Loose <b>words</b> before.<div>{ARTICLE}</div>And some <i>after</i> it. <a href=x>More of this</a></div></body>"
    assert H.main_text(page) == f"Loose words before.\n\n{WANTED}\n\nAnd some after it. More of this"


def test_densities_and_sums_by_brute_force():
    """Every node's density, counted again over the markup between its tags, and the subtree that has the largest sum."""
    import math
    import re

    divs = [
        "".join(f"<p>{'word ' * n}<a href=x>{'link ' * k}</a><b>bold</b></p>" for n, k in rows)
        for rows in ([(40, 1), (55, 2), (60, 1)], [(2, 3), (1, 4)], [(12, 1)], [(70, 2), (3, 9)])
    ]
    body = "".join(f"<div>{d}</div>" for d in divs)
    nodes = H.in_order(H.parse(f"<html><body>{body}</body></html>"))
    H.measure(nodes)

    def counted(inside):
        chars = len("".join(re.sub(r"<[^>]*>", "", inside).split()))
        links = re.findall(r"<a .*?</a>", inside)
        return chars, len(re.findall(r"<[a-z]", inside)), sum(len("".join(re.sub(r"<[^>]*>", "", x).split())) for x in links), len(links)

    c, _, lc, _ = counted(body)

    def density(inside):
        chars, tags, link_chars, link_tags = counted(inside)
        base = math.log(chars * link_chars / (chars - link_chars) + lc / c * chars + math.e)
        return chars / tags * math.log(max(1, chars / link_chars * tags / link_tags)) / max(1, math.log(max(base, math.e)))

    found = [n for n in nodes if n.tag == "div"]
    assert [n.density for n in found] == pytest.approx([density(d) for d in divs])
    sums = [sum(density(p) for p in re.findall(r"<p>(.*?)</p>", d)) for d in divs]
    assert [n.total for n in found] == pytest.approx(sums)
    best = max(range(4), key=sums.__getitem__)
    assert sums[best] > sum(density(d) for d in divs)
    assert found[best] in H.main_nodes(nodes) and found[1] not in H.main_nodes(nodes)


def test_densities_decide(monkeypatch):
    """With all densities alike other subtrees are taken: on most pages of the table, and on those of the tests."""
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist()
    before = [H.main_text(page) for page in pages]
    monkeypatch.setattr(H, "composite_density", lambda *a: 1.0)
    assert sum(H.main_text(page) != text for page, text in zip(pages, before)) > len(pages) / 2


def test_names_that_only_hold_a_marking_word():
    page = f"<body><div class='social-history'>{ARTICLE}</div><div class='copy'>Imprint of the site.</div></body>"
    assert H.main_text(page) == WANTED


def test_a_list_of_links_in_the_article_goes():
    links = "".join(f"<li><a href=/{i}>More about topic {i}</a></li>" for i in range(20))
    assert H.main_text(f"<body><article>{ARTICLE}<ul>{links}</ul></article></body>") == WANTED


def test_unnamed_surroundings_are_thin():
    page = f"<body><div><span>Site</span><span>name</span></div><div><ul>{'<li><a href=x>Topic</a></li>' * 9}</ul></div><div>{ARTICLE}</div><div><a href=1>Imprint</a> <a href=2>Contact</a></div></body>"
    assert H.main_text(page) == WANTED


@pytest.mark.parametrize("broken", ["<a " * 300_000, "<b>" * 200_000, "</x>" * 200_000, "<i></b>" * 100_000, "<script>" * 100_000, "<p '>" * 100_000, "<!--" * 200_000, "<li>" * 100_000, "<table><td>" * 50_000])
def test_broken_pages_take_linear_time(broken):
    import time

    began = time.perf_counter()
    assert H.main_text(f"<body>{ARTICLE}{broken}").startswith("First words")
    assert time.perf_counter() - began < 8


def test_depth_loses_no_text():
    page = "<div>" * 2000 + "one" + "</div>two" * 2000
    assert " ".join(H.blocks(H.parse(f"<body>{page}</body>"))).split() == ["one", *["two"] * 2000]


def test_the_table_against_plain_cutting():
    """Whole pages of the table: what stands in the article tag, cut by block tags, references decoded."""
    import html
    import re

    import pyarrow.parquet as pq

    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        inside = re.search("<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
        parts = [html.unescape(re.sub("<[^>]*>", "", part)) for part in re.split(r"</?(?:h1|p|ul|li|div|section)\b[^>]*>", inside)]
        assert H.main_text(page) == "\n\n".join(" ".join(part.split()) for part in parts if part.split())


LONG = "This is a long paragraph of the article, with a good many words in it, so that it is dense and weighs much more than others do."
SHORT = "A short line."
MENU = "<nav><a href=1>Home</a> <a href=2>News</a></nav><div class=sidebar><ul><li><a href=3>One</a><li><a href=4>Two</a></ul></div>"


def page_of(body):
    return f"<html><body>{MENU}{body}<footer>Imprint of the page</footer></body></html>"


@pytest.mark.parametrize(("outer", "inner"), [("article", "section"), ("main", "div"), ("div id=content", "section"), ("article", "section id=s2")])
def test_sections_of_short_paragraphs_stay(outer, inner):
    tag = inner.split()[0]
    sections = [f"<{inner}><h2>First</h2>" + f"<p>{LONG}</p>" * 3, f"<{inner}><h2>Second</h2>" + f"<p>{SHORT}</p>" * 8, f"<{inner}><h2>Third</h2>" + f"<p>{LONG}</p>" * 2]
    text = H.main_text(page_of(f"<{outer}>" + "".join(f"{s}</{tag}>" for s in sections) + f"</{outer.split()[0]}>"))
    assert text.split("\n\n") == ["First", *[LONG] * 3, "Second", *[SHORT] * 8, "Third", *[LONG] * 2]


def test_sentences_made_of_links_stay_and_lists_of_links_go():
    body = f"<article><p>{LONG}</p><p>See <a href=1>the first long source</a> and <a href=2>the second one</a>.</p><p><a href=3>Tag</a> | <a href=4>Other tag</a></p><p>{LONG}</p></article>"
    assert H.main_text(page_of(body)).split("\n\n") == [LONG, "See the first long source and the second one.", LONG]


@pytest.mark.parametrize("wrapper", ["div id=notice", "div class='related promo'", "aside", "div class=popup"])
def test_an_article_within_marked_elements_is_found(wrapper):
    tag = wrapper.split()[0]
    assert H.main_text(page_of(f"<{wrapper}><article><h1>Title</h1><p>{LONG}</p><p>{SHORT}</p></article></{tag}>")).split("\n\n") == ["Title", LONG, SHORT]
    assert H.main_text(page_of(f"<{wrapper}><p>We use cookies.</p></{tag}>")) == ""
