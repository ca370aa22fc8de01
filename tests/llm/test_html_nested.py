"""Pages whose article is nested, or follows another template than its host's."""

from conformix.llm import html


def texts(spark, pages):
    df = spark.createDataFrame([(i, "https://h.example.org/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in html.extract(df).orderBy("page_id").collect()]


def test_title_and_lead_beside_a_body(spark):
    page = f"<body><article><h1>{'t' * 60}</h1><div class=lead>{'l' * 300}</div><div class=body><p>{'b' * 3000}</p></div></article></body>"
    assert texts(spark, [page] * 3) == ["\n".join(("t" * 60, "l" * 300, "b" * 3000))] * 3


def test_page_of_another_template(spark):
    usual = f"<body><div class=text><p>{'u' * 1000}</p></div></body>"
    other = f"<body><div class=text><p>teaser</p></div><section class=story><p>{'s' * 2000}</p></section></body>"
    assert texts(spark, [usual] * 4 + [other]) == ["u" * 1000] * 4 + ["s" * 2000]


def test_formulas_stay():
    assert html.extract_text("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>") == "so x=2 holds"


PROSE = "Some longer text of an article that says many things, and then more of it. "


def test_wrappers_of_the_article_pass_and_comments_do_not():
    body = f"<p>{PROSE * 3}</p><p>{PROSE * 2}</p>"
    want = (PROSE * 3).strip() + "\n" + (PROSE * 2).strip()
    assert html.extract_text(f"<body><form action=x><article>{body}</article><input name=a></form></body>") == want
    assert html.extract_text(f"<body><div class='search-results-page'>{body}</div><div><p>tiny</p></div></body>") == want
    assert html.extract_text(f"<body><form>{body}</form><form id=login>User <input></form></body>") == want
    assert html.extract_text(f"<body><div class=main>{body}</div><div class=comments><p>{PROSE * 9}</p></div></body>") == want
    assert html.extract_text("<body><form>Name <input> Password <input></form></body>") == ""


def plain(source):
    """Blocks of h1 and p inside the article, by the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        inside, blocks = False, None

        def handle_starttag(self, tag, attrs):
            if tag == "article":
                self.inside, self.blocks = True, []
            elif self.inside and tag in ("h1", "p"):
                self.blocks.append("")
            elif self.inside and tag == "br":
                self.handle_data(" ")

        def handle_endtag(self, tag):
            if tag == "article":
                self.inside = False

        def handle_data(self, data):
            if self.inside and self.blocks:
                self.blocks[-1] += data

    r = Reader()
    r.feed(source)
    return "\n".join(t for t in (" ".join(b.split()) for b in r.blocks or []) if t)


def test_all_given_pages_against_another_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    for r in pages.collect():
        assert got[r["page_id"]] == plain(r["html"] or "")
