import re
from html import unescape

import pytest

from cellforge.llm.html_extract import blocks_of, content_paths, extract_main_text, main_text, op7_html_extraction, path_scores

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no, no.";</script><style>p{}</style></head>
<body><header><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies, sorry.</div>
<div class="page with-sidebar"><article><header><h1>Title &amp; more</h1><p class=byline>by X</p></header>
<p>First&nbsp;paragraph, <b>bold <i>and</i></b>  wide
 text&#33; <p>Second one<br>with a <a href="#">link</a>, here.
<ul><li>Item one<li>Item two</ul><h2>Part</h2><blockquote>Quoted, &lt;b&gt; text.</blockquote><pre>x  y</pre>
<table><tr><td>c1<td>c2</tr></table><div class="ad">Buy now!</div><form>Mail: <input><button>Go</button></form>
<section id="comments"><p>A reader writes, at length, that this is good.</p></section></article>
<aside>Related things, many.</aside></div><!-- <p>hidden, text</p> --><footer>&copy; 2020, all rights.</footer></body></html>"""


def test_everything_of_the_article_and_nothing_else():
    assert main_text(PAGE).split("\n") == [
        "Title & more", "First paragraph, bold and wide text!", "Second one with a link, here.", "Item one", "Item two", "Part", "Quoted, <b> text.", "x y", "c1", "c2",
    ]


def test_broken_and_empty_pages(spark):
    assert main_text(None) == main_text("") == main_text("<p>") == main_text("<!-- x") == main_text("<script>a") == ""
    assert main_text("plain words, only") == "plain words, only"
    assert main_text("<article><p>One two three, four.<p>Five six <b>seven, eight. <p>Cut here &am") == "One two three, four.\nFive six seven, eight.\nCut here &am"
    assert main_text("<body><p>A long enough paragraph, yes.</p><p>Another one, too.</p><a href='x") == "A long enough paragraph, yes.\nAnother one, too."
    long = "<article>" + "<p>word, word</p>" * 50_000
    assert main_text(long).count("\n") == 49_999
    rows = [(1, "u", PAGE, "k"), (1, "u", PAGE, "k"), (None, None, None, None), (2, "v", "", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_main_text(df).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, len(main_text(PAGE)), len(main_text(PAGE))]
    assert extract_main_text(df.limit(0)).count() == 0


def test_pages_against_their_template(spark, sf):
    """The fixed pages hold their article in one element whose blocks are paragraphs and one heading."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in op7_html_extraction(spark, sf).collect()}
    assert set(got) == set(pages)
    for i, html in pages.items():
        inner = re.sub(r"<[^>]*$", "", html[html.find("<article>") + 9 :].split("</article>")[0])
        parts = (re.sub(r"\s+", " ", unescape(re.sub(r"</?b>|<br>", "", s))).strip() for s in re.split(r"</?(?:p|h1)>", inner))
        assert got[i] == "\n".join(p for p in parts if p)


def test_articles_and_class_words_are_only_evidence():
    body = "".join(f"<p>Paragraph {i} of the main text, which is long enough to count, with commas.</p>" for i in range(6))
    lines = [f"Paragraph {i} of the main text, which is long enough to count, with commas." for i in range(6)]
    got = main_text(f"<body><div>{body}</div><article class=card><h3>Teaser</h3><p>A short teaser, here.</p></article></body>")
    assert got.split("\n")[:6] == lines
    parts = body.split("</p>")[:-1]
    got = main_text("<body><div>" + "".join(f"<article>{x}</p></article>" for x in parts) + "</div></body>")
    assert got.split("\n") == lines
    assert main_text(f"<body><div class='elementor-widget'><article>{body}</article></div></body>").split("\n") == lines
    assert main_text(f"<body><div class=post>{body}<div class=share><p>Share this, now.</p></div></div></body>").split("\n") == lines


PROSE = [f"Sentence {i} of the text, which goes on for a while, with commas, and ends here." for i in range(8)]
#: Pages without <article>, <main> or class words that tell: only the ratios of their paths can.
SHORT = [f"Entry {i}" for i in range(30)]
UNMARKED = [
    "<body><div>" + "".join(f"<div>{x}</div>" for x in SHORT) + "</div><div>{}</div><div><div>Latest</div><div>Contact</div><div>Imprint</div></div></body>",
    "<body><table><tr><td class=a>" + "<br><br>".join(SHORT[:12]) + "<td class=b>{}<td class=c>Weather: sun</table></body>",
    "<body><div class=x1>Short line</div><div class=x2><div class=x3>{}</div><div class=x4>" + "".join(f"<span class=y>{x}</span><hr>" for x in SHORT) + "</div></div></body>",
    "<body><section>Log in</section><section>{}</section><section><ul>" + "".join(f"<li>{x}" for x in SHORT) + "</ul></section></body>",
]


def test_ratios_decide_on_pages_without_marks():
    body = "".join(f"<p>{x}</p>" for x in PROSE)
    changed = 0
    for page in UNMARKED:
        html = page.replace("{}", body)
        assert main_text(html).split("\n") == PROSE, page
        changed += main_text(html, ratios=False) != main_text(html)
    assert changed == len(UNMARKED)


def test_class_words_take_no_article_away():
    body = "".join(f"<p>{x}</p>" for x in PROSE)
    for name in ("legal-analysis", "search-engines", "sidecar-proxies", "market-share-data", "reply-all"):
        for attr in ("class", "id"):
            assert main_text(f"<body><p>Stray one.</p><div {attr}='{name}'>{body}</div></body>").split("\n")[-8:] == PROSE
    # all of the text below such a word is the text; beside other text it is not
    assert main_text(f"<body><div class='comments'>{body}</div></body>").split("\n") == PROSE
    for name in ("comments", "comment-list", "article-comments", "cookie-notice", "related-posts", "share-buttons", "ad", "newsletter-box", "sidebar", "relatedPosts"):
        html = f"<body><div class=text>{body}</div><div class='{name}'>" + "".join(f"<p>A remark, {i}, that is not of the article, but long, too, and with commas.</p>" for i in range(20)) + "</div></body>"
        assert main_text(html).split("\n") == PROSE, name
    links = "<ul>" + "".join(f"<li><a href=/{i}>Source {i}</a></li>" for i in range(3)) + "</ul>"
    got = main_text(f"<article>{body}{links}{body}</article>").split("\n")
    assert got == PROSE + [f"Source {i}" for i in range(3)] + PROSE


def test_title_before_the_text():
    body = "".join(f"<p>{x}</p>" for x in PROSE)
    assert main_text(f"<body><div><h1>The title</h1></div><div>{body}</div></body>").split("\n") == ["The title", *PROSE]
    assert main_text(f"<body><header><h1>Site</h1></header><div>{body}</div></body>").split("\n") == PROSE


def test_path_scores_against_a_plain_version(spark, sf):
    """The fixed pages with their marks taken out, by a second parser and plain sums over paths."""
    import math
    import unicodedata
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.way, self.blocks, self.text, self.skip = [""], [], "", 0

        def close_block(self):
            if t := re.sub(r"\s+", " ", self.text).strip():
                self.blocks.append(("/".join(self.way), t))
            self.text = ""

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style", "title", "nav", "footer"):
                self.skip += 1
            elif tag == "br":
                self.text += " "
            elif tag not in ("b", "meta", "a", "html", "head", "body"):
                self.close_block()
                if tag == "p" and self.way[-1:] == ["p"]:
                    self.way.pop()
                self.way.append(tag)

        def handle_endtag(self, tag):
            if tag in ("script", "style", "title", "nav", "footer"):
                self.skip -= 1
            elif tag in self.way:
                self.close_block()
                while self.way.pop() != tag:
                    pass

        def handle_data(self, data):
            if not self.skip:
                self.text += data

    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    several = 0
    for html in pages:
        html = re.sub(r"<(/?)article>", r"<\1div>", html.replace(' class="ad"', ""))
        html = re.sub(r"<[^>]*$", "", html)
        p = Plain()
        p.feed(html)
        p.close()
        p.close_block()
        sums = {}
        for path, t in p.blocks:
            x = sums.setdefault(path, [])
            x.append((len(t), sum(unicodedata.category(c)[0] == "P" for c in t)))
        ratio = {k: [sum(y[c] for y in v) / len(v) for c in (0, 1)] for k, v in sums.items()}
        smooth = {k: [0.0, 0.0] for k in sums}
        for i, (path, _) in enumerate(p.blocks):
            near = [(math.exp(-((i - k) ** 2) / 2), ratio[p.blocks[k][0]]) for k in range(len(p.blocks)) if abs(i - k) <= 2 and p.blocks[k][0].rsplit("/", 1)[0] == path.rsplit("/", 1)[0]]
            for c in (0, 1):
                smooth[path][c] += sum(g * r[c] for g, r in near) / sum(g for g, _ in near) / len(sums[path])
        score = {k: (ratio[k][0] + smooth[k][0]) / 2 * (0.25 + (ratio[k][1] + smooth[k][1]) / 2) for k in sums}
        mean = sum(score[k] * len(t) for k, t in p.blocks) / max(1, sum(len(t) for _, t in p.blocks))
        want = [t for k, t in p.blocks if score[k] >= 0.2 * mean]
        found = blocks_of(html)
        assert [b.text for b in found] == [t for _, t in p.blocks]
        content = content_paths(found)
        several += len(path_scores(found)) > len(content)
        assert [b.text for b in found if b.node.path in content] == want
    assert several > 5


@pytest.mark.parametrize("n", [1, 480, 520, 20_000])
def test_comments_never_stand_for_a_short_article(n):
    comment = "A reader writes here, at length. " * (n // 33 + 1)
    for name in ("comments-area", "newsletter", "ad-slot"):
        page = f'<html><body><article><p>Short story.</p></article><div class="{name}"><p>{comment[:n]}</p></div></body></html>'
        assert main_text(page) == "Short story."
    # without marks the ratios decide, and a named element counts less but is not shut out
    assert "A reader" in main_text(f'<html><body><div class="comments-area"><p>{comment}</p></div></body></html>')
