import html
import random
import re
import time

import pytest

from corpusloom.llm import html_text
from corpusloom.llm.queries import op10_main_text
from tests.conftest import SF

SCHEMA = "page_id long, url string, html string"


def test_query(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op10_main_text(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:h1|p)>", body))
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


@pytest.fixture(scope="module")
def model(spark):
    return html_text.learned(spark.read.parquet(f"{SF}/pages.parquet"))


STORY = [f"Sentence number {i} of the story & its details, told at some length here." for i in range(4)]
BOXES = [
    "<aside class=sidebar><p>Other stories you may like to read some day</p></aside>", '<div class="comments"><p>I do not agree with this story at all</p></div>', "<form><label>Your name please</label><input></form>",
    '<div class="cookie-notice"><p>We use cookies to make this site better</p></div>', "<footer>&copy; someone</footer>", '<header class="site-header">The Daily Something</header>', '<div class="ad">Buy now, only today</div>',
    '<div class="infobox">This page needs more sources</div>', '<div class="notice"><p>This story was changed after it came out</p></div>',
]
FRAMES = [
    "<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<article class="post category-news tag-social">{}</article>', '<div class="content has-sidebar"><article>{}</article></div>',
    '<div class="page-with-tools"><main>{}</main></div>', '<div class="x9 qq"><section>{}</section></div>',
]


@pytest.mark.parametrize("body", ["", ' class="single single-post comments-open"', ' class="q r"'])
def test_other_layouts(model, body):
    """Layouts that the trees didn't see: boilerplate before, after and inside the content, and names of boilerplate on what holds it."""
    shown = [f"<p>{t.replace('&', '&amp;').replace('details', '<b>details</b>').replace('some ', f'some{chr(10)} ')}</p>" for t in STORY]
    start = f"<html><head><title>T</title><style>p{{}}</style></head><body{body}><nav><a href=/>Home</a></nav>"
    end = "<script>var x='</p>';</script></body></html>"
    wrong = []
    for frame in FRAMES:
        for box in BOXES:
            for page in (frame.format("".join(shown)) + box, box + frame.format("".join(shown)), frame.format("".join(shown) + box), frame.format(shown[0] + box + "".join(shown[1:]))):
                wrong += [page] * (html_text.main_text([start + page + end], model) != ["\n\n".join(STORY)])
    assert not wrong


def test_generated_layouts(model):
    """Layouts of other words and seeds: nearly all are right node by node."""
    words = [f"word{i}" for i in range(500)]
    wrong = 0
    for seed in range(200):
        nodes = html_text.parsed(html_text.layout(words, 10**9 + seed))
        score = model([nodes])
        shown = html_text.kept_nodes(nodes, score) & (score > 0)
        wrong += any(x.own and shown[i] != bool(y) for i, (x, y) in enumerate(zip(nodes, html_text.labels(nodes), strict=True)))
    assert wrong <= 10


def test_long_page(model):
    """A page of thousands of paragraphs is read as a whole."""
    story = [f"Paragraph {i} of a very long story that goes on and on." for i in range(4000)]
    page = "<body><nav><a href=/>Home</a></nav><article>" + "".join(f"<p>{t}</p>" for t in story) + "</article><footer>end</footer>"
    assert html_text.main_text([page], model) == ["\n\n".join(story)]


def test_pages_without_content_elements(spark):
    """Their own words make the layouts that are fitted."""
    df = spark.createDataFrame([(i, "u", f"<div><p>Some text number {i} that is long enough to be one</p></div>") for i in range(30)], SCHEMA)
    assert all(r["text"].startswith("Some text") for r in html_text.extract_text(df).collect())


def test_edges(spark, model):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain < text"), (4, "u", "<article><p>a<p>b <br>c &#x41;&nbsp;d</article>"), (4, "u", "<article><p>a<p>b <br>c &#x41;&nbsp;d</article>"), (None, None, "<article><p" + " x" * 20000), (5, "u", "<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", text int").select("page_id", "url", "html", "text")
    out = html_text.extract_text(df, model)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == 7 and (1, "u", "", 0) in got and (2, None, "", 0) in got
    assert got.count((4, "u", "a\n\nb c A d", 10)) == 2
    assert html_text.extract_text(spark.createDataFrame([], SCHEMA)).count() == 0


TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>", re.S)


def test_markup_as_one_pattern():
    """What is found from left to right is what one (quadratic) pattern finds."""
    rng = random.Random(6)
    pieces = ["<a", "<b", ">", '"', "'", " x=", "/", "<!--", "-->", "<![CDATA[", "]]>", "<!", "<?", "</p", " ", "t", "<"]
    for _ in range(3000):
        page = "".join(rng.choice(pieces) for _ in range(rng.randrange(30)))
        want = [(m.start(), m.end(), m[1] or m[4] or "", m[2] or m[5] or "", m[3] or m[6] or "") for m in TOKEN.finditer(page)]
        got, at, markup = [], 0, html_text.Markup(page)
        while found := markup.after(at):
            got.append(found)
            at = found[1]
        assert got == want, page


@pytest.mark.parametrize("piece", ["<![CDATA[", '<a href="', "<a ", "<a '>'", "<b>", "<", "<!--", "<script", "</p>", '<div class="', "<q><div>"])
def test_hostile_markup(piece):
    """1 MB of markup without end is read in about a second, and with an end too."""
    for end in ("", ">", '"'):
        start = time.process_time()
        html_text.parsed(piece * (1_000_000 // len(piece)) + end)
        assert time.process_time() - start < 4


def test_letters_that_grow_in_lower_case(model):
    """U+0130 is longer in lower case; what follows a script stays where it is."""
    page = f"<article><p>{'İ' * 12}</p><script>x</script><p>kept one here</p><SCRIPT>y</SCRIPT><p>kept two here</p></article><p>"
    assert html_text.main_text([page], model) == ["İ" * 12 + "\n\nkept one here\n\nkept two here"]
