"""Hand-written pages with the quirks of real markup: the main text is known, word for word."""

from collections import Counter

import pytest

#: Markup inside an article and the text that it adds, pieces in page order.
QUIRKS = {
    "svg slash": ('<svg class="icon"/>', ""),
    "svg whole": ('<svg viewBox="0 0 1 1"><title>Menu icon</title><path d="M0 0"/><text>drawn</text></svg>', ""),
    "svg unclosed": ('<svg><path d="M0 0">', ""),
    "math slash": ("<math/>", ""),
    "iframe": ('<iframe src="https://example.org/x">Your browser has no frames.</iframe>', ""),
    "iframe unclosed": ('<iframe src="https://example.org/x">', ""),
    "noscript": ("<noscript><p>Please enable scripts to see this page.</p></noscript>", ""),
    "noscript unclosed": ("<noscript>", ""),
    "object unclosed": ('<object data="movie.swf">', ""),
    "object": ('<object data="movie.swf"><p>No player was found.</p></object>', ""),
    "template": ("<template><p>Copied later by a script.</p></template>", ""),
    "select": ("<select><option>First choice<option>Second choice</select>", ""),
    "script": ('<script>if (a < b) document.write("<p>Written by a script.</p>")</script>', ""),
    "style": ("<style>p > a { color: red }</style>", ""),
    "comment": ("<!-- a note <!-- within a note -->", ""),
    "short comment": ("<!-->", ""),
    "bang comment": ("<!-- odd end --!>", ""),
    "conditional comment": ("<!--[if IE]><p>An old browser.</p><![endif]-->", ""),
    "unquoted": ("<p>Read <a href=/x/>the longer story of the town</a> when you have time for it.</p>", "Read the longer story of the town when you have time for it."),
    "stray quote": ("<p title=it's>The mayor's answer came two days later, in writing.</p>", "The mayor's answer came two days later, in writing."),
    "greater than in a value": ('<p data-x="a > b">Numbers were compared by hand at first.</p>', "Numbers were compared by hand at first."),
    "div slash": ("<div/>", ""),
    "paragraph unclosed": ("<p>Nobody closed this paragraph before the next one began.", "Nobody closed this paragraph before the next one began."),
    "line breaks": ("<p>One line of the poem,<br>another line of it,<br/>and the last one.</p>", "One line of the poem, another line of it, and the last one."),
    "references": ("<p>Fish &amp; chips cost &pound;5 &#8211; or &#x35; pounds &lt;cash&gt;.</p>", "Fish & chips cost £5 – or 5 pounds <cash>."),
    "bad reference": ("<p>AT&T and R&D kept their ampersands, as everyone expected.</p>", "AT&T and R&D kept their ampersands, as everyone expected."),
    "misnested": ("<p><b>Bold and <i>slanted</b> words</i> stood side by side in it.</p>", "Bold and slanted words stood side by side in it."),
    "list": ("<ul><li>Bring a coat for the evening.<li>Bring water for the long walk.</ul>", "Bring a coat for the evening. Bring water for the long walk."),
    "table": (
        "<table><tr><td>The harvest of spring<td>was nine tons<tr><td>The harvest of autumn<td>was ten tons</table>",
        "The harvest of spring was nine tons The harvest of autumn was ten tons",
    ),
    "quote": ("<blockquote><p>We never thought of leaving, said the owner of the mill.</p></blockquote>", "We never thought of leaving, said the owner of the mill."),
    "upper case": ("<P>Tags in capitals were common in the first years of the web.</P>", "Tags in capitals were common in the first years of the web."),
    "box": ("<div><p>A paragraph in a plain box is still a part of the story.</p></div>", "A paragraph in a plain box is still a part of the story."),
    "white space": ("<p>\n  Many\t\tblanks   and\n line ends   were typed here.\n</p>", "Many blanks and line ends were typed here."),
    "end tags of nothing": ("</div></span></p></li>", ""),
    "advert": ('<div class="advert"><p>Buy two pairs of shoes and pay for one.</p></div>', ""),
    "share buttons": ('<ul class="share"><li><a href="#a">Send</a></li><li><a href="#b">Post</a></li></ul>', ""),
    "inline links": (
        '<p>The <a href="/bridge">bridge</a> and the <a href="/ferry">ferry</a> were both closed for the winter months.</p>',
        "The bridge and the ferry were both closed for the winter months.",
    ),
    "anchor without end": ('<p><a name="top">The first bell rang before the sun was up that morning.</p>', "The first bell rang before the sun was up that morning."),
    "text area": ("<textarea>typed by a reader</textarea>", ""),
    "wide letters": ("<p>Das Dorf lag ruhig im Schnee, naïve Gäste staunten über die 雪.</p>", "Das Dorf lag ruhig im Schnee, naïve Gäste staunten über die 雪."),
}

TITLE = "The village that kept its mill."
FIRST = "For many years the mill stood empty, and the river ran past it without turning a wheel."
LAST = "In the end the village bought it, and since then bread is baked there again every week."

FRAMES = (
    '<!DOCTYPE html><html><head><title>Mill</title></head><body><nav class="menu"><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li></ul></nav>'
    '<article class="post">{}</article><footer class="footer"><p>All rights reserved by the publisher.</p></footer></body></html>',
    '<body><div id="header"><a href="/">The Daily Example</a></div><div class="content">{}</div>'
    '<div class="sidebar"><h3>Popular</h3><ul><li><a href="/a">Ten walks</a></li><li><a href="/b">Five soups</a></li></ul></div>'
    '<section class="comments"><h3>Replies</h3><div class="comment"><p>I remember that mill well.</p></div></section></body>',
)


@pytest.fixture(scope="module")
def model():
    from skylattice.llm.html_text import fit, sample_pages

    return fit(sample_pages())


def page(frame, quirk):
    markup, adds = QUIRKS[quirk]
    source = FRAMES[frame].format(f"<h1>{TITLE}</h1><p>{FIRST}</p>{markup}<p>{LAST}</p>")
    return source, " ".join(x for x in (TITLE, FIRST, adds, LAST) if x)


@pytest.mark.parametrize("frame", range(len(FRAMES)))
@pytest.mark.parametrize("quirk", QUIRKS)
def test_no_text_is_lost(model, frame, quirk):
    """What frames a quirk is main text on every page: it must all be there, in order."""
    got = model.text(page(frame, quirk)[0])
    assert got.startswith(f"{TITLE} {FIRST}") and got.endswith(LAST)


def test_token_f1_of_labelled_pages(model):
    scores, exact = [], 0
    for frame in range(len(FRAMES)):
        for quirk in QUIRKS:
            source, want = page(frame, quirk)
            got = model.text(source)
            a, b = Counter(got.split()), Counter(want.split())
            scores.append(2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values())))
            exact += got == want
    print(f"pages {len(scores)}, mean token F1 {sum(scores) / len(scores):.4f}, exact {exact}")
    assert len(scores) >= 40 and sum(scores) / len(scores) >= 0.98 and exact >= 0.85 * len(scores)


def test_deep_and_broken_markup_takes_linear_time():
    import time

    from skylattice.llm.html_text import parse

    began = time.process_time()
    for markup in ("<div>", "</div>", "<a>", "<b>", "<li>", "<svg>", "<!--", "<p", "<select>", "</p>", "&", "<td><p>"):
        parse(markup * 20_000 + "text")
    assert time.process_time() - began < 20


def test_pages_that_are_null_empty_repeated_or_long(spark, model):
    from skylattice.llm.html_text import extract

    source, want = page(0, "list")
    long = source.replace("<h1>", "<p>" + "long words go on. " * 50_000 + "</p><h1>")
    rows = [(1, None, "a"), (2, "", "b"), (3, source, "c"), (3, source, "c"), (4, long, "d"), (5, "no markup at all", "e")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = {r["page_id"]: r["text"] for r in extract(pages, model).collect()}
    assert got[1] == got[2] == "" and got[3] == want and got[4].endswith(want) and len(got[4]) > 800_000
    assert extract(pages.limit(0), model).count() == 0
