"""Pages written by hand, each with the text that it should give."""

from __future__ import annotations

import pytest

from glosslake.llm import main_text

PAGES = {
    "news": (
        '<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/w">World</a></li></ul></nav>'
        "<article><h1>Rivers rise after a week of rain</h1><p>Water levels in the valley rose by two metres on Monday, the regional office said in a statement.</p>"
        "<p>Residents of three villages were asked to leave their homes before the evening.</p></article>"
        '<div class="related"><h3>More news</h3><ul><li><a href="/1">Bridge closed</a></li><li><a href="/2">School opens</a></li></ul></div><footer>Copyright 2024 The Valley Times. All rights reserved.</footer></body></html>',
        ["Rivers rise after a week of rain", "Water levels in the valley rose by two metres on Monday, the regional office said in a statement.", "Residents of three villages were asked to leave their homes before the evening."],
    ),
    "blog with comments": (
        '<body><header class="site-header"><a href="/">My blog</a> <a href="/about">About</a></header><main><div class="post-content"><h1>Baking with rye</h1><p>Rye flour takes up more water than wheat, so the dough feels sticky for most of the time that you work it.</p>'
        '<p>Let it rest for an hour &amp; fold it twice.</p></div><section id="comments"><h2>2 comments</h2><div class="comment"><p>Thanks, this worked well for me!</p></div><div class="comment"><p>Mine stayed flat.</p></div></section></main><footer><p>Subscribe to our newsletter</p></footer></body>',
        ["Baking with rye", "Rye flour takes up more water than wheat, so the dough feels sticky for most of the time that you work it.", "Let it rest for an hour & fold it twice."],
    ),
    "cookie notice": (
        '<div class="cookie-banner"><p>We use cookies to improve your experience.</p><button>Accept</button></div><article><h1>How glass is made</h1><p>Sand, soda and lime are melted together at more than a thousand degrees until no bubbles are left.</p>'
        "<p>The melt is then floated on a bath of tin, where it spreads to an even sheet.</p></article>",
        ["How glass is made", "Sand, soda and lime are melted together at more than a thousand degrees until no bubbles are left.", "The melt is then floated on a bath of tin, where it spreads to an even sheet."],
    ),
    "sidebar and advert": (
        '<body><div id="wrapper"><aside class="sidebar"><h3>Archive</h3><ul><li><a href="/jan">January</a></li><li><a href="/feb">February</a></li></ul></aside><div class="article-body"><h1>A short history of the pencil</h1>'
        '<p>Graphite was found in Cumbria in the sixteenth century and was first used to mark sheep.</p><div class="ad">Advertisement: buy one, get one free!</div><p>Wooden cases came later, when joiners glued two halves around a stick.</p></div></div></body>',
        ["A short history of the pencil", "Graphite was found in Cumbria in the sixteenth century and was first used to mark sheep.", "Wooden cases came later, when joiners glued two halves around a stick."],
    ),
    "lists and quotes": (
        "<main><article><h1>Packing for the hills</h1><p>Three things are worth their weight on any walk of more than a day.</p><ul><li>A dry pair of socks for the evening.</li><li>A map that does not need a battery.</li></ul>"
        "<blockquote><p>There is no bad weather, only the wrong coat.</p></blockquote></article></main><footer><a href='/imprint'>Imprint</a> <a href='/privacy'>Privacy</a></footer>",
        ["Packing for the hills", "Three things are worth their weight on any walk of more than a day.", "A dry pair of socks for the evening.", "A map that does not need a battery.", "There is no bad weather, only the wrong coat."],
    ),
    "login form": (
        '<form action="/login"><label>Name</label><input name=n><label>Password</label><input type=password><button>Log in</button></form><div class="content"><h1>Tides explained</h1><p>The moon pulls on the near side of the earth more strongly than on its centre, and the water follows.</p></div>',
        ["Tides explained", "The moon pulls on the near side of the earth more strongly than on its centre, and the water follows."],
    ),
    "unclosed paragraphs": (
        "<body><article><h2>Bees in winter</h2><p>A colony does not sleep through the cold months.<p>The bees form a cluster and shiver to keep the queen warm.<p>They eat what they stored in summer.</article><footer>All rights reserved</footer>",
        ["Bees in winter", "A colony does not sleep through the cold months.", "The bees form a cluster and shiver to keep the queen warm.", "They eat what they stored in summer."],
    ),
    "comments in the markup": (
        "<article><h1>On <!-- hidden -->maps</h1><p>Every map leaves something out<!--> , and the choice is made by whoever draws it.</p><!-- <p>old text</p> --!><p>A good one says what it leaves out.</p></article>",
        ["On maps", "Every map leaves something out , and the choice is made by whoever draws it.", "A good one says what it leaves out."],
    ),
    "figure and table": (
        "<article><h1>Steel by the year</h1><p>Output grew in both years, but more slowly in the second one than the plan had said.</p><figure><img src=x.png><figcaption>A blast furnace at night.</figcaption></figure><table><tr><td>First year</td><td>Forty tons</td></tr></table></article>",
        ["Steel by the year", "Output grew in both years, but more slowly in the second one than the plan had said.", "A blast furnace at night.", "First year", "Forty tons"],
    ),
    "entities and spaces": (
        "<article><h1>Salt &lt; sugar?</h1>\n<p>  Caf&eacute;s   serve\n both &mdash; in equal&nbsp;bowls.  Nobody knows which one is which until they taste it.</p></article>",
        ["Salt < sugar?", "Cafés serve both — in equal bowls. Nobody knows which one is which until they taste it."],
    ),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_page(name):
    html, want = PAGES[name]
    tree = main_text.parse(html)
    model = main_text.default_model()
    assert main_text.main_blocks(tree, model.marginals([tree])[0]) == want


def test_nothing_to_read(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<nav><a href=x>Home</a></nav><script>x</script>"), (4, None, "<!---->")]
    got = main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), main_text.default_model()).collect()
    assert [(x["page_id"], x["text"], x["n_blocks"]) for x in got] == [(1, "", 0), (2, "", 0), (3, "", 0), (4, "", 0)]
