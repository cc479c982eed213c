"""Markup that is no text must not take text with it."""

from foliotab.llm.extraction import main_text

LONG = "The old river runs past the quiet mill and over the weir into the valley below the hill, as it always did."


def test_markup_without_end_tag_keeps_the_text():
    for odd in ('<svg viewBox="0 0 1 1"/>', "<math/>", "<!-- <svg> -->", "<!-- <script> -->", "<select>", "<svg><path d='x>y'></svg>", "<template>"):
        assert main_text(f"<article><p>{odd}{LONG}</p><p>End of it.</p></article>") == f"{LONG}\n\nEnd of it.", odd
    assert main_text(f"<article><p>{LONG} <math><mi>a</mi><mo>+</mo><mi>b</mi><annotation>x</annotation></math></p></article>") == LONG + " a+b"
    assert main_text(f"<p>{LONG}</p><script>var s = '<!-- <p>';</script><p>{LONG}</p><style>p") == f"{LONG}\n\n{LONG}"


def test_teaser_articles_and_isolated_ends_are_cut_by_the_distribution():
    body = "".join(f"<p>{LONG} {LONG} {LONG}</p>" for _ in range(4))
    cards = "".join(f"<article><h3>Story {k}</h3><p>A short line on another story of today.</p></article>" for k in range(5))
    adverts = "<div class=ad>Buy</div>" * 4
    page = f"<main><h1>Rivers</h1><article>{body}<div class=ad>Buy</div><p>Short.</p>{adverts}<p>Share it</p></article>{cards}</main>"
    assert main_text(page) == "\n\n".join(["Rivers", *[f"{LONG} {LONG} {LONG}"] * 4, "Short."])
    both = f"<article>{body}</article><article>{body}</article>"
    assert main_text(both).count(LONG) == 24
