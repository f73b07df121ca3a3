from hypothesis import given, settings
from hypothesis import strategies as st

from rungwise.llm import html_extract


def test_an_advert_does_not_end_running_text():
    long, short = "long words " * 90 + "end.", "Short words " * 8 + "last."
    for open_, close in (("<div>", "</div>"), ("", ""), ("<div><section>", "</section></div>")):
        page = f"<body>{open_}<p>{long}</p><div class='ad'>x</div><p>{short}</p>{close}<nav>z</nav><div><p>Elsewhere</p></div></body>"
        assert html_extract.main_text(page) == f"{long} {short}"
    apart = f"<body><div><p>{long}</p></div><div class='ad'>x</div><div><p>{short}</p></div></body>"
    assert html_extract.main_text(apart) == f"{long} {short}"
    tiny = f"<body><div><p>{long}</p><div class='ad'>x</div><p>So.</p></div><div class='ad'>x</div><div><p>Go on</p></div></body>"
    assert html_extract.main_text(tiny) == f"{long} So."
    links = f"<body><div><p>{long}</p><nav>x</nav><p><a>Only a link here</a></p><nav>y</nav><p>{short}</p></div></body>"
    assert html_extract.main_text(links) == f"{long} {short}"


PARA = "A paragraph of running text that says something at length, so that it counts. "


def test_names_of_the_articles_own_blocks_lose_nothing():
    for head in ('<div class="overflow-hidden">', '<div data-x="hidden gems">', '<div class="page with-sidebar">', '<div class="lead notice-board">', '<div id="toc-1">', '<p class="share-price">', '<p class="ad-hoc">', "<p title=it's>"):
        page = f"<body>{head}{PARA}</div><p>{PARA}isn't it</p></body>"
        assert html_extract.main_text(page).startswith(PARA.strip()) and html_extract.main_text(page).endswith("isn't it"), head
        page = f"<body><article><p>{PARA}</p>{head}Inside.</div><p>End isn't near.</p></article></body>"
        assert html_extract.main_text(page) == f"{PARA}Inside. End isn't near.", head


def test_what_is_no_article_goes():
    for head in ('<div class="ad">', '<div class="cookie-notice">', "<div id=comments>", '<div hidden>', '<div style="display: none">', '<div aria-hidden="true">', '<div class="share-buttons big">', "<div role=search>", '<div class="ad_box">', '<div title="open class=x hidden>'):
        page = f"<body><article><p>{PARA}</p>{head}Away.</div><p>End.</p></article></body>"
        assert html_extract.main_text(page) == f"{PARA}End.", head


def brute_regions(lines):
    """By definition, window by window."""
    size = lambda k: sum(len(lines[j][0]) for j in range(k, min(len(lines), k + html_extract.WINDOW)))
    blocks = [size(k) for k in range(len(lines))]
    out, k = [], 0
    while k < len(lines):
        if blocks[k] == 0:
            k += 1
            continue
        end = k
        while end < len(lines) and blocks[end]:
            end += 1
        if max(blocks[k:end]) >= html_extract.SURGE * max(blocks) or any(x[2] for x in lines[k:end]):
            out.append((k, end))
        k = end
    return out


@given(st.lists(st.tuples(st.sampled_from([0, 0, 0, 0, 1, 3, 50, 200]), st.booleans()), max_size=40))
@settings(max_examples=200, deadline=None)
def test_regions_by_definition(shape):
    lines = [("x" * n, 0, inside and n > 0, 0) for n, inside in shape]
    assert html_extract.regions(lines) == brute_regions(lines)


def test_articles_of_others_go():
    """Reader comments, teasers and menus that hold articles of their own, beside the article or in it."""
    for x in (
        '<section class="comments"><article class="comment"><p>I say so</p></article></section>',
        '<ol class="comment-list"><li class="comment"><article><p>Hm</p></article></li></ol>',
        '<div class="related"><article><a>More</a> teaser</article></div>',
        "<nav><article>Menu</article></nav>",
        '<header><article>Top</article></header>',
        '<div><article class="comment">By a reader</article></div>',
    ):
        assert html_extract.main_text(f"<body><main><article><p>{PARA}</p></article>{x}</main></body>") == PARA.strip(), x
        if not x.startswith("<header"):  # one inside the article is its own
            assert html_extract.main_text(f"<body><article><p>{PARA}</p>{x}</article></body>") == PARA.strip(), x
    for menu in ("<nav><a>menu</a>", "<header>top", "<nav>one<nav>two</nav>"):
        assert html_extract.main_text(f"<body>{menu}<article><p>{PARA}</p></article><nav>z</nav></body>") == PARA.strip(), menu
    assert html_extract.main_text(f'<body><article class="comment"><p>{PARA}</p></article></body>') == PARA.strip()


def test_long_pages_take_linear_time():
    import time

    def took(page):
        began = time.process_time()
        html_extract.main_text(page)
        return time.process_time() - began

    for part, end in (("<b>x</b> ", ""), ("<div>", "</x>"), ("<ul><span>", "<li></li>"), ("<article><nav>", "")):
        short, long = (min(took("<p>" + part * n + end * n) for _ in range(2)) for n in (2_000, 16_000))
        assert long < 30 * short + 0.5, part
