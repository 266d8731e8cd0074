"""Operator 6 on pages whose article is known."""

import random

import pytest

from ledgerprep.llm.html_text import extract, main_text

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def page(rng, body):
    links = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in WORDS)
    return (
        f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>if (a</b>) '</p>'</script></head><body class='has-sidebar'>"
        f"<header><h1>Site</h1></header><nav><ul>{links}</ul></nav><div class='ad-banner'>Buy now. Buy now. Buy now.</div>{body}"
        f"<aside><p>Read also {links}</p></aside><section id='comments'><p>{'A long comment of a reader. ' * 9}</p></section>"
        "<form><label>Mail</label><input></form><footer>&copy; all</footer></body></html>"
    )


@pytest.mark.parametrize("seed", range(30))
def test_article_is_found(seed):
    rng = random.Random(seed)
    blocks = [" ".join(rng.choices(WORDS, k=rng.randint(1, 80))) for _ in range(rng.randint(1, 9))]
    holder = rng.choice(["article", "main", "div", "div class='content'"])
    paragraphs = "".join(rng.choice(["<p>{}</p>", "<p>{}", "<p><b>{}</b></p>\n", "<p><b>{}<br>", "<ul><li>{}</li></ul>"]).format(b) for b in blocks)
    assert main_text(page(rng, f"<{holder}>{paragraphs}</{holder.split()[0]}>")) == "\n\n".join(blocks)


def test_sections_of_one_article_stay_together():
    long, short = "word " * 200, "few words"
    text = main_text(f"<body><nav><a>x</a></nav><article><section><p>{short}</p></section><section><p>{long}</p><p>{long}</p></section><div>end</div></article></body>")
    assert text.split("\n\n") == [short, long.strip(), long.strip(), "end"]


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""), ("", ""), ("   ", ""), ("<html></html>", ""), ("plain &amp; simple", "plain & simple"),
        ("<p>a&nbsp; b\n\tc</p><p> d </p>", "a b c\n\nd"), ("<p>x &lt;b&gt; &#233;&#x41;&amp", "x <b> éA&"),
        ("<p>text<a href=\"/x", "text"), ("<p>one<!-- never closed <p>two", "one"), ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<p>a<script>x", "a"), ("<P>Up</P><DIV HIDDEN>no</DIV>", "Up"), ("<p>a<p>b</div></p>c", "a\n\nb\n\nc"),
    ],
)
def test_odd_pages(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize(
    "html,text",
    [
        ("<p>if x <b it's so</p><p>more</p>", "if x\n\nmore"), ("<p>if x <b it's so</p><p>it's more</p>", "if x\n\nit's more"),
        ("<p>a <a href=/o'neill>b</a> c</p><p>more</p>", "a b c\n\nmore"), ("<p>a <a href=/o'neill>b</a></p><p>it's more</p>", "a b\n\nit's more"),
        ("<p>a <a href=\"/x>b</a></p><p>it's more</p>", "a b\n\nit's more"), ("<p>a</p \"><p>more</p>", "a\n\nmore"),
        ("<p title = 'x > y' lang=en>a</p><p alt=\"it's > so\">b</p>", "a\n\nb"), ("<p =\">a</p><p>\"b\"</p>", "a\n\n\"b\""),
        ("<p title='a'class=\"x>y\">a</p><p data-a=b\"c>b</p>", "a\n\nb"), ("<p title=>a</p><p>b <i 'x", "a\n\nb"),
        ("<p>a</p><p title=\"x>b</p><p>c</p><i class=\"x", "a\n\nb\n\nc"),
    ],
)
def test_quotes_in_tags(html, text):
    assert main_text(html) == text


def test_many_stray_quotes():
    assert main_text("<p>a <b it's so</p>" * 20_000) == "\n\n".join(["a"] * 20_000)
    assert main_text("<p>a</p><p title=\"" * 20_000).startswith("a")


WRAPPERS = [
    "div class='content-sidebar-wrap'", "div class='site has-sidebar'", "div class='no-sidebar'", "div class='comment-open'", "div id='share-enabled'",
    "div class='page-header-active'", "div class='widget'", "div role='dialog'", "form id='aspnetForm' action='/'", "section id='related-work'",
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("holder", ["article", "div"])
def test_layout_named_like_a_notice(wrapper, holder):
    blocks = [" ".join(random.Random(i).choices(WORDS, k=70)) for i in range(6)]
    paragraphs = "".join(f"<p>{b}</p>" for b in blocks)
    tag = wrapper.split()[0]
    assert main_text(page(None, f"<{wrapper}><{holder}>{paragraphs}</{holder}></{tag}>")) == "\n\n".join(blocks)
    assert main_text(f"<{wrapper}>{page(None, paragraphs)}</{tag}>") == "\n\n".join(blocks)
    assert main_text(f"<body><{wrapper}><{holder}>{paragraphs}</{holder}><div class='ad'>Buy now</div></{tag}></body>") == "\n\n".join(blocks)


def test_sections_of_one_layout_name_stay():
    blocks = [" ".join(WORDS * n) for n in (5, 3, 1, 9)]
    assert main_text("".join(f"<div class='row content-sidebar-wrap'><p>{b}</p></div>" for b in blocks)) == "\n\n".join(blocks)


def test_ids_of_headings_and_topics():
    text = " ".join(WORDS * 8)
    parts = [("<h2 id='social-effects'>Social effects</h2>", "Social effects"), (f"<p id='notice'>{text}</p>", text), ("<h3 id='comments'>On comments</h3>", "On comments")]
    parts += [(f"<section id='related-work'><h2>Related work</h2><p>{text}</p></section>", f"Related work\n\n{text}"), (f"<p>{text}</p>", text)]
    html, blocks = zip(*parts, strict=True)
    assert main_text(page(None, f"<div>{''.join(html)}</div>")) == "\n\n".join(blocks)


def test_named_parts_beside_and_in_an_article_are_left_out():
    text = " ".join(WORDS * 8)
    inner = f"<p>{text}</p><div class='share-box'>Share</div><span class='ad'>Buy</span><form>Your mail <input></form><p>{text}</p>"
    outer = "<div class='site-footer'>Imprint</div><div id='comments' class='comments-area'><article><p>No!</p></article></div>"
    for holder in ("article", "div"):
        assert main_text(f"<body><{holder}>{inner}</{holder}>{outer}</body>") == f"{text}\n\n{text}"


def test_deep_and_long_pages():
    assert main_text("<div>" * 20_000 + "deep") == "deep"
    assert len(main_text("<p>" + "long " * 300_000)) == 1_499_999


def test_rows(spark):
    rows = [(1, "u", "<p>x</p>", "k"), (1, "u", "<p>x</p>", "k"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(map(tuple, extract(df).collect()), key=repr) == sorted([(1, "u", "x"), (1, "u", "x"), (None, None, "")], key=repr)
    assert extract(df.limit(0)).collect() == []
