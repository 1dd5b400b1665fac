import pytest

from corvidex.llm import htmltext as H

LONG = "word " * 40


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("<p></p><div> </div>", ""),
        ("plain text", "plain text"),
        ("<p>just A&amp;B<br>x &nbsp;\n y</p>", "just A&B x y"),
        ("<p>cut &am", "cut &am"),
        ("<p>text</p><div class=\"ad", "text"),
        ("<article><p>one<p>two</article>", "one\n\ntwo"),
        ("<article><h1>T</h1><p>a <b>b</b></p></article><footer>&copy; x</footer>", "T\n\na b"),
        ('<script>var t="</p>";</script><article><p>a</p></article>', "a"),
        ("<!-- <p>no</p> --><style>p{}</style><article>a</article>", "a"),
        (f"<nav><a>m</a></nav><div id=main><p>{LONG}</p><p>end</p></div><div class='user-comments'><p>{LONG}</p></div>", LONG.strip() + "\n\nend"),
        (f"<article><p>{LONG}</p><form>mail</form><aside>more</aside><p class=notice>we use cookies</p><p>tail</p></article>", LONG.strip() + "\n\ntail"),
        (f"<header>Site</header><div><p>{LONG}</p></div><div class='sidebar'>{LONG}</div>", LONG.strip()),
        (f"<article><header><h1>T</h1></header><p>{LONG}</p></article>", "T\n\n" + LONG.strip()),
        (f"<article><p>{LONG}</p><section class=comments><article><p>{LONG * 3}</p></article></section></article>", LONG.strip()),
        (f"<ul><li><a>one</a></li><li><a>two</a></li></ul><p>{LONG}</p>", LONG.strip()),
        ("<p>a < b and c > d</p>", "a < b and c > d"),
    ],
)
def test_pages(page, want):
    assert H.extract(page) == want


def test_long_page():
    page = "<article>" + "<p>some text here</p>" * 20000 + "</article>"
    assert H.extract(page) == "\n\n".join(["some text here"] * 20000)


def test_column(spark):
    df = spark.createDataFrame([(1, "u", "<p>x</p>"), (1, "u", "<p>x</p>"), (None, None, None)], "page_id long, url string, html string")
    assert sorted(H.extract_column(df).collect(), key=str) == sorted([(None, None, "", 0), (1, "u", "x", 1), (1, "u", "x", 1)], key=str)
    assert H.extract_column(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        H.extract_column(df.withColumn("text", df.url))


def test_pages_of_the_tables(spark):
    import html
    import re

    from corvidex.llm.queries import op4_html

    d = "/root/testdata/sf0.01"
    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    for r in op4_html(spark, d).collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", source[r["page_id"]], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>?", "", x)).split()) for x in re.split(r"</?p>|</?h1>", inside)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<div class=entry-content><p>{LONG}</p></div><div class=ad>buy</div><div class=entry-content><p>{LONG * 2}</p><p>end</p></div>", [LONG, LONG * 2, "end"]),
        (f"<main><p>{LONG}</p><article><p>{LONG * 2}</p></article></main>", [LONG, LONG * 2]),
        (f"<main><p>lead</p><article><p>{LONG * 2}</p></article></main><p>{LONG}</p>", ["lead", LONG * 2]),
    ],
)
def test_text_that_spans_containers(page, want):
    assert H.extract(page) == "\n\n".join(x.strip() for x in want)


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<div class=content-sidebar-wrap><main><p>{LONG}</p></main><div class=sidebar>{LONG}</div></div>", LONG),
        (f"<body class=with-sidebar><div class=with-sidebar><p>{LONG}</p></div></body>", LONG),
        (f"<div class=with-sidebar>{LONG}", LONG),
        (f"<h1>T</h1><article class=no-comments><p>{LONG}</p></article>", LONG),
        (f"<body><form action=x><div class=with-sidebar><nav>m</nav><article><p>{LONG}</p></article></div></form></body>", LONG),
        (f"<article><p>{LONG}</p></article><div class=comments><p>{LONG * 9}</p></div>", LONG),
        (f"<p>{LONG}</p><div class=user-comments><p>{LONG * 9}</p></div>", LONG),
        (f"<p>{LONG}</p><div hidden><main><p>{LONG * 9}</p></main></div>", LONG),
    ],
)
def test_wrappers_of_the_text(page, want):
    assert H.extract(page) == want.strip()


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<p>{LONG}<span class="advert">BUY <span>now</span> CHEAP</span> end</p>', [LONG + "end"]),
        (f'<p>{LONG}<span class="advert">BUY <b>now</b><p>{LONG}</p>', [LONG, LONG]),
        (f'<ul><li>{LONG}<i class="ad">BUY<li>{LONG}</ul>', [LONG, LONG]),
        (f"<p>{LONG}</p><p><a href=x>one link</a></p><p>{LONG}</p>", [LONG, "one link", LONG]),
        (f"<p>{LONG}</p><p><a>1</a></p><p><a>2</a></p><p><a>3</a></p>", [LONG]),
        (f"<main><article><p>{LONG}</p></article><article><p>{LONG * 2}</p></article></main>", [LONG, LONG * 2]),
        (f"<main><article><p>{LONG}</p></article><div class=ad>buy</div><article><p><a>1</a></p><p><a>2</a></p><p><a>3</a></p><p>end</p></article></main><p>{LONG}</p>", [LONG, "1", "2", "3", "end"]),
        ("<nav><a>m</a></nav><article><ul><li><a>one</a></li><li><a>two</a></li></ul></article><footer>f</footer>", ["one", "two"]),
        ("<ul><li><a>one</a></li></ul>", []),
        ("<main><ul><li><a>one</a></li><li><a>two</a></li></ul></main>", ["one", "two"]),
        (f"<main><p>lead</p><article><p>{LONG}</p></article><ul>{'<li><a>other</a></li>' * 5}</ul><article><p>more</p></article></main>", ["lead", LONG, "more"]),
    ],
)
def test_nothing_else_is_dropped(page, want):
    assert H.extract(page) == "\n\n".join(x.strip() for x in want)


def test_line_blocks_against_brute_force():
    """Pages that mark no article: what surges and dives, from the definition, over blocks whose lengths are known."""
    import random

    draw = random.Random(5)
    for _ in range(400):
        blocks, page = [], []
        for _ in range(draw.randint(1, 30)):
            plain, link = draw.choice(((0, 9), (0, 40), (5, 0), (30, 6), (120, 0), (300, 12), (1, 1)))
            words = "x" * plain + (" " if plain and link else "") + "y" * link
            blocks.append((words, len(words) - link))
            inner = "x" * plain + (" " if plain and link else "") + (f"<a href='/q'>{'y' * link}</a>" if link else "")
            page.append(draw.choice(("<p>%s</p>", "<div>%s</div>", "<p>%s", "<h2>%s</h2>\n", "<ul><li>%s</li></ul>", "<div><div><p> %s\n</p></div></div>")) % inner)
        window = [sum(n for _, n in blocks[i : i + H.WINDOW]) for i in range(len(blocks))]
        least = min(H.THRESHOLD, max(window) / 2)
        surges = [i for i in range(len(blocks)) if window[i] >= least and blocks[i][1] and max(window)]
        want = [i for i in range(len(blocks)) if any(s <= i and all(window[s : i + 1]) for s in surges)]
        assert H.extract("<html><body>" + "".join(page)) == "\n\n".join(blocks[i][0] for i in want)
