"""op2: pages whose article is known, the importance of style nodes, and the defined cases."""

import random

import pytest
from conftest_llm import prose

from driftlens.llm import style_tree as st

BOILERPLATE = [
    "<nav><ul><li><a href='/a'>Menu {n}</a></li></ul></nav>", "<header class='site'><p>Site title {n}</p></header>",
    "<div class='ad'>Buy {n}</div>", "<aside><p>Side {n}</p></aside>", "<div id='cookie-notice'>Cookies {n}</div>",
    "<form><p>Sign up {n}</p><input><button>Go</button></form>", "<script>var t = '</p>'; if (a < b) track({n});</script>",
    "<style>p{margin:0}</style>", "<!-- <p>hidden</p> -->", "<noscript><p>No script</p></noscript>",
    "<div class='comments'><article class='comment'><p>Reader {n}</p></article></div>", "<div role='navigation'>Crumbs {n}</div>",
]


def page(n, body_first, body_last):
    title, paragraphs = f"Title {n}", [prose(n * 10 + k, 12) for k in range(3)]
    markup = (
        f"<html><head><title>T</title></head><body>{body_first}<article><h1>{title}</h1><p><b>{paragraphs[0]}<br><p>"
        f"{paragraphs[1].replace(' ', '  ', 1)} &amp; &quot;more&quot;&nbsp;x</p>\n<ul><li>one<li>two</ul><p>{paragraphs[2]}</article>{body_last}"
    )
    return markup, "\n".join([title, paragraphs[0], paragraphs[1] + ' & "more" x', "one", "two", paragraphs[2]])


@pytest.fixture(scope="module")
def pages(spark):
    draw, rows, want = random.Random(1), [], {}
    for n in range(60):
        parts = [draw.choice(BOILERPLATE).replace("{n}", str(draw.randint(0, 3))) for _ in range(6)]
        markup, want[n] = page(n, "".join(parts[:3]), "".join(parts[3:]))
        rows.append((n, f"https://h{n % 3}.example.org/{n}", markup))
    return spark.createDataFrame(rows, "page_id long, url string, html string"), want


def test_articles_come_out_whole(pages):
    df, want = pages
    got = st.extract(df).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_unnamed_blocks_that_repeat_on_a_host_go(spark):
    rows = []
    for n in range(12):
        body = f"<div><div>Always the same words here</div><section><p>{prose(n, 30)}</p></section><div>Imprint of us</div></div>"
        rows.append((n, "http://plain.example/" + str(n), f"<body>{body}</body>"))
    rows.append((99, "http://alone.example/", rows[0][2]))
    got = {r.page_id: r.text for r in st.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[n] == prose(n, 30) for n in range(12))
    assert got[99].count("\n") == 2  # one page cannot show that something repeats


def texts_of(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in st.extract(df).collect()}


@pytest.mark.parametrize("tag", ["article", "main", "div class='main'"])
def test_unnamed_blocks_that_repeat_inside_the_article_go(spark, tag):
    rows = []
    for n in range(12):
        body = (
            f"<div>Read this notice first</div><p>{prose(n, 20)}</p><section><p>Buy now</p></section><h2>Results</h2>"
            f"<p>{prose(n + 50, 20)}</p><ul><li>Share it<li>Send it</ul><div>Imprint of us</div>"
        )
        rows.append((n, f"http://plain.example/{n}", f"<body><{tag}>{body}</{tag.split()[0]}></body>"))
    got = texts_of(spark, rows)
    # A heading between two paragraphs is part of the text, a list after the last one is not.
    assert got == {n: f"{prose(n, 20)}\nResults\n{prose(n + 50, 20)}" for n in range(12)}


NAMED = [
    "<body class='no-sidebar'><p>{}</p></body>", "<body class='nav-open'><article><p>{}</p></article></body>",
    "<html class='has-banner'><body class='fixed-header'><main><p>{}</p></main></body></html>",
    "<div class='content-with-sidebar'><p>{}</p></div>", "<div class='content-with-sidebar'><nav>Menu</nav><article><p>{}</p></article></div>",
    "<article class='post has-comments'><p>{}</p></article>", "<main id='main-content' class='page-header'><p>{}</p></main>",
    "<article><h2 id='related-work'>{}</h2></article>", "<body><h2 id='related-work'>{}</h2></body>",
    "<article><section id='login-flow'><p>{}</p></section></article>", "<section id='login-flow'><p>{}</p></section>",
    "<form><p>{}</p></form>", "<aside><article><p>{}</p></article></aside>",
]


@pytest.mark.parametrize("pages", [1, 12])
def test_names_alone_take_no_text_away(spark, pages):
    rows = [(k * 100 + n, f"http://h{k}/", markup.replace("{}", prose(k * 100 + n, 20))) for k, markup in enumerate(NAMED) for n in range(pages)]
    assert texts_of(spark, rows) == {i: prose(i, 20) for i, _, _ in rows}


def test_named_branches_go_when_their_texts_come_back(spark):
    rows = []
    for n in range(24):
        side = f"<div class='ad'>Buy {n % 3}</div><div id='cookie-notice'><p>Cookies {n % 2}</p></div>"
        text = f"<p>{prose(n, 20)}</p>{side}<p>{prose(n + 50, 20)}</p>"
        rows.append((n, "http://bare/", f"<body class='no-sidebar'>{text}</body>"))
        rows.append((n + 100, "http://article/", f"<div class='content-with-sidebar'>{side}<article>{text}</article></div>"))
        comments = f"<div class='comments'><article class='comment'><p>{prose(n + 200, 5)}</p></article></div>"
        rows.append((n + 200, "http://comments/", f"<body>{comments}<article><p>{prose(n, 20)}</p></article></body>"))
    got = texts_of(spark, rows)
    for n in range(24):
        assert got[n] == got[n + 100] == f"{prose(n, 20)}\n{prose(n + 50, 20)}" and got[n + 200] == prose(n, 20)


def test_articles_built_alike_keep_their_own_words(spark):
    rows = []
    for n in range(200):
        extra = "".join(f"<{t}>x{n}</{t}>" for k, t in enumerate(["ul", "ol", "dl", "pre", "table"]) if n < 31 and n + 1 >> k & 1)
        rows.append((n, "http://alike/", f"<article><h1>T{n}</h1><div><p>{prose(n, 20)}</p>{extra}</div></article>"))
    got = texts_of(spark, rows)
    assert all(prose(n, 20) in got[n] for n in range(200))


def test_importance_follows_repetition(spark):
    rows = [(n, "http://h/x", f"<body><section><p>{prose(n, 9)}</p></section><footer><p>same</p></footer></body>") for n in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    values = sorted(r.importance for r in st.importances(df).collect() if r.pages == 8)
    assert values[0] < 0.1 and values[-1] > 0.8


def test_copies_keep_their_article(spark):
    rows = [(n, "http://copies/", f"<article><p>{prose(1, 20)}</p></article>") for n in range(9)]
    rows += [(n, "http://bare/", f"<body><p>{prose(2, 20)}</p></body>") for n in range(10, 19)]
    got = st.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {prose(1, 20), prose(2, 20)}


def test_page_defined_cases(spark):
    schema = "page_id long, url string, html string, host string, nodes int, text string, n_chars int, node long"
    odd = [
        (1, None, None), (2, "", ""), (3, "http://a/", "plain & text <b>bold</b>"), (4, "x", "<p>cut <a href='x"), (5, "x", "<article><p>a<p"),
        (5, "x", "<article><p>a<p"), (None, "x", "<</>>< p>"), (6, "x", "<script>never closed <p>x"), (7, "x", "<div>" * 300 + "deep" + "</div>" * 100),
        (8, "x", "<p>" + "w " * 100_000 + "</p>"), (9, "x", "<p>a&#x41;&#0;&bogus;&am</p></p></div></article>"),
    ]
    df = spark.createDataFrame([(*r, "h", 1, "t", 2, 3) for r in odd], schema)
    got = {}
    for r in st.extract(df).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert sum(map(len, got.values())) == len(odd)
    assert got[1] == got[2] == got[6] == [""] and got[3] == ["plain & text bold"] and got[4] == ["cut"]
    assert got[5] == ["a", "a"] and got[7] == ["deep"] and len(got[8][0]) == 199_999
    assert got[9][0].startswith("aA") and got[9][0].endswith("&bogus;&am")
    assert st.extract(df.limit(0)).count() == 0
