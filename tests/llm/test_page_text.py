import re
from html import unescape

import pytest

from lexispark.llm import page_text as p

SF = "/root/testdata/sf0.01"


def plain(page):
    """The article of a test page, cut out by its tags."""
    m = re.search(r"<article>(.*?)(</article>|<footer|$)", page, re.S)
    blocks = re.split(r"<p>|</p>|</?h1>", m[1])
    blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b)))).strip() for b in blocks]
    return " ".join(b for b in blocks if b)


def test_whole_table(spark):
    rows = {r.page_id: r.text for r in p.query(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    wrong = [r.page_id for r in pages if rows[r.page_id] != plain(r.html)]
    assert wrong == []


def test_without_semantic_names():
    body = "A long sentence, with commas, and stops. Then another one, still going on. "
    page = "<body><div><ul>" + "<li><a href=x>Home</a></li>" * 9 + "</ul></div><div>" + f"<p>{body * 3}</p>" * 4 + "</div><div><span>Terms</span></div></body>"
    text, paths = p.main_text(page)
    assert text == " ".join([(body * 3).strip()] * 4) and paths == ["body/div/p"]


def test_parts_left_out():
    page = "<html><head><title>t</title></head><body><header>top</header><nav>menu</nav><article><h1>T &amp; t</h1><p>One,\n two<b>three</b><script>x</script><p>Four.<div class='comments'><p>reader</p></div><form>f</form></article><aside>s</aside><div class=ad>buy</div><footer>f</footer>"
    assert p.main_text(page)[0] == "T & t One, twothree Four."


def test_edges(spark):
    d = spark.createDataFrame([(1, "u", None, 0), (2, "u", "", 0), (3, None, "plain < text > here & there", 0), (4, "u", "<article>", 0), (5, "u", "<article><p>" + "x " * 200000, 0)], "page_id long, url string, html string, text int")
    got = {r.row.page_id: r.result.text for r in p.extract(d).collect()}
    assert got[1] == got[2] == got[4] == "" and got[3] == "plain < text > here & there" and len(got[5]) == 399999
    assert p.extract(d.limit(0)).count() == 0


BODY = "A long sentence, with commas, and stops. Then another one, still going on. " * 3
MENU = "<nav><ul>" + "<li><a href=x>Home</a></li>" * 9 + "</ul></nav>"


def test_stray_content_classes_leave_the_article():
    for stray in ("<p class='text-lead'>Read more</p>", "<div class=post><p>Next, a teaser.</p></div>"):
        page = f"<body>{MENU}<div>" + f"<p>{BODY}</p>" * 4 + f"</div>{stray}<footer>Terms, all of them.</footer></body>"
        text = p.main_text(page)[0]
        assert text.startswith(" ".join([BODY.strip()] * 4)) and "Home" not in text and "Terms" not in text


def test_wrappers_with_boilerplate_names_keep_the_article():
    article = f"<article><h1>A title of the page</h1>{f'<p>{BODY}</p>' * 4}</article>"
    rest = MENU + "<div class='sidebar'><p>Buy this, now.</p></div>"
    want = " ".join(["A title of the page", *[BODY.strip()] * 4])
    for page in (
        f"<body class='has-sidebar with-comments'>{rest}{article}</body>",
        f"<body><div class='has-sidebar'>{rest}{article}</div></body>",
        f"<body><form action=x>{rest}{article}</form></body>",
        f"<body><div class='page with-comments'><form>{rest}{article}</form></div></body>",
    ):
        assert p.main_text(page)[0] == want


def test_lists_and_headings_of_the_article_stay():
    parts = f"<h1>Title</h1><p>{BODY}</p><h2>Part</h2>" + f"<p>{BODY}</p>" * 4 + "<ul><li>x</li><li>y</li></ul><h3>End</h3><ol><li>z</li></ol>"
    want = " ".join(["Title", BODY.strip(), "Part", *[BODY.strip()] * 4, "x y End z"])
    foot = "<div class='comments'>" + f"<p>{BODY}</p>" * 9 + "</div><div><ul>" + "<li><a href=x>More</a></li>" * 5 + "</ul></div><footer>Terms</footer></body>"
    for tag in ("main", "div", "article", "section"):
        assert p.main_text(f"<body>{MENU}<{tag}>{parts}</{tag}>{foot}")[0] == want
    links = "<div><h4>Related</h4><ul>" + "<li><a href=x>A page of ours</a></li>" * 5 + "</ul></div>"
    assert p.main_text(f"<body>{MENU}<div>{parts}{links}</div>{foot}")[0] == want
    open_body = f"<body>{MENU}<h1>Title</h1><p>{BODY}</p><h2>Part</h2><ul><li>x</li></ul><p>{BODY}</p><div><span>Terms</span></div></body>"
    assert p.main_text(open_body)[0] == f"Title {BODY.strip()} Part x {BODY.strip()}"


@pytest.mark.parametrize("thread", ["<p>{0}</p>", "<article><p>{0}</p></article>", "<div class='comment-body'>{0}</div>", "<li>{0}</li>"])
def test_comments_longer_than_the_article_go(thread):
    said = "<div class='comments'>" + thread.format(BODY) * 8 + "</div>"
    short = "A short piece of news, as they come. It has two sentences."
    for page in (f"<body>{MENU}<article><h1>News</h1><p>{short}</p></article>{said}</body>", f"<body>{MENU}<article><h1>News</h1><p>{short}</p>{said}</article></body>", f"<body>{MENU}<div><h1>News</h1><p>{short}</p></div>{said}</body>"):
        assert p.main_text(page)[0] == f"News {short}"


def test_pages_of_boilerplate_alone_are_empty():
    assert p.main_text(f"<body>{MENU}<footer>{BODY}</footer><div class=comments><p>{BODY}</p></div></body>") == ("", [])


def test_deep_and_long_pages_are_read_in_linear_time():
    import time

    took = []
    for n in (5_000, 40_000):
        began = time.time()
        text, paths = p.main_text("<div>text, more. " * n)
        took.append(time.time() - began)
        assert text == " ".join(["text, more."] * n) and max(map(len, paths)) < 100
    assert took[1] < 24 * took[0] + 0.5
    assert len(p.main_text("<p>" + "word, " * 300_000)[0]) > 1_700_000
