import random
from html.parser import HTMLParser

from llm_cases import SF

from palimpsest.llm import html


class Article(HTMLParser):
    """The blocks within the article of the test pages, by the standard parser."""

    def __init__(self, page):
        super().__init__()
        self.inside, self.blocks = False, [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.blocks += [""] if tag in ("h1", "p", "article") else []
        self.blocks[-1] += " " if tag == "br" and self.inside else ""

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.blocks += [""] if tag in ("h1", "p", "article") else []

    def handle_data(self, data):
        self.blocks[-1] += data if self.inside else ""

    def text(self):
        return "\n".join(x for x in (" ".join(b.split()) for b in self.blocks) if x)


def test_pages_match_the_standard_parser(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: (r.url, Article(r.html).text()) for r in pages.collect()}
    assert {r.page_id: (r.url, r.text) for r in html.extracted(pages).collect()} == want


def text(page):
    page = html.Page(page)
    return page.text(page.kept())


def test_what_goes_and_what_stays():
    assert text("<body><nav><ul><li>menu</ul></nav><div class='main-content'><h1>T &amp; é&#233;</h1><p>a\n <b>b</b>c&nbsp;d<p>e<br>f</div><div id=cookie-notice>no</div><form>x</form><aside>y</aside><footer>z</footer>") == "T & éé\na bc d\ne f"
    assert text("<article><p>one</p><section class=comments><p>reader</p></section></article><p>out</p>") == "one"
    assert text("<article><p>one</p></article><article class=comment>reader</article>") == "one"
    assert text("<main>in<script>var a='</p>';</script><style>p{}</style><!-- no <p> --> it</main>out") == "in it"
    assert text("") == "" and text("plain < 3 text") == "plain < 3 text" and text("<p>open") == "open"
    assert text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == "a\nb\nc\nd"
    assert text('<p title="a>b">x</p><div hidden>h</div><div style="display: none">h</div>') == "x"
    assert text("<article><header><h1>T</h1></header><p>x</p></article>") == "T\nx"


def test_site_templates(spark):
    r = random.Random(3)
    rows = []
    for i in range(40):
        own = " ".join(r.choice(["stone", "river", "cloud", "ember"]) + str(r.randrange(99)) for _ in range(30))
        rows.append((i, f"https://a.example/{i}", f"<div><p>Read all we wrote about it</p><p>{own}</p><table><tr><td>Call us</td></tr></table></div>"))
    rows += [(100 + i, f"http://B.example:80/x?{i}", "<p>Same article</p><p>told again</p>") for i in range(60)]
    rows += [(200, None, None), (201, "", "<p>x</p>"), (None, "https://a.example/1", rows[1][2]), (1, rows[1][1], rows[1][2])]
    pages = spark.createDataFrame([(*x, "clash", 1) for x in rows], "page_id long, url string, html string, host string, trees int")
    got = [(x.page_id, x.url, x.text) for x in html.extracted(pages).collect()]
    assert len(got) == len(rows)
    for page_id, _, found in got:
        if page_id is None or page_id < 100:
            assert "Read all" not in found and "Call us" not in found and len(found.split()) == 30
        elif page_id < 200:
            assert found == "Same article\ntold again"
    assert {x[0]: x[2] for x in got if x[0] in (200, 201)} == {200: "", 201: "x"}
    assert html.extracted(pages.limit(0)).count() == 0


def test_raw_text_and_dropped_elements_end_where_they_end():
    assert text("<script>if(i<n){f()}</script><article><p>told</p></article>") == "told"
    assert text("<p>a</p><SCRIPT>x='>';for(i=0;i<n;)y()</Script ><p>b<style>p<q{}</style>c</p>") == "a\nbc"
    assert text("<p>a</p><script src=/js/>if(i<n)g()</script><p>b</p>") == "a\nb"
    assert text("<body><button>Menu<p>told</p><p>on</p>") == "told\non"
    assert text("<div><button>Menu</div><p>told</p><p>x<button>more</button>y</p><button>Go<p>on</p>") == "told\nxy\non"
    assert text("<select><option>a<option>b<p>told</p>") == "told" and text("<div><svg><text>no</div><p>told</p>") == "told"
    assert text("<p>a <select><option>b</option></select>c</p>") == "a c" and text("<noscript><div>no</div><p>no</p></noscript><p>b</p>") == "b"
    assert text("<p>x</p><title>T<p>told</p>") == "x\nT\ntold"


def test_names_are_whole_and_wrappers_stay():
    for inner in ("<h2 id='related-work'>", "<section id='social-impact'>", "<p class='notice-of-motion'>", "<div class='share-prices'>", "<h2 id=related>", "<p id=notice>"):
        assert text(f"<article><p>long enough to be most of the page</p>{inner}kept") == "long enough to be most of the page\nkept"
    assert text("<div class='layout-with-sidebar'><p>told</p></div>") == "told"
    assert text("<div class='sidebar'><p>all that is told</p></div><p>end</p>") == "all that is told\nend"
    assert text("<form action=x><nav>menu</nav><div>told</div></form>") == "told"
    assert text("<form action=x><div>a<article>told</article></div></form><p>a longer text outside of the form</p>") == "told"
    assert text("<header>menu<article>all that is told</article></header>") == "all that is told"
    rest = "<p>long enough to be most of the page, as it should</p>"
    for inner in ("<div class='x sidebar'>", "<div class='ad-container'>", "<div id='social-share'>", "<p class=advert>", "<form>", "<aside>", "<fieldset>", "<div role=search>"):
        assert "kept" not in text(f"{rest}{inner}kept")
    assert text("<p>told</p><div class='comment-list'>readers say much more than the page</div>") == "told"


def test_templates_of_sections_and_small_hosts(spark, monkeypatch):
    r = random.Random(4)
    own = lambda n=30: " ".join(r.choice(["stone", "river", "cloud", "ember"]) + str(r.randrange(999)) for _ in range(n))
    rows = []
    for i in range(60):
        part = ["news", "sport", "blog"][i % 3]
        side = f"<p>The {part} pages are brought to you daily by our desk</p><p>More {part}</p>"
        tail = "<p>Yes.</p>" if i % 10 == 0 else "<footer>These words of many are on some pages of all sections</footer>" if i % 6 == 1 else ""
        rows.append((i, f"https://c.example/{part}/{i}", f"<div><p>{own()}</p></div>{side}{tail}"))
    rows += [(100 + i, f"https://d.example/{i}", f"<p>{own()}</p><p>Call us</p>") for i in range(7)]
    same = [own(20), own(20), own(20), own(20)]
    rows += [(200 + i, f"https://e.example/{i}", f"<p>Day {i}</p>" + "".join(f"<p>{x}</p>" for x in same)) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x.text for x in html.extracted(pages).collect()}
    for i in range(60):
        lines = got[i].split("\n")
        assert len(lines[0].split()) == 30 and lines[1:] == (["Yes."] if i % 10 == 0 else [])
    assert all(len(got[100 + i].split()) == 30 for i in range(7))
    assert all(got[200 + i] == "\n".join([f"Day {i}", *same]) for i in range(30))
    monkeypatch.setattr(html, "MAX_TEMPLATES", 0)
    assert {x.page_id: x.text for x in html.extracted(pages).collect()} == got


def test_inline_elements_have_names():
    rest = "<p>long enough to be most of the page, as it should</p>"
    assert text(f"{rest}<p>a <span class='advert'>buy <b>now</b></span>b</p>").endswith("\na b")
    assert text(f"{rest}<p>a <b>c <i>d<p>e</p>").endswith("\na c d\ne")
    assert text("<p>x<a href=y>link</a>, <em>z</em>.</p>") == "xlink, z."


def brute_templates(pages):
    """(host, subtree) by plain counting of pages."""
    told, sizes = {}, {}
    for url, body in pages:
        page = html.Page(body)
        keep = page.kept()
        name, part = url.split("/")[2].lower(), "/".join(url.split("/")[3:-1][:1])
        blocks = html.others(page, keep)
        for k in range(min(3, len(blocks))):
            for s in ("", part + "/" if part else None):
                sizes.setdefault((name, s, k), set()).add(blocks[k][0])
        for h, first, end, place in page.subtrees(keep):
            inside = {b for b, _ in page.parts[first:end]}
            for k, other in enumerate([x for x, b in blocks if b not in inside][:3]):
                for s in ("", part + "/" if part else None):
                    told.setdefault((name, s, h, place), {}).setdefault(k, set()).add(other)
    found = set()
    for (name, s, h, place), by in told.items():
        n = max(map(len, by.values()))
        pages_of = max(len(x) for (host, part, _), x in sizes.items() if (host, part) == (name, s))
        if n >= html.MIN_PAGES and n >= (max(html.COPIES, html.NEARLY * pages_of) if place == html.IN_ARTICLE else html.SHARE * pages_of) or place == html.LONG_OUTSIDE and s == "" and n >= html.COPIES:
            found.add((name, h))
    return found


def test_counting_against_plain_counting(spark):
    r = random.Random(5)
    own = lambda n: " ".join(r.choice(["stone", "river", "cloud", "ember"]) + str(r.randrange(99)) for _ in range(n))
    menus = [f"<ul class=menu><li><a href=/>{own(1)}</a><li>{own(2)}</ul>" for _ in range(3)]
    notes = [f"<div><span>{own(9)}</span></div>" for _ in range(6)]
    rows = []
    for i in range(150):
        host = ["a.example", "B.example", "c.example"][min(2, r.randrange(6))]
        body = menus[len(host) % 3] + f"<p>{own(20)}</p><p>{own(r.randrange(1, 12))}</p>" + r.choice([*notes, "", ""]) + r.choice(["<p>More news</p>", "", f"<footer>(c) {host}</footer>"])
        rows.append((i, f"https://{host}/{r.choice(['', 'news/', 'blog/'])}{i}", body))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    hosts = {r.host: r.name for r in pages.select(html.host(), html.F.lower(html.F.split("url", "/")[2]).alias("name")).distinct().collect()}
    got = {(hosts[x.host], x.subtree) for x in html.templates(pages).collect()}
    assert got == brute_templates([x[1:] for x in rows]) and len(got) > 5


def test_templates_outside_of_the_main_text_are_counted(spark):
    """What names would drop is counted before they do, and a long note goes wherever it stands."""
    r = random.Random(6)
    own = lambda n=30: " ".join(r.choice(["stone", "river", "cloud", "ember"]) + str(r.randrange(999)) for _ in range(n))
    note = "we use what you read here to tell others what to read"
    rows = [(i, f"https://f.example/{i}", f"<nav><ul><li>Home<li>Call us</ul></nav><article><p>{own()}</p><p>Home</p>{'<p>' + note + '</p>' if i % 2 else ''}</article><footer><p>{note}</p></footer>") for i in range(1, 25)]
    rows += [(100 + i, f"https://f.example/{i}", f"<article><p>{own()}</p></article>") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert html.templates(pages).count() >= 2
    got = {x.page_id: x.text for x in html.extracted(pages).collect()}
    assert all(note not in t for t in got.values()) and all(got[i].endswith("\nHome") for i in range(1, 25))


def test_what_articles_share_stays(spark):
    """A sentence, a heading and inline words in 50 of 60 articles are text; what nearly all have is not, nor a menu."""
    r = random.Random(7)
    own = lambda n=30: " ".join(r.choice(["stone", "river", "cloud", "ember"]) + str(r.randrange(999)) for _ in range(n))
    shared = "<h2>What we found in the course of this year</h2><p>This story is one of several on the <b>river and its many bridges of stone</b> in town.</p>"
    menu = "<div><a href=/>Front page of the daily paper of our town, since long ago</a></div>"
    rows = [(i, f"https://g.example/{i}", f"{menu}<article><p>{own()}</p>{shared if i % 6 else ''}<p>Read more on what the daily paper of our town prints</p></article>") for i in range(60)]
    got = {x.page_id: x.text.split("\n") for x in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(len(got[i]) == (3 if i % 6 else 1) and len(got[i][0].split()) == 30 for i in range(60))
    assert all(got[i][1:] == ["What we found in the course of this year", "This story is one of several on the river and its many bridges of stone in town."] for i in range(60) if i % 6)
