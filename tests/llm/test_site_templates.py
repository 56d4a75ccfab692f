import random
import time

import pytest
from llm_help import frame, rows  # noqa: F401

from tallyward.llm import site_templates
from tallyward.llm.site_templates import hash_subtrees, host, parse, pieces


def blocks(html):
    root = parse(html)
    hash_subtrees(root)
    return [text for text, _ in pieces(root)[0]]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<article><h1>T</h1><p>a<b>b</b>\n c<br>d<p>e &amp; f&nbsp;g</article>", ["T", "ab c d", "e & f g"]),
        ("<article><header><h1>T</h1><p>by</p></header><p>x</p><footer>f</footer></article><aside>s</aside>", ["T", "x"]),
        ('<p>n<article><div class="ad-box">buy</div><p>x</p><form>q</form><section id=comments>c</section></article>', ["x"]),
        ("<article><script>a('</p>')</script><style>p{}</style><p>x<!-- <p>no</p> -->y</p></article>", ["xy"]),
        ("<main><nav>m</nav><div role=alert>n</div><ul><li>one<li>two</ul></main>", ["one", "two"]),
        ("<body><header>top</header><p>cut off &am", ["cut off &am"]),
        ("<article><p>cut <di", ["cut"]),
        ("<article><p title='a>b'>x</p><p>1 < 2 &lt; 3</p></article>", ["x", "1 < 2 < 3"]),
        ("<article><p title=don't>x</p><p title=\"it's\">y</p><a href='a>b' x=\">\">z</a></article>", ["x", "y", "z"]),
        ("<p a='>x</p><p>y", ["x", "y"]), ("<p>a<b", ["a"]), ("x > y <z", ["x > y"]), ("<!-- never", []), ("1 <2 <!x", ["1 <2"]),
        ("", []), ("plain", ["plain"]), ("<", ["<"]), ("</p></div>x", ["x"]), ("<article><textarea>t", []),
    ],
)
def test_blocks(html, want):
    assert blocks(html) == want


def test_hosts():
    pairs = {"http://m.a.example.net/en": "a.example.net", "HTTPS://u:p@WWW.A.Example.org:80?x": "a.example.org", None: "", "www.com": "www.com", "//h/x": "h"}
    assert {u: host(u) for u in pairs} == pairs


def page(n, box, body, url="http://site.example.com/"):
    return (n, f"{url}{n}", f"<body><article><h1>T{n}</h1>{box}<div>{body}</div></article></body>")


def test_recurring_boxes_go_and_quoted_paragraphs_stay(spark):
    box, quoted = '<div class="x"><p>Read our rules.</p></div>', "<p>A passage that every article quotes.</p>"
    data = [page(n, box, f"{quoted}<p>own {n}</p>") for n in range(30)]
    data += [page(100 + n, box, "<p>few</p>", "http://other.example.com/") for n in range(2)]
    data += [page(110 + n, box, f"<p>small site {n}</p>", "http://small.example.com/") for n in range(3)]
    data += [(200 + n, "http://copies.example.com/", "<article><h1>Same</h1><div><p>copied page</p></div></article>") for n in range(40)]
    got = {r["page_id"]: r["text"] for r in rows(site_templates.main_text(spark.createDataFrame(data, ["page_id", "url", "html"])))}
    assert got[3] == "T3\n\nA passage that every article quotes.\n\nown 3"
    assert got[101] == "T101\n\nRead our rules.\n\nfew"
    assert got[110] == "T110\n\nsmall site 0"
    assert got[200] == "Same\n\ncopied page" and len(got) == len(data)


def test_odd_rows(spark):
    long = "<article>" + "<div>" * 3000 + "<p>deep</p>" + "<p>w </p>" * 5000 + "</article>"
    data = [(None, None, None, "a"), (1, None, None, "a"), (1, "http://x.y/", "", "a"), (2, "http://x.y/", long, "b"), (2, "http://x.y/", long, "b")]
    frame = spark.createDataFrame(data, "page_id long, url string, html string, text string")
    got = rows(site_templates.main_text(frame), "page_id")
    assert len(got) == 5 and got[0]["text"] == "" and got[0]["n_chars"] == 0
    deep = [r for r in got if r["page_id"] == 2]
    assert len(deep) == 2 and all(r["text"].startswith("deep\n\nw\n\nw") for r in deep)
    assert site_templates.main_text(frame.limit(0)).count() == 0


def test_made_sites_against_brute_force(spark):
    """Sites of known template boxes, with few and many pages, exact and near copies: only these boxes go."""
    rng = random.Random(3)
    data, want = [], {}
    for site in range(12):
        boxes = [f'<section class="k{k}"><p>site {site} box {k}</p><ul><li>a{k}<li>b</ul></section>' for k in range(3)]
        pages = rng.choice([1, 2, 3, 5, 40])
        holds = {k: sum(k <= n % 3 for n in range(pages)) for k in range(3)}
        for n in range(pages):
            own = [f"own {site} {n} {i}" for i in range(3)]
            here = [k for k in range(3) if k <= n % 3]
            body = "".join(f"<div><p>{o}</p>{boxes[k] if k in here else ''}</div>" for k, o in enumerate(own))
            html = f"<body><nav>menu {rng.random()}</nav><article><h1>T {site} {n}</h1>{body}</article></body>"
            for copy in range(rng.choice([1, 1, 4])):  # near copies: another menu around the same article
                doc = len(data)
                data.append((doc, f"https://s{site}.example.net/{n}", html.replace("menu", f"menu {copy}")))
                want[doc] = [f"T {site} {n}"]
                for k, o in enumerate(own):
                    want[doc].append(o)
                    if k in here and holds[k] < site_templates.LEAST_PAGES:
                        want[doc] += [f"site {site} box {k}", f"a{k}", "b"]
    frame = spark.createDataFrame(data, "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: r["text"].split("\n\n") for r in rows(site_templates.main_text(frame))}
    assert got == want


def test_shares_of_counts(spark):
    nav, foot = "<nav><a href=/>home</a></nav>", "<footer>all rights</footer>"
    data = [(n, "http://a.example.com/", f"<body>{nav}<div>ad {n}</div><article><p>t{n}</p></article>{foot}</body>") for n in range(4)]
    data += [(9, "http://b.example.com/", f"<body>{nav}<article><p>t</p></article></body>")]
    [r] = rows(site_templates.shares_of_counts(spark.createDataFrame(data, "page_id long, url string, html string")))
    assert (r["pages"], r["set_aside"], r["by_counts"]) == (5, 9, 8)


@pytest.mark.parametrize("run", ["<a ", "<a'", '<a"', "<a ='", '<a =">', '<b" ="><', "<", "</", "<!", "<!--", ">", "<div>x", "<p>", "<li>", "<p><td>", "<b><i></b>", "=", "<a =''"])
def test_hostile_pages_take_time_in_proportion(run):
    took = []
    for n in (60_000, 480_000):
        html = run * (n // len(run))
        start = time.perf_counter()
        root = parse(html)
        hash_subtrees(root)
        pieces(root)
        took.append(time.perf_counter() - start)
    assert took[1] < 20 * took[0] + 0.5
