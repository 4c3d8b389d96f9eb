import random
import math
import re
import time
import zlib

import pytest

from tessera.llm import html_text
from tessera.llm.html_text import NAMES, Names

SCHEMA = "page_id long, url string, html string"
NO_NAMES = Names(frozenset(), frozenset(), frozenset())


def text(page, low=()):
    return html_text.main_text(page, set(low))


def extracted(spark, pages, **options):
    rows = [(i, *p) if isinstance(p, tuple) else (i, f"http://one.org/{i}", p) for i, p in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, SCHEMA), **options).collect()}


def prose(rng, n=40):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_blocks_of_an_article(spark):
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>Home</li></ul></nav><div class="ad">buy</div>
    <header>top</header><article><h1>Big &amp; small</h1><p>One <b>two<br>three</p><p>four<div class="comments"><p>me too</p></div><form>mail <input></form><aside>see also</aside>
    <p>caf&eacute; &#8364;&nbsp;5<script>var a = "</p>";</script></article><footer>end</footer></body></html>"""
    assert extracted(spark, [page]) == {0: "Big & small\n\nOne two three\n\nfour\n\ncafé € 5"}


def test_pages_without_an_article_or_without_ends(spark):
    got = extracted(spark, [("http://a.org", "<div class=sidebar>x</div><p>one<p>two <!-- no --> three"), ("http://b.org", '<p hidden>x</p><div role="navigation">y</div><p title="a > b">z</p>')])
    assert got == {0: "one\n\ntwo three", 1: "z"}
    assert text("plain <b>text") == "plain text"
    assert text(None) == "" == text("") == text("<script>never ends")
    assert text("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == "a\n\nb\n\nc\n\nd"


def test_names_of_parts_of_an_article_remove_nothing_by_themselves(spark):
    page = '<article><h2 id="related-work">Related</h2><p>one</p><h2 id="search">Search</h2><p class="notice-text">two</p><div class="share-price">Shares fell by two per cent on the day</div></article>'
    assert extracted(spark, [page]) == {0: "Related\n\none\n\nSearch\n\ntwo\n\nShares fell by two per cent on the day"}


def test_a_teaser_article_does_not_hide_the_story(spark):
    rng = random.Random(1)
    stories = [[prose(rng) for _ in range(rng.randint(1, 5))] for _ in range(12)]
    pages = ["<body><article class=teaser>Read this too</article><div class=story>" + "".join(f"<p>{p}</p>" for p in s) + "</div></body>" for s in stories]
    got = extracted(spark, pages)
    for i, s in enumerate(stories):
        assert got[i].endswith("\n\n".join(s))


def test_letters_that_grow_in_lower_case_do_not_shift_places():
    page = "<article><p>" + "İ" * 12 + "</p><script>x</script><p>after the script</p><STYLE>y</STYLE><p>end</p></article>"
    assert text(page) == "İ" * 12 + "\n\nafter the script\n\nend"


@pytest.mark.parametrize("page", ['<a "' * 20_000, '<a "' * 20_000 + '">"', "<a '\"" * 15_000 + ">", "<div>" * 20_000 + "x", "<ul><li><div>" * 8000, "<" * 100_000, "<!--" * 30_000, "<script>" * 20_000, "<blockquote><p>" * 8000, "</div>" * 50_000, "<div " + "class " * 30_000 + ">x", "<p " + " " * 200_000, "<div></span>" * 20_000])
def test_malformed_pages_take_linear_time(page):
    began = time.process_time()
    text(page)
    list(html_text.features(page))
    assert time.process_time() - began < 5


def test_a_tag_without_an_end_is_text():
    assert text("<p>one < two <b>three</b> and <a four") == "one < two three and <a four"
    assert text('<p title="never closed>one</p><p>two</p>') == "one\n\ntwo"


def template(rng, i, story):
    ps = "".join(f"<p>{p}</p>" for p in story)
    return f'<body><div class="top"><div>{rng.choice(["Home", "News"])}</div></div><div class="hint">We use small files to serve you.</div><div class="body">{ps}</div><div class="end">All rights reserved since {1990 + i % 3}.</div></body>'


def stories(n, seed=3):
    rng = random.Random(seed)
    made = [[prose(rng) for _ in range(rng.randint(1, 6))] for _ in range(n)]
    return made, [template(rng, i, s) for i, s in enumerate(made)]


@pytest.mark.parametrize("n", [4, 30])
def test_the_tree_alone_removes_notices(spark, n):
    made, pages = stories(n)
    got = extracted(spark, pages, names=NO_NAMES)
    assert got == {i: "\n\n".join(s) for i, s in enumerate(made)}


def test_a_host_of_one_page_learns_from_the_others(spark):
    made, pages = stories(30)
    rows = [(f"http://big.org/{i}", p) for i, p in enumerate(pages[:-1])] + [("http://small.org/", pages[-1])]
    assert extracted(spark, rows, names=NO_NAMES)[29] == "\n\n".join(made[29])


def test_copies_count_once(spark):
    made, pages = stories(6)
    rows = [(f"http://one.org/{k}", pages[k % 6]) for k in range(150)]
    assert extracted(spark, rows) == {k: "\n\n".join(made[k % 6]) for k in range(150)}
    alone = extracted(spark, [("http://two.org/", "<div class=box>same line here</div><article><p>the text</p></article>")] * 25)
    assert set(alone.values()) == {"same line here\n\nthe text"}


def brute_importance(pages, names):
    """Importances from the pages' trees, counted plainly: by (host, path) what ``importance`` should give."""
    each = {}
    for host, page in dict.fromkeys(pages):
        blocks, nodes = html_text.parse(page, names)
        shown = [(b, re.sub(r"\s+", " ", b.text())) for b in blocks if not b.never and b.text()]
        total = sum(len(t.split(" ")) for _, t in shown)
        for path in {n.path for n in nodes}:
            under = [t for b, t in shown if path == b.node.path or path in b.node.above]
            own = [n for n in nodes if n.path == path]
            shapes = [tuple(c for i, c in enumerate(n.children) if not i or c != n.children[i - 1]) for n in own]
            share = sum(len(t.split(" ")) for t in under) / total if total else 0.0
            kind = 0 if own[-1].kind == -1 and share > 0.5 else own[-1].kind
            bare = not set(own[-1].children) - {"p", "label", "legend"}
            half = [n for n in nodes if n.kind == 1 and 2 * sum(len(t.split(" ")) for b, t in shown if n.path == b.node.path or n.path in b.node.above) >= total > 0]
            beside = bool(half) and not own[-1].inside and not own[-1].headed and not any(path in (*n.above, n.path) for n in half)
            shapes = ["" if not set(x) - {"p", "label", "legend"} else x for x in shapes]
            each.setdefault(path, []).append((host, under, shapes, share, kind, own[-1].inside, {1: 1.0, 0: 0.5 if bare else 0.6, -1: 0.1}[kind], beside))

    def figure(seen):
        m = len(seen)
        texts = [t for s in seen for t in s[1]]
        spread = [math.log(sum(t in s[1] for s in seen)) / math.log(m) for t in texts] if m > 1 else []
        pages_of = {}
        for s in seen:
            for x in set(s[2]):
                pages_of[x] = pages_of.get(x, 0) + 1
        n = sum(pages_of.values())
        shape = min(1.0, -sum(k / n * math.log(k / n) for k in pages_of.values()) / math.log(m)) if m > 1 else 0.5
        content, share = 1 - sum(spread) / len(spread) if spread else 1.0, sum(s[3] for s in seen) / m
        parts = [content, min(1.0, share / html_text.FULL)] + ([shape] if set(pages_of) != {""} else [])
        mean = sum(parts) / len(parts)
        return m, max(mean, html_text.LOW + 2 * html_text.SHIFT) if share > 0.5 and content >= 0.2 else mean

    out = {}
    for path, seen in each.items():
        all_m, over_all = figure(seen)
        for host in {s[0] for s in seen}:
            mine = [s for s in seen if s[0] == host]
            m, own = figure(mine)
            tree = (m * own + html_text.BACKED * over_all) / (m + html_text.BACKED) if m > 1 else over_all
            expected = sum(s[6] for s in mine) / m
            value = (all_m * tree + html_text.PRIOR * expected) / (all_m + html_text.PRIOR)
            kinds = {s[4] for s in mine}
            value += html_text.SHIFT if 1 in kinds else -html_text.SHIFT if -1 in kinds else 0
            value -= html_text.SHIFT if any(s[7] for s in mine) else 0
            out[host, path] = value - (html_text.HELD if any(s[5] for s in mine) else html_text.LOW)
    return out


def test_importance_against_plain_counts(spark):
    rng = random.Random(5)
    pages = [(f"h{i % 3}", p) for i, p in enumerate(stories(20, 9)[1])]
    for i in range(25):
        parts = rng.sample(["<nav><a>Home</a></nav>", "<div class=ad>buy now</div>", f"<div class='box b{i}'><p>{prose(rng, 5)}</p></div>", f"<article><header>{prose(rng, 3)}</header><div class=note>same note</div><p>{prose(rng)}</p></article>", "<footer>end</footer>"], rng.randint(1, 5))
        pages.append((f"h{rng.randint(0, 4)}", "<body>" + "".join(parts) + "</body>"))
    pages += pages[:5]
    own = brute_importance(pages, NAMES)
    df = spark.createDataFrame([(f"http://{h}/x", p) for h, p in pages], "url string, html string")
    got = {(r["host"], path) for r in html_text.low_paths(df, "url", "html").collect() for path in r["low"]}
    assert got == {k for k, v in own.items() if v < 0} and 5 < len(got) < len(own)
    assert min(abs(v) for v in own.values()) > 1e-9
    assert zlib.crc32(b"") == 0


def test_rows_of_any_kind(spark):
    made, pages = stories(3)
    rows = [(0, None, None, 1, "k"), (1, "http://One.org/a", pages[0], 2, "k"), (1, "http://One.org/a", pages[0], 2, "k"), (None, "no host", "<p>x</p>", 3, None), (4, "http://one.org/b", "", 3, None), (5, "http://one.org/c", "<p>" + "long " * 60_000, 3, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host long, low string")
    got = [tuple(r) for r in html_text.extract(df).collect()]
    assert len(got) == 6 and (0, None, "", 0) in got and (None, "no host", "x", 1) in got and (4, "http://one.org/b", "", 0) in got
    assert got.count(next(r for r in got if r[0] == 1)) == 2 and max(r[3] for r in got) == 299_999
    assert html_text.extract(spark.createDataFrame([], SCHEMA)).count() == 0


WORDS = [f"word{i}" for i in range(4000)]


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def of_hosts(spark, page, n=60):
    """The texts of n pages of one host; page: of a random generator, returns html and the wanted text."""
    rng = random.Random(5)
    made = [page(rng) for _ in range(n)]
    df = spark.createDataFrame([(i, f"http://h.org/{i}", h) for i, (h, _) in enumerate(made)], "page_id long, url string, html string")
    return [r["text"] for r in html_text.extract(df).orderBy("page_id").collect()], [w for _, w in made]


MENU = '<div class="menu"><ul><li><a href="/">Home</a></li><li>News</li><li>About us</li></ul></div>'
FOOT = "<footer><p>All rights reserved by the owner</p></footer>"


def test_pages_inside_a_form_keep_their_article(spark):
    def page(rng):
        a, b = words(rng, 80), words(rng, 60)
        return f'<body><form id="aspnetForm"><input type="hidden" value="x">{MENU}<label>Search</label><input type="text"><button>Go</button><div class="content"><h1>{a[:20].strip()}</h1><p>{a}</p><fieldset><p>{b}</p></fieldset></div>{FOOT}</form></body>', f"{a[:20].strip()}\n\n{a}\n\n{b}"

    got, want = of_hosts(spark, page)
    assert got == want


def test_a_lead_in_a_container_of_its_own_stays(spark):
    for tag in ("", "<p>"):

        def page(rng, tag=tag):
            lead, body = words(rng, 14), [words(rng, 90), words(rng, 90)]
            return f'<body>{MENU}<div class="page"><div class="lead">{tag}{lead}</div><div class="body"><p>{body[0]}</p><p>{body[1]}</p></div></div>{FOOT}</body>', "\n\n".join([lead, *body])

        got, want = of_hosts(spark, page)
        assert got == want


@pytest.mark.parametrize("opens", ['<ol class="commentlist">', '<div class="user-comments">', '<section id="comments-section">', '<div class="comment-wrapper">', '<div id="disqus_thread">'])
def test_readers_comments_go_by_stems(spark, opens):
    end = f"</{opens[1:].split()[0]}>"

    def page(rng):
        text = words(rng, 120)
        said = "".join(f"<li><b>{words(rng, 1)}</b> <time>today</time> {words(rng, 30)}</li>" for _ in range(3))
        return f"<body>{MENU}<article><p>{text}</p></article>{opens}{said}{end}{FOOT}</body>", text

    got, want = of_hosts(spark, page)
    assert got == want


def test_an_opinion_piece_isnt_a_readers_comment(spark):
    def page(rng):
        text = words(rng, 120)
        return f'<body>{MENU}<article class="comment"><h1>{text[:15].strip()}</h1><p>{text}</p><article class="comment-body"><p>{words(rng, 20)}</p></article></article>{FOOT}</body>', f"{text[:15].strip()}\n\n{text}"

    got, want = of_hosts(spark, page)
    assert got == want


def test_a_rotating_advert_beside_an_article_goes(spark):
    def page(rng):
        text = words(rng, 150)
        return f'<body>{MENU}<div class="rot">{words(rng, 9)}</div><article><h1>{text[:12].strip()}</h1><p>{text}</p></article>{FOOT}</body>', f"{text[:12].strip()}\n\n{text}"

    got, want = of_hosts(spark, page)
    assert got == want


def test_one_page_alone(spark):
    essay = words(random.Random(2), 200)
    pages = [
        (f'<body><div class="social"><p>{essay}</p></div></body>', essay),
        *((f'<body><div class="{c}">We value this</div><div class="text"><p>{essay}</p></div></body>', essay) for c in ("cookie-banner", "ad-slot", "gdpr")),
        (f'<body><div style="display: none">secret</div><div aria-hidden="true">secret</div><div><p>{essay}</p></div></body>', essay),
        (f'<body><form><p>Subscribe now</p><input type="email"><button>Go</button></form><div><p>{essay}</p></div></body>', essay),
    ]
    df = spark.createDataFrame([(i, f"http://h{i}.org/", h) for i, (h, _) in enumerate(pages)], "page_id long, url string, html string")
    for i, (_, want) in enumerate(pages):
        assert html_text.extract(df.filter(f"page_id = {i}")).first()["text"] == want, i
