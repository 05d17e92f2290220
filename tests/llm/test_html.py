import re
from collections import Counter

import numpy as np

from tallywright.llm import html, registry

SCHEMA = "page_id long, url string, html string"


def text(page):
    return html.main_text(html.Outline(html.parse(page)))


def test_blocks_references_and_white_space():
    assert text(None) == "" and text("") == "" and text("plain  text\n here") == "plain text here"
    assert text("<p>a<p>b<br>c&nbsp;d &amp; &lt;x&gt; &#233;<div>e<b>f</b>g</div>") == "a\n\nb c d & <x> é\n\nefg"
    assert text("<ul><li>one<li>two</ul><table><tr><td>x<td>y</table>") == "one\n\ntwo\n\nx\n\ny"
    assert text("<p><b>bold<br><p>next</b> tail</p>end") == "bold\n\nnext tail\n\nend"
    assert text("1 < 2 <p>3 <4 </ p>") == "1 < 2\n\n3 <4"


def test_what_is_left_out():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header>h</header><nav>n</nav>
    <div class="cookie-notice">c</div><div class="ad">ad</div><main><article><header><h1>T</h1></header><p>one</p>
    <script>var t="</p>";</script><aside>s</aside><p>two<!-- x --></p><form>f<input></form><div id="comments"><p>c1</p></div>
    <footer>by me</footer></article></main><div role="complementary">r</div><p>outside</p><footer>f</footer>"""
    assert text(page) == "T\n\none\n\ntwo"
    assert text('<div class="header">h</div><div class="post">body<noscript>n</noscript></div><div hidden>x</div>') == "body"
    assert text('<div class="page with-sidebar no-ads"><p>kept</p><div class="main-menu top">m</div></div>') == "kept"
    assert text("<script>never closed <p>x") == "" and text("<p>a<!-- never closed <p>x") == "a"
    assert text("<article>" * 3000 + "deep") == "deep"


def brute_match(a, b):
    """Simple tree matching without shortcuts: (tag, children...) tuples."""
    if a[0] != b[0]:
        return 0
    x, y = a[1:], b[1:]
    m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + brute_match(x[i], y[j]))
    return m[-1][-1] + 1


def test_tree_matching_scores_as_brute_force():
    import random

    rng = random.Random(5)

    def grow(depth):
        return (rng.choice("ab"), *[grow(depth - 1) for _ in range(rng.randrange(4) if depth else 0)])

    def flat(tree, depth=0):
        return [(tree[0], depth), *[x for c in tree[1:] for x in flat(c, depth + 1)]]

    for _ in range(300):
        a, b = ("r", *grow(3)[1:]), ("r", *grow(3)[1:])
        forms = html.Forms()
        fa, fb = (html._Tree([t for t, _ in f], [d for _, d in f], [], forms) for f in (flat(a), flat(b)))
        assert html.tree_match(fa, fb)[0] == brute_match(a, b)


def _page(i, host, extra=""):
    body = f"<div><div>Welcome to {host}</div><p>Story {i} begins here.</p>{extra}<p>It ends {i}.</p><div>All rights reserved.</div></div>"
    return (i, f"http://{host}/p/{i}", body)


def test_constant_texts_of_a_host_are_template(spark):
    rows = [_page(i, "a.example", "<p>more</p>" * (i % 3)) for i in range(20)] + [_page(100, "b.example")]
    rows += [(200 + i, "http://c.example/", "<p>same page</p>") for i in range(9)]
    rows += [(300, None, None), (301, "no url", ""), (302, "http://a.example/p/2", rows[2][2])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 keys", "2 host", "3 text", "4 URL")
    want = {i: f"Story {i} begins here.\n\n" + "more\n\n" * (i % 3) + f"It ends {i}." for i in range(20)}
    for limit in (1_000_000, -1):
        got = {r.page_id: r.text for r in html.extract_text(df, broadcast_limit=limit).collect()}
        assert {i: got[i] for i in range(20)} == want and got[302] == want[2]
        assert got[100] == "Welcome to b.example\n\nStory 100 begins here.\n\nIt ends 100.\n\nAll rights reserved."
        assert got[200] == "same page" and got[300] == "" and got[301] == "" and len(got) == len(rows)
    assert html.extract_text(df.limit(0)).count() == 0


def test_given_pages(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    import html as entities

    for r in registry.op3_html_extraction(spark, sf).collect():
        article = re.search("<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = re.split("</?(?:p|h1)>", article)
        want = [" ".join(entities.unescape(re.sub("<br>", " ", re.sub("</?b>", "", p))).split()) for p in parts]
        assert r.text == "\n\n".join(p for p in want if p) and r.n_chars == len(r.text)


def test_class_words_take_no_content_out_of_an_article():
    kept = ['<div class="share-price">Up by two.</div>', '<section id="widget-theory">Widgets.</section>', '<p class="skip-level">Levels.</p>', '<p class="related-work">Others.</p>']
    assert text(f"<nav>menu</nav><article>{''.join(kept)}</article>") == "Up by two.\n\nWidgets.\n\nLevels.\n\nOthers."
    gone = ['<div class="ad">Buy.</div>', '<section class="comments"><p>Nice!</p></section>', '<div class="big share-buttons">Share</div>', '<form>x</form>']
    assert text(f"<article><p>Text.</p>{''.join(gone)}</article>") == "Text."


def _bare_pages(n, seed=3):
    """(page, content): no landmark, no telling class; menus vary, notices repeat, the foot is constant."""
    rng = np.random.default_rng(seed)
    say = lambda k: " ".join(f"w{x}" for x in rng.integers(0, 5000, k))
    out = []
    for i in range(n):
        body = [say(20) for _ in range(int(rng.integers(2, 6)))]
        menu = "".join(f'<li><a href="/{x}">{say(2)}</a></li>' for x in range(int(rng.integers(2, 7))))
        notice = ["Today is sale day", "Tomorrow is sale day", "No sale this week"][int(rng.integers(0, 3))]
        page = f"<html><body><div><ul>{menu}</ul></div><div><i>{notice}</i></div><div>{''.join(f'<p>{x}</p>' for x in body)}</div><div><span>All rights kept</span></div></body></html>"
        out.append((page, "\n\n".join(body)))
    return out


def test_induction_alone_finds_the_content(spark):
    bare = _bare_pages(40)
    rows = [(i, "http://a.example/x", p) for i, (p, _) in enumerate(bare)]
    other = [f"<html><body><table><tr><td>Same head</td></tr><tr><td><b>{t}</b></td></tr></table></body></html>" for t in ("one", "two", "three", "four", "five", "six")]
    rows += [(100 + i, "http://a.example/y", p) for i, p in enumerate(other)]  # another layout of the host
    for limit in (html.BROADCAST_ROWS, 0):
        got = {r.page_id: r.text for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast_limit=limit).collect()}
        assert all(got[i] == want for i, (_, want) in enumerate(bare))
        assert [got[100 + i] for i in range(6)] == ["one", "two", "three", "four", "five", "six"]


def brute_alignment(a, b):
    """Simple tree matching by its definition: (score, matched texts) of two (tag, children, key) trees."""
    if a[0] != b[0]:
        return 0, ()
    if a[0] == "#":
        return 1, ((a[2], b[2]),)
    best = [[(0, ())] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1]):
        for j, y in enumerate(b[1]):
            n, p = brute_alignment(x, y)
            both = (best[i][j][0] + n, best[i][j][1] + p) if n else (-1, ())
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], both, key=lambda v: v[0])
    return best[-1][-1][0] + 1, best[-1][-1][1]


def _as_tree(node, path="", slot=""):
    """(tag, children, key, slot, linked characters, text) of the blocks, by recursion; text of a run only."""
    path, slot = f"{path}/{node.tag}", f"{slot}/{node.label}"
    kids, run = [], []

    def flush():
        if found := html.clean("".join(t for t, _ in run)):
            kids.append(("#", [], html.text_key(path, found), html.slot_key(slot), sum(len(t.strip()) for t, x in run if x), found))
        run.clear()

    def read(n, linked):
        for c in n.children:
            if isinstance(c, str):
                run.append((c, linked))
            elif c.tag == "br":
                run.append((" ", linked))
            elif c.drop or c.tag in html.BLOCK:
                flush()
                if not c.drop:
                    kids.append(_as_tree(c, path, slot))
            else:
                read(c, linked or c.tag == "a")

    read(node, node.tag == "a")
    flush()
    return (node.tag, kids, 0)


def _runs(tree):
    return [tree] if tree[0] == "#" else [x for c in tree[1] for x in _runs(c)]


def test_templates_match_brute_force(spark):
    pages = [(f"http://h{i % 2}.example/{i}", p) for i, (p, _) in enumerate(_bare_pages(30, 5))]
    pages += [("http://h1.example/again", pages[1][1]), ("http://few.example/", pages[0][1]), (None, None)]
    df = spark.createDataFrame(pages, "url string, html string").selectExpr("1 as page_id", "*")
    got = {(r.host, r.layout): (set(r.constant), set(r.links), set(r.few), set(r.main)) for r in html.induce_templates(html.outlines(df)).collect()}
    want = {}
    for host in ("h0.example", "h1.example"):
        mine = sorted({p for u, p in pages if u and f"//{host}/" in u})
        trees = [_as_tree(html.parse(p)) for p in mine]
        lines = [html.Outline(html.parse(p)) for p in mine]
        assert [[(x[5], x[2], x[3], x[4]) for x in _runs(t)] for t in trees] == [list(zip(o.texts, o.keys, o.slots, o.links)) for o in lines]
        ids = [(sum((o.tags, o.depths) == (x.tags, x.depths) for x in lines), html.text_key(" ".join(o.tags), str(o.depths))) for o in lines]
        top = max(ids)
        typical = min((html.text_key("", p), k) for k, p in enumerate(mine) if ids[k] == top)[1]
        count = Counter(k for t in trees for k in {y for x, y in brute_alignment(trees[typical], t)[1] if x == y})
        slots = {}
        for t in trees:
            for run in _runs(t):
                slots.setdefault(run[3], []).append((run[5], run[4]))
        slots = {k: v for k, v in slots.items() if len(v) >= 5}
        links = {k for k, v in slots.items() if sum(n for _, n in v) >= 0.6 * sum(len(t) for t, _ in v)}
        few = {k for k, v in slots.items() if len({t for t, _ in v}) <= 0.35 * len(v)}
        varies = sorted(((sum(len(x) for x in {t for t, _ in v}), k) for k, v in slots.items() if k not in links | few), key=lambda x: (-x[0], x[1]))
        main = {k for i, (_, k) in enumerate(varies) if sum(n for n, _ in varies[:i]) < 0.8 * sum(n for n, _ in varies)}
        want[host, html.layout(html.parse(mine[0]))] = ({k for k, n in count.items() if n >= 0.8 * len(mine)}, links, few, main)
    assert got == want and all(len(c) + len(k) + len(f) >= 3 and m for c, k, f, m in want.values())


def extracted(spark, pages, host="a.example"):
    rows = [(i, f"http://{host}/{i}", p) for i, p in enumerate(pages)]
    return [r.text for r in sorted(html.extract_text(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r.page_id)]


def _words(rng, k):
    return " ".join(f"w{x}" for x in rng.integers(0, 5000, k))


def test_induction_loses_no_content(spark):
    rng = np.random.default_rng(8)
    menu = '<div><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></div>'
    foot = "<div>All rights kept</div>"
    say = [[_words(rng, 12) for _ in range(6)] for _ in range(8)]
    links = [f"<p>{a} see the <a href='/x'>{b}</a> for details {c}</p><p>{d}</p>" for a, b, c, d, *_ in say]
    got = extracted(spark, [f"<body>{menu}<div>{x}</div>{foot}</body>" for x in links])
    assert got == [f"{a} see the {b} for details {c}\n\n{d}" for a, b, c, d, *_ in say]
    got = extracted(spark, [f"<body>{menu}<div>{links[0]}</div>{foot}</body>"])  # one page: no template at all
    assert f"{say[0][0]} see the {say[0][1]} for details {say[0][2]}" in got[0]
    article = [f"<article><h2>Background</h2><p>{a}</p><p>All figures are in US dollars.</p><h2>Methods</h2><p>{b}</p></article>" for a, b, *_ in say]
    got = extracted(spark, [f"<body>{menu}{x}{foot}</body>" for x in article])
    assert got == [f"Background\n\n{a}\n\nAll figures are in US dollars.\n\nMethods\n\n{b}" for a, b, *_ in say]
    story = [f"<h1>{a}</h1><p>{b}</p><ul>{''.join(f'<li><a href=/{k}>{x}</a></li>' for k, x in enumerate((c, d, e)))}</ul><h2>Summary</h2><p>{f}</p>" for a, b, c, d, e, f in say]
    got = extracted(spark, [f"<body>{menu}<div>{x}</div>{foot}</body>" for x in story])
    assert got == ["\n\n".join([*x[:5], "Summary", x[5]]) for x in say]
    table = [f"<p>{a}</p><table><tr><th>Year</th><th>Sum</th></tr><tr><td>{b}</td><td>{c}</td></tr></table><p>{d}</p>" for a, b, c, d, *_ in say]
    assert extracted(spark, [f"<body>{menu}<div>{x}</div>{foot}</body>" for x in table]) == ["\n\n".join([x[0], "Year", "Sum", *x[1:4]]) for x in say]


def test_story_is_bounded_by_its_main_blocks(spark):
    """Varying adverts and feet outside the story go; a title above it, and a page of one paragraph, stay whole."""
    rng = np.random.default_rng(9)
    say = [[_words(rng, 30) for _ in range(4)] for _ in range(9)]
    ad = lambda i: f"<div>{say[i][3][:25]}</div>"
    got = extracted(spark, [f"<body>{ad(i)}<h1>{i} {a[:9]}</h1><div><p>{a}</p><ul><li>{b}</li></ul><p>{c}</p></div>{ad(i)}</body>" for i, (a, b, c, _) in enumerate(say)])
    assert got == [f"{i} {a[:9]}\n\n{a}\n\n{b}\n\n{c}" for i, (a, b, c, _) in enumerate(say)]
    got = extracted(spark, [f"<body><div>{a}</div><p>{b}</p></body>" for a, b, *_ in say])
    assert got == [f"{a}\n\n{b}" for a, b, *_ in say]
    flat = extracted(spark, [f"<body><div><a href=/>Home</a></div><p>{a}</p><pre>{b}</pre><p>{c}</p><div>{d}</div></body>" for a, b, c, d in say])
    assert flat == ["\n\n".join(x) for x in say]


def test_stories_of_tables_lists_and_sections_stay_whole(spark):
    rng = np.random.default_rng(10)
    say = [[_words(rng, k) for k in (6, 40, 40, 40, 6)] for _ in range(9)]
    foot = lambda i: f"<div>{_words(rng, 3)}</div>"
    table = lambda a, b, c, d, e: f"<p>{a}</p><table><tr><td>{b}</td></tr><tr><td>{c}</td></tr><tr><td>{d}</td></tr></table><p>{e}</p>"
    items = lambda a, b, c, d, e: f"<p>{a}</p><ul><li>{b}</li><li>{c}</li></ul><blockquote>{d}</blockquote><pre>{e}</pre>"
    parts = lambda a, b, c, d, e: f"<section class=first><p>{a} {b}</p></section><section class=second><p>{c}</p><p>{d}</p><p>{e}</p></section>"
    for make, want in ((table, "{0}|{1}|{2}|{3}|{4}"), (items, "{0}|{1}|{2}|{3}|{4}"), (parts, "{0} {1}|{2}|{3}|{4}")):
        got = extracted(spark, [f"<body>{foot(i)}<div>{make(*x)}</div>{foot(i)}</body>" for i, x in enumerate(say)])
        assert got == [want.replace("|", "\n\n").format(*x) for x in say]


def stripped(page):
    """A page without landmarks: their elements are plain divisions, and no class tells anything."""
    page = re.sub(r"<(/?)(?:article|nav|header|footer|aside|main)(?=[\s>])", r"<\1div", page)
    return re.sub(r'\s(?:class|id|role)="[^"]*"', "", page)


def test_given_pages_without_their_landmarks(spark):
    """What induction alone makes of the given pages, against the text that their landmarks bound."""
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()]
    want = {i: html.main_text(html.Outline(html.parse(p))) for i, _, p in rows}
    df = spark.createDataFrame([(i, u, stripped(p)) for i, u, p in rows], SCHEMA).repartition(8)
    got = {r.page_id: r.text for r in html.extract_text(df).collect()}
    same = sum(got[i] == t for i, t in want.items())
    print(f"{same} of {len(rows)} pages alike")
    assert same >= 0.95 * len(rows)


def test_wide_pages_are_aligned_exactly_and_fast():
    import time

    cells = lambda rng: "".join(f"<t{'dh'[int(x)]}>{x}</t>" for x in rng.integers(0, 2, 8))

    def table(seed, rows):
        rng = np.random.default_rng(seed)
        return "<html><body><table>" + "".join(f"<tr>{cells(rng)}</tr>" for _ in range(rows)) + "</table><p>foot</p></body></html>"

    for rows, most in ((300, 0.5), (3000, 10)):
        forms, lines = html.Forms(), [html.Outline(html.parse(table(k, rows))) for k in (1, 2)]
        began = time.perf_counter()
        trees = [html._Tree(o.tags, o.depths, o.keys, forms) for o in lines]
        score, pairs = html.tree_match(*trees)
        assert time.perf_counter() - began < most and score > rows * 8 and trees[0].keys[pairs[-1][0]] == trees[1].keys[pairs[-1][1]]


def test_held_rows_change_no_alignment(monkeypatch):
    rng = np.random.default_rng(2)
    for n, m in ((1, 7), (9, 1), (30, 50), (101, 64)):
        weights, at_x, at_y = rng.integers(0, 4, (6, 5)), rng.integers(0, 6, n), rng.integers(0, 5, m)
        monkeypatch.setattr(html, "HELD_CELLS", 10**9)
        whole = html._aligned(weights, at_x, at_y)
        monkeypatch.setattr(html, "HELD_CELLS", 0)
        assert html._aligned(weights, at_x, at_y) == whole
        row = np.zeros(m + 1, int)
        for r in at_x:
            row = html._next_row(row, weights[r][at_y])
        assert row[-1] == sum(weights[at_x[r], at_y[c]] for r, c in whole)


def test_very_long_pages(spark):
    long = [" ".join(f"x{i}y{k}" for k in range(30_000)) for i in range(6)]
    many = "".join(f"<p>block {k} of the page</p>" for k in range(5_000))
    menu = "<div><ul><li><a href='/'>Home</a></li></ul></div>"
    got = extracted(spark, [f"<body>{menu}<div><h1>{i}</h1><p>{t}</p></div></body>" for i, t in enumerate(long)] + [f"<article>{many}</article>"])
    assert got[:6] == [f"{i}\n\n{t}" for i, t in enumerate(long)] and got[6].count("\n\n") == 4_999
