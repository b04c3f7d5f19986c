import html
import random

import pytest

from voxloom.llm import wrappers


def page(rng, k, layout):
    """(html, main text) of a page in one of several layouts."""
    words = lambda n: " ".join(rng.choice(["the", "é", "loom", "a<b", "x&y", f"w{k}"]) for _ in range(n))
    blocks = [words(rng.randint(3, 40)) for _ in range(rng.randint(1, 6))]
    title = words(4)
    e = html.escape
    body = "".join(f"<p>{e(b)}{rng.choice(['</p>', '', '<br>'])}" for b in blocks)
    nav = "<nav><ul>" + "<li><a href='/x'>menu entry</a></li>" * rng.randint(2, 9) + "</ul></nav>"
    script = "<script>var t='</p><article>';</script><style>p{}</style><!-- <p>no</p> -->"
    comments = "<section id='comments'>" + f"<article class='comment'><p>{words(60)}</p></article>" * rng.randint(0, 3) + "</section>"
    foot = "<aside>see also " + words(50) + "</aside><footer>&copy; host</footer>"
    inner = f"<h1>{e(title)}</h1>{script}{body}"
    if layout == "article":
        made = f"<header>Site name</header>{nav}<div class='ad'>buy</div><article>{inner}<form><p>send</p></form></article>{comments}{foot}"
    elif layout == "content":
        made = f"{nav}<div class='cookie-notice'><p>{words(30)}</p></div><div id='main-col'><div class='post-{k} entry-content'>{inner}<div class='share'>share</div></div>{comments}</div>{foot}"
    else:
        made = f"<div class='top'><a href='/'>home</a></div><div class='c1'><div class='c2'>{inner}</div></div>{foot}"
    return f"<!DOCTYPE html><html><head><title>{e(title)}</title></head><body>{made}" + "</body></html>" * (k % 3 > 0), "\n".join([title, *blocks])


@pytest.mark.parametrize("limit", [1 << 24, 0])
def test_layouts(spark, limit):
    rng = random.Random(7)
    rows, want = [], {}
    for k in range(90):
        layout = ["article", "content", "plain"][k % 3]
        made, text = page(rng, k, layout)
        rows.append((k, f"http://{layout}.example.org/{k}", made, "zz"))
        want[k] = text
    rows += [(100, None, None, "a"), (101, "http://article.example.org/", "", "b"), (102, None, "<p>just <b>this", "c"), (103, "x", "<div", "d"), (3, rows[3][1], rows[3][2], "e")]
    want |= {100: "", 101: "", 102: "just this", 103: ""}
    out = wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), broadcast_bytes=limit).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.text, r.n_chars) == (want[r.page_id], len(want[r.page_id])), r.page_id
    assert wrappers.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_alignment():
    pages = ["<ul><li>a<li>b</ul><p>x", "<ul><li>c</ul><b>new</b><p>y", "<ul><li>c<li>d<li>e</ul><p>z"]
    made = wrappers.infer([wrappers.skeleton(p) for p in pages])
    assert [(k.sign, k.optional, k.repeated) for k in made.kids] == [("ul", False, False), ("b", True, False), ("p", False, False)]
    assert [(k.sign, k.repeated) for k in made.kids[0].kids] == [("li", True)]
    assert made.kids[2].kids[0].fixed is None and len(made.kids[2].kids[0].pages) == 3
    pairs = wrappers.infer([wrappers.skeleton("<dl><dt>a<dd>b<dt>c<dd>d</dl>")])
    assert [k.sign for k in pairs.kids[0].kids] == ["(dt|dd)"]
    again = wrappers.unflat(wrappers.flat(made))
    assert wrappers.flat(again) == wrappers.flat(made)


def longest(a, b):
    rows = [[0] * (len(b) + 1)]
    for x in a:
        rows.append([0])
        for j, y in enumerate(b):
            rows[-1].append(rows[-2][j] + 1 if x == y else max(rows[-2][j + 1], rows[-1][j]))
    return rows[-1][-1]


def test_common_equals_brute_force():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ([rng.choice("abcde"[: rng.randint(1, 5)]) for _ in range(rng.randint(0, 30))] for _ in range(2))
        found = wrappers.common(a, b)
        assert len(found) == longest(a, b) and all(a[i] == b[j] for i, j in found)
        assert all(p < q and r < s for (p, r), (q, s) in zip(found, found[1:], strict=False))


def test_long_lists_are_aligned_whole():
    """One sibling put into a list of 501 (once aligned by position) makes one optional node."""
    signs = [f"x{k}" for k in range(2000)]
    for n in (490, 501, 2000):
        one = [wrappers.Node(s) for s in signs[:n]]
        two = [wrappers.Node(s) for s in [*signs[: n // 2], "new", *signs[n // 2 : n]]]
        made = wrappers.aligned(one, two)
        assert len(made) == n + 1 and [k.sign for k in made if k.optional] == ["new"]


def test_lists_that_do_not_settle_become_a_bag():
    rng = random.Random(4)
    pages = ["<div>" + "".join(rng.choice(["<p>a</p>", "<h2>b</h2>", "<ul>c</ul>", "<pre>d</pre>"]) for _ in range(60)) + "</div>" for _ in range(20)]
    made = wrappers.infer([wrappers.skeleton(p) for p in pages])
    (group,) = made.kids[0].kids
    assert group.sign == "(*" and {k.sign for k in group.kids} == {"p", "h2", "ul", "pre"} and wrappers._counted(made) < 20


def test_deep_pages_are_aligned():
    deep = lambda text: "<div>" * 4000 + f"<p>{text}</p>" + "</div>" * 4000
    made = wrappers.infer([wrappers.skeleton(deep(t)) for t in "abc"])
    node = made
    for _ in range(4001):
        (node,) = node.kids
    assert node.sign == "p" and node.kids[0].fixed is None
    assert wrappers._counted(wrappers.unflat(wrappers.flat(made))) == 4003


def known(*pages):
    return wrappers.decided(wrappers.infer([wrappers.skeleton(p) for p in pages]))


def test_alignment_decides_what_is_main_text():
    """The varying block is the text, the longer one that all pages share is not; a page alone can't tell."""
    notice = "<div class='a'><p>" + "We use your data for many things. " * 20 + "</p></div>"
    pages = [f"<body>{notice}<div class='b'><p>Story {k} of the day, {'and so on ' * k}</p></div></body>" for k in range(1, 6)]
    assert [wrappers.page_text(p, known(*pages)) for p in pages] == [" ".join(f"Story {k} of the day, {'and so on ' * k}".split()) for k in range(1, 6)]
    assert "We use" in wrappers.page_text(pages[0], None)
    inner = [f"<article><h1>T{k}</h1><p>Text {k} {'of it ' * 9}</p><div>Share <b>this</b> page</div></article>" for k in range(4)]
    assert wrappers.page_text(inner[1], known(*inner)).endswith("of it\nShare this page")  # an article's text stays, on however many pages
    assert wrappers.page_text(inner[1], known(inner[1], inner[1], inner[1])).endswith("Share this page")  # one page, three times


@pytest.mark.parametrize("n", [1, 2, 3, 30])
@pytest.mark.parametrize("outer", ["<main>%s</main>", "<article>%s</article>", "<div class='q'>%s</div>", "<body><form action='/'>%s</form></body>", "<div class='post'>%s</div>"])
def test_fixed_parts_of_the_main_text_stay_on_any_number_of_pages(spark, n, outer):
    rows, want = [], {}
    for k in range(n):
        steps = [f"Step {j} of {k} takes {j * k + 1} minutes of stirring" for j in range(4)]
        inner = f"<h1>Recipe {k}</h1><p class='lead'>By the editors of the paper</p><h2>Ingredients</h2><ul><li>{k} eggs</ul><h2>Method</h2>" + "".join(f"<p>{s}</p>" for s in steps)
        rows.append((k, "http://r.example.org/", f"<nav>menu</nav>{outer % inner}<footer>the end</footer>"))
        want[k] = "\n".join([f"Recipe {k}", "By the editors of the paper", "Ingredients", f"{k} eggs", "Method", *steps])
    out = wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == want


def test_small_forms_go_and_page_wide_ones_are_looked_through():
    form = "<form><label>Send us a word</label><input></form>"
    assert wrappers.page_text(f"<article><p>{'text ' * 30}</p>{form}</article>", None) == ("text " * 30).strip()
    assert wrappers.page_text(f"<body><form id='all'><div><p>{'text ' * 30}</p></div></form>{form}</body>", None) == ("text " * 30).strip()


def test_deep_and_unclosed_pages_take_linear_time():
    import time

    for tags in ("<div>", "<p><button><div>", "<table><tr><td><p>", "<li><ul>", "<dl><dd>"):
        began = time.process_time()
        assert sum(e[0] == "open" for e in wrappers.events(tags * 50_000)) == 50_000 * tags.count("<")
        assert time.process_time() - began < 1.5 * tags.count("<")


@pytest.mark.parametrize("alone", [True, False])
def test_names_alone_leave_no_text_out(alone):
    def text(html, k=1):
        made = [html.replace("@", f"{j} once upon a time {'there was a text ' * (j + 2)}") for j in range(4)]
        return wrappers.page_text(made[k], None if alone else known(*made))

    story = "1 once upon a time there was a text there was a text there was a text"
    for outer in ("<body class='single no-sidebar'>%s</body>", "<div id='wrap' class='has-sidebar'>%s</div>", "<article class='post comments-open'>%s</article>", "<article class='promo'>%s</article>", "<div class='content-form'>%s</div>"):
        assert text(outer % "<p>@</p>") == story, outer
    for kept in ("<div class='share-price'>@</div>", "<section class='discussion'>@</section>", "<div class='no-ads'>@</div>", "<header>@</header>"):
        assert text(f"<article><p>@</p>{kept}</article>") == f"{story}\n{story}", kept
    for gone in ("<div class='ad-slot'>buy @</div>", "<section id='comments'><article class='comment'>@</article></section>", "<article class='comment'>@</article>", "<div class='social share'><a href='/x'>@</a></div>", "<aside>@</aside>", "<form>@</form>", "<footer>@</footer>", "<div class='cookieNotice'>@</div>"):
        assert text(f"<article><p>@</p><p>@</p><p>@</p>{gone}</article>") == "\n".join([story] * 3), gone
    assert text("<body><header><h2>Site name and slogan</h2></header><p>@</p></body>") == story
    assert text("<body><nav>menu of the site</nav><div class='content'><header><h1>@</h1></header><p>@</p></div><footer>the end of it all</footer></body>") == f"{story}\n{story}"


def test_all_pages_of_a_host_make_its_wrapper(spark):
    """Each page of twelve layouts is found by its host's wrapper, in any dealing."""
    rows, want = [], {}
    for k in range(120):
        name = "abcdefghijkl"[k % 12]
        rows.append((k, f"http://one.example.org/{k}", f"<body><div class='z'>All rights reserved by us</div><div class='{name}{name}'><p>Text {k} {'of words ' * (k % 7 + 5)}</p></div></body>"))
        want[k] = f"Text {k} {'of words ' * (k % 7 + 5)}".strip()
    rows += [(None, "http://one.example.org/x", rows[0][2]), (None, None, None)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts, held in ((1, 1 << 20), (9, 1 << 20), (3, 30)):
        out = wrappers.main_texts(docs.repartition(parts), held=held).collect()
        assert len(out) == len(rows)
        assert {r.page_id: r.text for r in out if r.page_id is not None} == want
        assert sorted(r.text for r in out if r.page_id is None) == ["", want[0]]


def test_a_pruned_wrapper_loses_no_text(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for k in range(60):
        made, text = page(rng, k, ["article", "content"][k % 2])
        rows.append((k, "http://h.example.org/", made))
        want[k] = text
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (50_000, 12, 3):
        out = {r.page_id: r.text for r in wrappers.main_texts(docs, most_nodes=most).collect()}
        assert all(set(want[k].split()) <= set(out[k].split()) for k in want)


def test_odd_pages():
    assert wrappers.page_text("<article><p>a &amp b&#233;&nbsp;c</p>\n<p> </p>t<br>u<table><tr><td>1<td>2</table><!-- open", None) == "a & bé c\nt u\n1\n2"
    assert wrappers.page_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 10, None) == "deep"
    assert wrappers.page_text("<article>" + "word " * 200_000 + "</article>", None).count("word") == 200_000


def test_a_large_wrapper_keeps_rare_parts(spark):
    name = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    rows = []
    for k in range(16):
        of = name(100 + k)
        inner = "".join(f'<div class="d{name(i)}{of}">' + "".join(f'<p class="p{name(j)}{of}">{i} {j} of {k}</p>' for j in range(44)) + "</div>" for i in range(44))
        rows.append((k, "http://h/", f'<body><article><div class="w{of}"><div class="share"><a href="x">send {k}</a></div>{inner}</div><p>{"words " * 40}{k}</p></article></body>'))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    decisions = lambda **kw: [r.decisions for r in wrappers.wrappers(pages, **kw).collect()]
    whole = decisions()
    assert whole == decisions(most_nodes=10**9) and whole != decisions(most_nodes=50_000)
