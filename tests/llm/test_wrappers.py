import random

from sylva.llm import wrappers as m


def aligned(pages):
    """The wrapper of pages, aligned one after the other and through its stored form."""
    w = None
    for p in pages:
        w = m.both(w, m.wrapper_of(m.parse(p)))
        assert m.dumped(m.loaded(m.dumped(w))) == m.dumped(w)
    return w


def extracted(pages):
    """The texts of a host's pages by their common wrapper."""
    with m.deep():
        top = m.compiled(aligned(pages))
        return [m.extract(m.parse(p), top) for p in pages]


def alone(page):
    return extracted([page])[0]


def page(rng, title, paragraphs, template):
    text = "".join(p if p.startswith("<") else f"<p>{p}</p>" for p in paragraphs)
    nav = "".join(f"<li><a href='/{w}'>{w}</a>" for w in rng.sample("home news about mail shop".split(), rng.randrange(2, 5)))
    if template == 0:
        return f"<!DOCTYPE html><html><head><title>{title}</title><script>if (a<b) '</p>'</script></head><body><nav><ul>{nav}</ul></nav><div class='ad'>Buy {rng.random()}</div><article><h1>{title}</h1>{text}</article><footer>&copy; us</footer></body></html>"
    if template == 1:
        return f"<html><body class='with-sidebar'><header><h1>The Site</h1></header><main><div class='content'><h1>{title}</h1>{text}<form>Name <input name=q></form></div><aside>Side {rng.random()}</aside><section id='comments'><p>nice {rng.random()}</section></main><div id=cookie-notice>We use cookies</div>"
    return f"<div class='menu'><a href=x>Start {rng.random()}</a></div><div class=body><h2>{title}</h2>{text}</div><div class='newsletter-signup'>Sign up</div>"


def test_extraction(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(90):
        t = i % 3
        title = f"Title {i} &amp; more"
        words = [f"Paragraph {i} {k} with <b>bold</b> words\n and &lt;marks&gt;" for k in range(rng.randrange(1, 6))]
        if rng.random() < 0.4:
            words.insert(1, f"<ul><li>item {i}<li>other</ul>")
        rows.append((i, f"http://host{t}.org/{i}", page(rng, title, words, t)))
        blocks = [f"Title {i} & more"]
        for w in words:
            blocks += [f"item {i}", "other"] if w.startswith("<ul") else [" ".join(w.replace("<b>", "").replace("</b>", "").replace("&lt;", "<").replace("&gt;", ">").split())]
        want[i] = "\n".join(blocks)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in m.extract_pages(df.repartition(4)).collect()}
    for i, text in want.items():
        assert got[i].text == text and got[i].n_chars == len(text) and got[i].url == rows[i][1]


def test_articles_by_name():
    page = "<div class=top>Site name</div><div id='main-content'><h1>T</h1><div class='post-body'><p>one</p></div><div class='share-bar'>Share</div></div><p>below</p>"
    assert alone(page) == "T\none"
    assert alone("<body class=page-content><p>a</p><div class=sidebar>no</div>") == "a"
    assert alone("<main><div class=content><p>in</p></div><p>too</p></main><p>out") == "in\ntoo"


def test_parsing():
    assert alone("<article><p>a<br>b<p>c <i>d</i>e<ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><th>3</table>z</article>") == "a b\nc de\nx\ny\n1\n2\n3\nz"
    assert alone("<article>a &amp b &#x41;&eacute;&nbsp;&nbsp;c &bogus; &am</article>") == "a & b Aé c &bogus; &am"
    assert alone("<article><!-- <p>no</p> --><p title='>'>yes</p><script>no</script><style>no</style><textarea>no</textarea><p hidden>no<p style='display: none'>no</article>") == "yes"
    assert alone("<p>un<article>closed") == "closed"
    assert alone("") == "" and alone("just text") == "just text" and alone("<") == "<" and alone("a < b") == "a < b"
    assert alone("<article><div><p>one</div></p></div>two</article></article><p>out") == "one\ntwo"


def test_wrappers_cover_their_pages():
    """Whatever pages are aligned, each of their texts has a slot."""
    rng = random.Random(2)

    def tree(depth):
        out = ""
        for _ in range(rng.randrange(1, 6)):
            tag = rng.choice(("div", "p", "ul", "h2", "section"))
            out += f"<{tag} class={rng.choice('abc')}>" + (tree(depth - 1) if depth and tag != "p" else f"text{rng.random()}") + f"</{tag}>"
        return out

    for _ in range(30):
        htmls = [tree(2) for _ in range(6)]
        top, pages = m.compiled(aligned(htmls)), [*map(m.parse, htmls)]
        for p in pages:
            texts = []

            def walk(e, texts=texts):
                for x in e.items:
                    walk(x) if isinstance(x, m.Element) else texts.append(x[0])

            walk(p)
            assert m.extract(p, top) == "\n".join(texts)


def test_optional_and_repeated_groups():
    w = aligned([f"<div><h1>{t}</h1>{x}<p>a</p><p>b</p><i>same</i></div>" for t, x in (("t1", ""), ("t2", "<ul><li>x<li>y<li>z</ul>"))])
    (div,) = w[4]
    assert [(x[0], x[1], x[2]) for x in div[4]] == [("h1", 2, False), ("ul", 1, False), ("p", 2, True), ("#", 2, False)]
    assert {k for k, _ in div[4][0][4][0][5].values()} == {1} and [*div[4][3][5].values()] == [(2, 1)]  # the titles differ, the last text is the same
    assert div[4][1][4][0][:3] == ["li", 1, True]


def tree(spec):
    """A node of a wrapper from (signature, items)."""
    return ["#", 1, False, 1, 0, {}] if spec == "#" else [spec[0], 1, False, False, [tree(x) for x in spec[1]]]


def test_alignment_by_brute_force():
    """The pairs of most likeness in all, in order, against every choice of pairs."""
    rng = random.Random(4)

    def best(a, b):
        if not a or not b:
            return 0
        skip = max(best(a[1:], b), best(a, b[1:]))
        return max(skip, m.likeness(a[0], b[0]) + best(a[1:], b[1:])) if a[0][0] == b[0][0] else skip

    for _ in range(200):
        a, b = ([tree(rng.choice(["#", ("p", ["#"]), ("div", ["#"]), ("div", [("p", [])]), ("div", ["#", ("ul", [])]), ("ul", [])])) for _ in range(rng.randrange(6))] for _ in range(2))
        pairs = m.matched(a, b)
        assert all(x < y and p < q for (x, p), (y, q) in zip(pairs, pairs[1:])) and all(a[i][0] == b[j][0] for i, j in pairs)
        if [x[0] for x in a] != [x[0] for x in b]:
            assert abs(sum(m.likeness(a[i], b[j]) for i, j in pairs) - best(a, b)) < 1e-9


def test_long_sequences_keep_their_order(monkeypatch):
    """However many different items an element has, also where they are aligned by what recurs."""
    rng = random.Random(6)
    names = [f"<div class={'abcdefghij'[i // 10]}{'klmnopqrst'[i % 10]}><p>{{}} {i}</p></div>" for i in range(100)]
    for cells in (m.CELLS, 10):
        monkeypatch.setattr(m, "CELLS", cells)
        pages = [[x.format(rng.random()) for x in names if rng.random() < 0.9] for _ in range(6)]
        w = aligned(["".join(p) for p in pages])
        if cells > 10:
            assert not w[3] and len({x[0] for x in w[4]}) == 100 and len(w[4]) < 115
        got = extracted(["".join(p) for p in pages])
        assert [g.count("\n") + 1 for g in got] == [len(p) for p in pages]


def articles(n, inside, text=lambda i: f"<p>first {i} of many words</p><p>and second {i * i} with some more of them</p><p>third {i}, the last of the three</p>"):
    return [f"<div class=x><h1>Title {i}</h1>{text(i)}{inside(i)}</div>" for i in range(n)]


def test_alignment_decides():
    """What a host's pages repeat, and its groups of links, are told from the article by no name, only by aligning pages."""
    body = [f"Title {i}\nfirst {i} of many words\nand second {i * i} with some more of them\nthird {i}, the last of the three" for i in range(8)]
    for wrap in ("{}", "<article>{}</article>", "<div id=main-content>{}</div>"):
        pages = [wrap.format(p) for p in articles(8, lambda i: "<p>Read our magazine.</p>")]
        assert extracted(pages) == body
        assert [alone(p) for p in pages] == [f"{b}\nRead our magazine." for b in body]
        pages = [wrap.format(p) for p in articles(8, lambda i: "<div class=y><ul>" + "".join(f"<li><a href=/{k}>go to {k * i}</a>" for k in range(3)) + "</ul></div>")]
        assert extracted(pages) == body
        if "article" in wrap:
            assert all(alone(p) != b for p, b in zip(pages, body, strict=True))
    # plain elements that only their places tell apart: the notice is the template's, the article differs
    pages = [f"<div><p>We are closed on Sunday.</p></div><div><h1>T{i}</h1><p>{i} says one long thing</p></div><div><p>Come in, {i}</p></div>" for i in range(6)]
    assert extracted(pages) == [f"T{i}\n{i} says one long thing\nCome in, {i}" for i in range(6)]


def test_copies_are_no_template():
    """Pages that are copies, or nearly, keep their texts; so do those of few pages of a host."""
    same = articles(1, lambda i: "")[0]
    for wrap in ("<article>{}</article>", "{}"):
        pages = [wrap.format(same)] * 9
        assert extracted(pages) == [alone(pages[0])] * 9 and alone(pages[0]).count("\n") == 3
        near = [wrap.format(same.replace("third 0", f"third {i}")) for i in range(9)]
        assert extracted(near) == [alone(p) for p in near]
        few = [wrap.format(p) for p in articles(4, lambda i: "<p>Read our magazine.</p>")]
        assert extracted(few) == [alone(p) for p in few]


def test_names_are_hints():
    """Classes that only seem to name what isn't the article, and forms and names round the whole of it."""
    assert alone("<main class='content has-sidebar'><p>The article text.</p></main><p>footer line</p>") == "The article text."
    assert alone("<article class='post comments-open'><p>text</p></article><p>x") == "text"
    assert alone("<article><p>a<section class='related-work'><p>b</section><div class='social-history'>c</div><div class='related-posts'>d</div><div id=comments>e</div></article>") == "a\nb\nc"
    assert alone("<form><nav>menu</nav><article><p>in a form</p></article></form>") == "in a form"
    assert alone("<div class=content-sidebar-wrap><main><p>text</p></main><div class=sidebar>s</div></div>") == "text"
    assert alone("<div class=comments><p>nothing else here</p></div>") == "nothing else here"
    assert alone("<article><p>short</p></article><div class=comments><article class=comment><p>long long long comment</p></article></div>") == "short"


def test_depth():
    """Elements are told apart however deep they are."""
    for n in (200, 20_000):
        assert alone("<article>" + "<div>" * n + "<nav>menu</nav><p>inner</p>" + "</div>" * n + "</article>") == "inner"
    pages = ["<div>" * 20_000 + f"<p>inner {i}</p>" + "</div>" * 20_000 for i in range(3)]
    assert extracted(pages) == [f"inner {i}" for i in range(3)]


def test_long_pages_take_time_in_proportion():
    """Many paragraphs and rows that differ all."""
    import time

    took = []
    for n in (4_000, 16_000):
        page = "<article>" + "".join(f"<p>text {i}</p>" for i in range(n)) + "<table>" + "".join(f"<tr><td>{i}<td>{i * i}" for i in range(n)) + "</table>" + "".join(f"<h2>{i}</h2><p>b{i}</p>" for i in range(n)) + "</article>"
        began = time.time()
        assert alone(page).count("\n") + 1 == 5 * n
        took.append(time.time() - began)
    assert took[1] < 10 * took[0] + 1


def test_odd(spark):
    long_ = "<article>" + "<p>word</p>" * 30_000 + "</article>"
    rows = [(1, None, None), (2, "", ""), (None, "http://h/x", "<article>x</article>"), (3, "http://h/x", "<article>x</article>"), (3, "http://h/x", "<article>x</article>"), (4, "http://l/", long_), (5, "http://deep/", "<div>" * 9000 + "deep" + "</div>" * 9000)]
    df = spark.createDataFrame([(*r, "w", "t") for r in rows], "page_id long, url string, html string, wrapper string, text string")
    got = sorted((str(r.page_id), r.n_chars, r.text[:9]) for r in m.extract_pages(df).collect())
    assert got == sorted([("1", 0, ""), ("2", 0, ""), ("None", 1, "x"), ("3", 1, "x"), ("3", 1, "x"), ("4", 149_999, "word\nword"), ("5", 4, "deep")])
    assert m.extract_pages(spark.createDataFrame([], df.schema)).count() == 0


def test_repeated_plain_tags_lose_no_text():
    """Nodes of one signature that hold different things: the first isn't always the one that covers the page."""
    pages = ["<h1>head one</h1><div class=a><p>text one</p></div>", "<div class=a><ul><li>text two</li></ul></div>", "<div class=a><p>text three</p></div><h1>head three</h1><div class=a><p>more three</p></div>"]
    assert extracted(pages) == ["head one\ntext one", "text two", "text three\nhead three\nmore three"]


def test_page_beyond_the_wrapper_is_read_by_its_own():
    top = m.compiled(m.wrapper_of(m.parse("<div class=a><p>one</p></div>")))
    assert m.extract(m.parse("<div class=a><ul><li>two</li></ul></div><h2>three</h2>"), top) == "two\nthree"
