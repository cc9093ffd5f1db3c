"""Main text by page marks and by repeated runs of a host."""

import random

import numpy as np

from acuity.llm import pages as P


def main(page):
    return " ".join(t for kind, t in P.blocks(page) if kind == P.MAIN)


def test_marked_article():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>x";</script></head><body>
    <header>site</header><nav><ul><li>Home</li></ul></nav><div class="ad">buy</div><div id="cookie-notice">ok?</div>
    <article><h1>Title &amp;  more&nbsp;x</h1><p><b>One
    two<br><p>th<i>re</i>e 1 < 2 &lt;b&gt;</p><span class="promo">no</span><aside>side</aside><form>f<input value=">"></form>
    <div class="comments"><article>reader</article></div><!-- <p>hidden</p> --><p>end</article><footer>&copy;</footer></body></html>"""
    assert main(page) == "Title & more x One two three 1 < 2 <b> end"


def test_marks_are_whole_names():
    for page, text in {
        '<article><p style="overflow:hidden">a<p aria-hidden="false">b<p data-state="hidden-xs">c</article>': "a b c",
        '<article><div style="overflow:hidden">a</div><div data-role="main" data-state="hidden">b</div><div hidden>c</div></article>': "a b",
        '<main class="site-main no-sidebar">a</main>': "a", '<article class="post has-comments sidebar">a</article>': "a",
        '<div id="content-sidebar-wrap"><article>a</article></div>': "a", '<div class="banner"><main>a</main></div>': "a",
        '<article>a</article><div class="related"><article>b</article></div>': "a", '<aside><article>b</article></aside><main>a</main>': "a",
        '<div class="comments" role="main">a<div class="comments">b</div></div>': "a", '<div data-role="main">a</div>': "",
    }.items():
        assert main(page) == text, page


def test_compound_names_need_the_host(spark):
    share = '<div class="share-bar"><p>share this with all your friends on every one of our networks</div>'
    rows = [(i, f"https://h/{i}", f'<article><div class="entry-header"><h1>Head {i}</h1></div><p>text {i}{share}<p>end</article>') for i in range(3)]
    got = P.main_text(spark.createDataFrame([*rows, (9, "https://other/", rows[0][2])], "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {
        **{i: f"Head {i} text {i} end" for i in range(3)}, 9: "Head 0 text 0 share this with all your friends on every one of our networks end"}


def test_odd_pages():
    for page, text in {"": "", "<article></article>": "", "<main>a<main>b": "a b", "<article>a": "a", "</div></article>": "",
                       "<article>x<script>never closed": "x", "<article>x<!-- never closed": "x", '<article><p title="a>b">c</p>': "c",
                       "<article>a &#x41;&#66;&unknown; &amp": "a AB&unknown; &"}.items():
        assert main(page) == text
    assert main("<article>" + "<div>" * 5000 + "deep") == "deep"
    assert len(main("<article>" + "<p>word " * 100_000)) == 499_999


def brute(rows):
    """Unique text of unmarked pages: tokens no run shared by two pages of a host covers."""
    streams = {}
    for page, host, blocks in rows:
        for b in blocks:
            words = b.split()
            for i in range(len(words)):
                if len(words) - i >= P.RUN or i == 0:
                    streams.setdefault((host, tuple(words[i:i + P.RUN])), set()).add(page)
    out = {}
    for page, host, blocks in rows:
        kept = []
        for b in blocks:
            words = b.split()
            gone = {k for i in range(len(words)) if (len(words) - i >= P.RUN or i == 0) and len(streams[host, tuple(words[i:i + P.RUN])]) > 1
                    for k in range(i, min(i + P.RUN, len(words)))}
            kept += [w for k, w in enumerate(words) if k not in gone]
        out[page] = " ".join(kept)
    return out


def test_unmarked_pages_equal_plain_python(spark):
    rng = random.Random(4)
    shared = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 20))) for _ in range(10)]
    rows = [(i, f"h{i % 3}", [rng.choice(shared) if rng.random() < .6 else " ".join(rng.choice("abcd") + str(rng.randrange(9)) for _ in range(12))
                              for _ in range(rng.randint(1, 5))]) for i in range(60)]
    table = spark.createDataFrame([(i, f"https://{h}/p?{i}", "".join(f"<div>{b}</div>" for b in blocks), "x") for i, h, blocks in rows],
                                  "page_id long, url string, html string, text string").repartition(5)
    got = {r["page_id"]: r["text"] for r in P.main_text(table).collect()}
    assert got == brute(rows) and any(got.values()) and not all(got.values())


def test_copies_and_headings_stay(spark):
    story = "a long story of one two three four five six seven eight nine"
    foot = "all rights are reserved by the owner of this very site"
    pages = [f"<h2>Big news</h2><p>{story}<p>{foot}"] * 2 + [
        f"<nav><a>Big news</a></nav><aside>{story[:40]} more</aside><footer>{foot}</footer><p>Other {i} text" for i in range(3)]
    pages += ["<h1>How the red fox ran over all green hills</h1><p>x", "<nav>How the red fox ran over all green hills</nav><p>y"]
    got = P.main_text(spark.createDataFrame([(i, f"https://h/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")).collect()
    assert [r["text"] for r in sorted(got)] == [f"Big news {story}"] * 2 + [f"Other {i} text" for i in range(3)] + [
        "How the red fox ran over all green hills x", "y"]


def test_suffix_groups_are_equal_runs():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 30, 40)
    tokens = rng.integers(0, 2, sizes.sum()).astype(np.uint64)
    host = np.repeat(rng.integers(0, 2, 40), sizes)
    runs, length = P.run_hashes(sizes, tokens)
    order, starts = P.suffix_groups(sizes, tokens, host, length > 0)
    groups = [frozenset(g.tolist()) for g in np.split(order, starts[1:])]
    wanted = {}
    for i in np.flatnonzero(length > 0).tolist():
        wanted.setdefault((host[i], *tokens[i:i + length[i]].tolist()), set()).add(i)
    assert set(groups) == set(map(frozenset, wanted.values()))
    assert len({(host[i], runs[i]) for i in order}) == len(groups)


def test_odd_rows(spark):
    kind = "page_id long, url string, html string"
    rows = P.main_text(spark.createDataFrame([(1, None, None), (None, "u", "<main>é😀</main>"), (2, "u", "<main>a</main>"), (2, "u", "<main>a</main>")], kind))
    assert sorted((r["text"], r["n_chars"]) for r in rows.collect()) == [("", 0), ("a", 1), ("a", 1), ("é😀", 2)]
    assert P.main_text(spark.createDataFrame([], kind)).collect() == []


def test_broken_pages_take_time_in_proportion():
    import time
    for unit in ("<a ", "<a href='", "</ ", "<!x ", "<div>", "</span>", "<span><div></span>", "<p class=ad>", "<script ", "<a b=\"x ", "&amp", "<"):
        page = "<article><p>Body text</p>" + unit * (1_000_000 // len(unit))
        start = time.perf_counter()
        P.blocks(page)
        assert time.perf_counter() - start < 10, unit
    deep = "<div>" * 100_000 + "</table>" * 100_000 + "<span>" * 50_000 + "</div>" * 100_000
    start = time.perf_counter()
    P.blocks(deep)
    assert time.perf_counter() - start < 10


def test_comments_and_adverts_of_an_article():
    def main(page):
        return [text for kind, text in P.blocks(page) if kind != P.BOILER]
    page = '<div class="post"><p>Body</p></div><ol class="comment-list"><li><article class="comment-body">cm</article></li></ol>'
    assert main(page) == ["Body"]
    assert main('<article><p>Text</p><p class="advert">Buy</p><p>More</p><ul><li class="comment">no<li>yes</ul></article>') == ["Text", "More", "yes"]
    assert main('<article><h2 class="ad">Buy</h2><p class="ad">this<div>kept</div></article>') == ["kept"]
    assert main('<article class="post has-comments"><p>Body</p><section id="comments"><article>cm</article></section></article>') == ["Body"]
    assert main("<article><p>Use the <button>Save</button> button</p></article>") == ["Use the Save button"]


NOTICE = "get the best of our stories every day in one short letter"


def words(rng, n):
    return " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))


def texts_of(spark, pages, parts=3):
    rows = [(i, f"https://{host}/{i}", html) for i, (host, html) in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in P.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)).collect()}


def test_the_host_decides_on_marked_articles(spark):
    rng = random.Random(7)
    own = [words(rng, 30) for _ in range(12)]
    head = "the daily news of all the towns along the river"
    pages = [("h", f"<nav>Home</nav><article><h2>{head}</h2><p>{own[i]}</p><p>{NOTICE}</p><p>Read more</p></article>") for i in range(4)]
    pages += [("h", f"<main><p>{own[i]}</p><p>{NOTICE}</p></main>") for i in range(4, 6)] + [("h", f"<main><p>{own[6]}</p></main>")]
    pages += [("half", f"<article><p>{own[i]}</p>{f'<p>{NOTICE}' * (i < 9)}</article>") for i in range(7, 11)]
    pages += [("two", f"<article><p>{own[i]}</p><p>{NOTICE}</p></article>") for i in range(2)]
    pages += [("h", f"<main><p>short</p><p>{NOTICE}</p></main>"), ("h", f"<main><p>{NOTICE}</p></main>")]
    assert texts_of(spark, pages) == {**{i: f"{head} {own[i]} Read more" for i in range(4)}, **{i: own[i] for i in range(4, 7)},
                                      **{i: f"{own[i]} {NOTICE}" for i in (7, 8)}, **{i: own[i] for i in (9, 10)},
                                      **{11 + i: f"{own[i]} {NOTICE}" for i in range(2)}, 13: "short", 14: NOTICE}


def test_copies_make_no_template_and_near_copies_stay(spark):
    rng = random.Random(8)
    own = [words(rng, 30) for _ in range(6)]
    page = f"<article><p>{own[0]}</p><p>{NOTICE}</p></article>"
    pages = [("h", page)] * 5 + [("h", f"<article><p>{own[i]}</p></article>") for i in (1, 2)]
    pages += [("near", f"<article><p>{own[0]}</p><p>{own[1]}</p><p>edition {i}</p></article>") for i in range(4)] + [("near", f"<main>{own[2]}</main>")]
    got = texts_of(spark, pages)
    assert got == {**{i: f"{own[0]} {NOTICE}" for i in range(5)}, 5: own[1], 6: own[2],
                   **{7 + i: f"{own[0]} {own[1]} edition {i}" for i in range(4)}, 11: own[2]}


def marked_brute(rows):
    """Marked blocks of each page that no run on more than half of the host's different articles covers."""
    def runs(block):
        w = block.split()
        return [tuple(w[i:i + P.RUN]) for i in range(len(w) - P.RUN + 1)]

    def site(stands):
        return {key for key, on in stands.items() if len(on) >= P.SITE and 2 * len(on) > len(articles[key[0]])}

    articles, first, stands, out = {}, {}, {}, {}
    for _, host, blocks in rows:
        articles.setdefault(host, set()).add(tuple(blocks))
        for b in filter(runs, blocks):
            first.setdefault((host, runs(b)[0]), set()).add(tuple(blocks))
    first = site(first)
    for _, host, blocks in rows:
        here = [b for b in blocks if runs(b) and (host, runs(b)[0]) in first]
        for b in here if 2 * len(" ".join(here).split()) < len(" ".join(blocks).split()) else []:
            for r in runs(b):
                stands.setdefault((host, r), set()).add(tuple(blocks))
    stands = site(stands)
    for page, host, blocks in rows:
        gone = set()
        for k, b in enumerate(blocks):
            cover = {j for i, r in enumerate(runs(b)) if (host, r) in stands for j in range(i, i + P.RUN)}
            if len(cover) == len(b.split()):
                gone.add(k)
        gone = gone if len(gone) < len(blocks) else set()
        out[page] = " ".join(b for k, b in enumerate(blocks) if k not in gone)
    return out, first


def test_marked_pages_equal_plain_python(spark):
    rng = random.Random(9)
    shared = {h: [words(rng, rng.randint(4, 14)) for _ in range(3)] for h in "abcd"}
    rows = []
    for i in range(90):
        host = rng.choice("aabcd")
        tail = shared[host][2].split()
        blocks = [words(rng, rng.randint(1, 30)) for _ in range(rng.randint(0, 3))]
        blocks += [s for s in shared[host] if rng.random() < .55] + [" ".join(tail[rng.randint(0, 1):9] + ["x"] * rng.randint(0, 2))]
        rng.shuffle(blocks)
        rows.append((i, host, blocks) if rng.random() < .8 or not rows else (i, *rows[-1][1:]))
    wanted, first = marked_brute(rows)
    assert first and any(wanted[i] != " ".join(b) for i, _, b in rows) and any(wanted[i] == " ".join(b) for i, _, b in rows)
    for parts in (1, 5):
        assert texts_of(spark, [(h, "<article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>") for _, h, blocks in rows], parts) == wanted


def test_template_on_pages_with_open_blocks_and_without_ids(spark):
    rng = random.Random(10)
    own = [words(rng, 30) for _ in range(8)]
    page = '<article><div class="entry-header"><p>by {} </div><p>{}</p><p>' + NOTICE + '</p></article>'
    rows = [(i, "https://h/", page.format(i, own[i])) for i in range(3)] + [(None, "https://n/", page.format(i, own[i])) for i in range(4)]
    got = P.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    # rows without an id are one page, too few to show a template
    assert sorted(r["text"] for r in got) == sorted([f"by {i} {own[i]}" for i in range(3)] + [f"by {i} {own[i]} {NOTICE}" for i in range(4)])
