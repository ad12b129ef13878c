"""Page extraction, benchmark overlaps and nearest vectors against plain versions."""

import html
import math
import random
import re
import time

import numpy as np
import pytest
from cases import documents, words

from weftspan.llm import decontaminate, markup, nearest, queries, site_style

FOLDER = "/root/testdata/sf0.01"
PAGES = "page_id long, url string, html string"


def path_of(elements, place):
    return path_of(elements, elements[place].parent) + ">" + elements[place].presentation if place else ""


def test_blocks_follow_the_page():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body>
    <!-- <p>no</p> --><div class="wrap12"><p>One <b>bo</b>ld &amp;amp; &eacute;&nbsp;&#x41;<p>Two<br>three<ul><li>a<li>b</ul></div>
    <form>no</form><p title="a > b">Four</p><span class="ad">no</span>tail</body>"""
    elements, blocks = markup.read(page)
    found = [text for place, text in blocks if not elements[place].apart]
    assert found == ["One bold &amp; é A", "Two", "three", "a", "b", "Four", "tail"]
    assert [path_of(elements, place) for place, t in blocks if t == "a"] == [">html>body>div.wrap#>ul>li"]
    assert markup.read("")[1] == [] and [t for _, t in markup.read("a < b <")[1]] == ["a < b <"]
    assert [t for _, t in markup.read("<p>x</div></b>y<script>never closed <p>z")[1]] == ["xy"]


@pytest.mark.parametrize("opening", ['<body class="home no-sidebar">', '<div class="content with-sidebar">', '<article class="post comments-open comments">', '<div id="search-result-page">', '<main class="search">'])
def test_parts_of_names_declare_nothing(opening):
    page = f'{opening}<p>kept</p><div class="wide sidebar">no</div><div id="comments">no</div><div role="navigation">no</div>'
    assert site_style.main_text(page, {}) == "kept"
    part = f'{opening}<p>kept</p><div class="share-bar">shared</div>'
    low = {e.key: (0.0, 1.0, 0.0) for e in markup.read(part)[0] if "share-bar" in e.presentation}
    assert site_style.main_text(part, {}) == "kept shared"
    long = part.replace("kept", "kept much longer text")
    assert site_style.main_text(long, low) == "kept much longer text"


def test_parts_of_names_are_hints():
    page = """<main><p>a</p><section class="comments-area">reader says</section><div class="related-posts">rel</div><div class="ad-slot">buy</div></main>"""
    assert site_style.main_text(page, {}) == "a"
    page = '<div class="content with-sidebar"><h1>Title</h1><p>body of it</p></div><div class="site-footer">end</div>'
    assert site_style.main_text(page, {}) == "Title body of it"


def plain_tree(rows):
    """Values of each (host, node) by entropies over lists of what pages show."""
    seen = {}
    for _, url, page in rows:
        for node, kind, value in site_style.features(page or ""):
            for host in (markup.host_of(url), None):
                seen.setdefault((host, node), ([], [], []))[kind].append(value)

    def entropy(values, pages):
        chances = [values.count(v) / len(values) for v in values] if values else []
        return 1 - sum(math.log(p * len(values)) for p in chances) / len(values) / math.log(pages) if values and pages > 1 else 1.0

    def of(key):
        content, styles, pages = seen[key]
        return entropy(styles, len(pages)), 0.9 ** (len(set(styles)) - 1), entropy(content, len(pages)), len(pages)

    def blend(own, pages, prior):
        return [(pages * a + 8 * b) / (pages + 8) for a, b in zip(own, prior, strict=True)]

    found = {}
    for host, node in seen:
        if host is not None:
            *every, n = of((None, node))
            *own, m = of((host, node))
            found[host, node] = blend(own, m, blend(every, n, [1.0] * 3))
    return found


def test_tree_against_plain_entropies(spark):
    rng = random.Random(4)
    rows = []
    for n in range(60):
        story = "".join(f"<p>{' '.join(words(rng, 6, 9))}</p><ul><li>{rng.choice('ab')}</ul>"[: rng.choice([60, 200])] for _ in range(n % 4))
        rows.append((n, f"http://{'abc'[n % 7 % 3]}.example/", f"<nav>x</nav><div class=top>Our site</div><article>{story}</article><div class=e{n % 2}a>end {n % 5}</div>"))
    rows += [(90, None, None), (91, "http://one.example", "<p>x</p>")]
    got = {(r["host"], r["node"]): [r["style"], r["below"], r["content"]] for r in site_style.style_tree(spark.createDataFrame(rows, PAGES)).collect()}
    want = plain_tree(rows)
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert got[key] == pytest.approx(values, abs=1e-9)


def test_repeated_branch_in_an_article_goes(spark):
    rng = random.Random(3)
    rows = []
    for n in range(60):
        story = "".join(f"<p>{' '.join(words(rng, 12, 10_000))}</p>" for _ in range(1 + n % 3))
        rows.append((n, "http://a.example/", f"<article>{story}<div class=box>Read our weekly letter</div></article>"))
    rows += [(100 + n, "http://b.example/", "<article><p>one text that all pages of a host have</p></article>") for n in range(60)]
    got = {r["page_id"]: r["text"] for r in site_style.extract(spark.createDataFrame(rows, PAGES), ["page_id"]).collect()}
    for n, _, page in rows:
        assert got[n] == " ".join(re.findall(r"<p>(.*?)</p>", page))


def test_body_beside_a_teaser_stays():
    assert site_style.main_text("<article>teaser</article><div><p>long main body</p></div>", {}) == "teaser long main body"
    assert site_style.main_text("<article>a long main body of text</article><div><p>bit</p></div>", {}) == "a long main body of text"


@pytest.mark.parametrize("page", [
    "<div>" * 100_000 + "deep", "<div><p>t" * 50_000, '<a href="x ' * 50_000, '<a href="x ' * 50_000 + ">", "<b>" * 100_000 + "</i>" * 100_000 + "x",
    "<i>" * 50_000 + "<b>" * 50_000 + "</i>" * 50_000, "<!x" * 100_000, "<!--" * 100_000, "<a" * 200_000, "<ul><li>" * 50_000 + "</div>" * 50_000,
    "<script>" * 50_000, "<p>" * 100_000, "<a '" * 50_000 + "<p>x", "</script" * 50_000 + "<script>",
])
def test_odd_pages_take_linear_time(page):
    begin = time.process_time()
    site_style.features(page)
    site_style.main_text(page, {})
    assert time.process_time() - begin < 10


def test_site_template_is_removed_without_declarations(spark):
    rng = random.Random(2)
    rows = []
    for n in range(40):
        story = "".join(f"<p>{' '.join(words(rng, 12, 10_000))}</p>" for _ in range(1 + n % 4))
        rows.append((n, f"http://www.a.example/{n}", f"<body><div class=top>Our site</div><div class=x{n}>{story}</div><div class=end>All rights held</div></body>"))
    got = {r["page_id"]: r["text"] for r in site_style.extract(spark.createDataFrame(rows, PAGES), ["page_id"]).collect()}
    for n, _, page in rows:
        assert got[n] == " ".join(re.findall(r"<p>(.*?)</p>", page))


@pytest.mark.parametrize("broadcast_nodes", [500_000, 0])
def test_page_cases(spark, broadcast_nodes):
    rows = [
        (1, "http://a.example/1", None), (2, None, ""), (3, "not a url ::", "<article>x</article>"), (4, "http://[bad", "plain"),
        (None, "http://a.example/2", "<article>" + "<p>long text</p>" * 20_000 + "</article>"), (3, "not a url ::", "<article>x</article>"),
    ]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "'t' as text", "1 as n_chars", "'h' as host")
    got = site_style.extract(pages, ["page_id", "url", "host"], broadcast_nodes).collect()
    assert sorted(len(r["text"]) for r in got) == [0, 0, 1, 1, 5, 199_999]
    assert all(r["host"] == "h" for r in got)
    assert site_style.extract(spark.createDataFrame([], PAGES), ["page_id"]).count() == 0


def test_registered_pages(spark):
    source = {r["page_id"]: r["html"] for r in queries.table(spark, FOLDER, "pages").collect()}
    for r in queries.op1_site_style(spark, FOLDER).collect():
        article = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", article)).split())
        assert (r["text"], r["n_chars"]) == (want, len(want))


def plain_overlaps(docs, items):
    """Items of which 13 words in a row, or all words, stand in a document."""
    found = set()
    for doc_id, text in docs:
        own = re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
        for item_id, item in items:
            part = re.findall("[0-9a-z\x80-\U0010ffff]+", (item or "").lower())
            n = min(13, len(part))
            grams = {tuple(part[i : i + n]) for i in range(len(part) - n + 1)}
            if n >= 5 and any(tuple(own[i : i + n]) in grams for i in range(len(own) - n + 1)):
                found.add((doc_id, item_id))
    return found


def test_registered_overlaps(spark):
    docs = [(r["doc_id"], r["text"]) for r in queries.table(spark, FOLDER, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in queries.table(spark, FOLDER, "benchmark").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in queries.op5_decontamination(spark, FOLDER).collect()}
    assert got == plain_overlaps(docs, items) and len(got) > 10


@pytest.mark.parametrize("block_words", [400_000, 40])
def test_overlap_cases(spark, block_words):
    rng = random.Random(4)
    items = [(1, " ".join(words(rng, 30, 10_000))), (2, " ".join(words(rng, 6, 10_000))), (3, "too short"), (4, None), (5, ""), (None, " ".join(words(rng, 20, 10_000)))]
    one, two, free = items[0][1].split(), items[1][1], items[5][1]
    replaced = [*one]
    replaced[4], replaced[13], replaced[22] = "x", "y", "z"
    rows = [
        (10, " ".join(words(rng, 50)) + " " + " ".join(one).upper(), None, None, None),
        (11, " ".join(replaced), None, None, None),
        (12, " ".join(one[:12]), None, None, None),
        (13, f"so, {two}!", None, None, None),
        (14, "too short", None, None, None), (15, None, None, None, None), (16, "", None, None, None),
        (None, f"{free} {two}", None, None, None), (10, " ".join(one), None, None, None),
        (17, " ".join(words(rng, 40_000)) + " " + " ".join(one), None, None, None),
    ]
    docs = documents(spark, rows, clash=True)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.overlaps(docs, bench, block_words).collect()}
    assert set(got) == {(10, 1), (11, 1), (13, 2), (None, 2), (None, None), (17, 1)}
    r = got[(11, 1)]
    assert (r["doc_word"], r["item_word"], r["n_words"], r["n_matched"]) == (0, 0, 30, 27)
    assert got[(10, 1)]["n_matched"] == 30 and got[(17, 1)]["doc_word"] == 40_000
    left = decontaminate.remove_overlapping(docs, bench)
    assert left.columns == docs.columns
    # The row without a doc_id holds an item, and goes like any other.
    assert sorted((r["doc_id"] or 0) for r in left.collect()) == [12, 14, 15, 16]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.overlaps(docs, none).count() == 0 and decontaminate.overlaps(documents(spark, []), bench).count() == 0


@pytest.mark.parametrize("n", range(5, 25))
def test_replaced_words_at_all_places(n):
    """A copy with one or two words replaced, wherever they stand, is found if it keeps
    four fifths of the item, or has the words that are enough."""
    rng = random.Random(n)
    item, around = words(rng, n, 10_000), words(rng, 6, 300)
    block = decontaminate.Block([7], [" ".join(item)])
    cases = [(i,) for i in range(n)] + [(i, j) for i in range(n) for j in range(i)]
    texts = [" ".join([*around, *["zz" if i in case else w for i, w in enumerate(item)], *around]).encode() for case in cases]
    held = decontaminate.prepared(texts)
    found = {doc for doc, at, shift in block.alignments(held).tolist() if block.stretch(held, doc, at, shift)}
    want = {k for k, case in enumerate(cases) if n - len(case) >= 0.8 * n}
    assert want <= found
    apart = {k for k in found - want if max(map(len, "".join("0" if i in cases[k] else "1" for i in range(n)).split("0"))) < 5}
    assert not apart or n > 15


def test_unlike_texts_are_left_alone():
    rng = random.Random(1)
    block = decontaminate.Block([1, 2, 3], [" ".join(words(rng, n, 15)) for n in (6, 12, 20)])
    held = decontaminate.prepared([" ".join(words(rng, 400, 15)).encode() for _ in range(40)])
    tried = block.alignments(held).tolist()
    assert len(tried) > 10 and sum(block.stretch(held, *t) is not None for t in tried) == 0


def plain_nearest(ids, x, k):
    scores = x @ x.T
    out = {}
    for i, vec_id in enumerate(ids):
        if vec_id % 20 == 0:
            order = sorted((-round(scores[i, j], 12), ids[j]) for j in range(len(ids)) if j != i)
            out[vec_id] = [v for _, v in order[:k]]
    return out


def test_registered_nearest(spark):
    folder = "/root/testdata/sf0.1"
    rows = queries.table(spark, folder, "embeddings").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    want, at = plain_nearest(ids, x, 20), {v: i for i, v in enumerate(ids)}
    got = {}
    for r in queries.op7_nearest(spark, folder).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    hits = 0
    for query, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and query not in [f[1] for f in found]
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        for _, v, score in found:
            assert abs(score - x[at[query]] @ x[at[v]]) < 1e-12
        hits += len({f[1] for f in found} & set(want[query]))
    assert hits >= 0.9 * 20 * len(want)


def test_nearest_cases(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 8)).round(3)
    x[30:60] = x[0]  # many equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(100, None), (120, [0.0] * 8), (140, [float("nan")] + [1.0] * 7), (160, [None] + [1.0] * 7), (180, [float("inf")] + [1.0] * 7), (None, [1.0] * 8)]
    frame = spark.createDataFrame(rows + bad + [rows[20]], "vec_id long, embedding array<double>").selectExpr("*", "1 as rank", "2 as score", "3 as rep")
    vectors = nearest.usable(frame, "vec_id", "embedding")
    found = nearest.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20).collect()
    want = plain_nearest(list(range(90)), x, 20)
    got = {q: [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in want}
    assert got == want  # so few vectors that all leaves are searched
    few = vectors.filter("vec_id < 3")
    assert sorted((r["query_id"], r["vec_id"]) for r in nearest.nearest(few, few, k=20).collect()) == [(a, b) for a in range(3) for b in range(3) if a != b]
    assert nearest.nearest(vectors.filter("vec_id < 0"), vectors.filter("vec_id < 0")).count() == 0
