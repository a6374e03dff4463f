"""Operators 1, 2 and 3."""

import numpy as np
import pytest

from ratingloom.llm import forest, pages, topk
from ratingloom.llm.asking import Best

ODD = [
    (None, [1.0, 0.0]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf"), 1.0]), (5, [0.0, 0.0]),
    (6, []), (20, [0.5, -0.25]), (20, [0.5, -0.25]), (21, [0.5, -0.25]), (22, [1.0, -0.5, 3.0]), (40, [-1.0, 0.0]), (41, [-0.0, 2.0]),
]


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else list(v), "x") for i, v in rows], "vec_id long, embedding array<float>, score string")


def brute_top(rows, modulus, k):
    usable = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows
              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in {i: a for i, a in reversed(usable) if i % modulus == 0}.items():
        scored = []
        for i, b in usable:
            if i != q:
                n = min(len(a), len(b))
                scored.append((-int(a[:n] @ b[:n]), i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e15])
def test_top_k_agrees_with_brute_force(spark, scale):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8).round(1) * scale / (1e8 if scale > 1 else 1)).tolist()) for i in range(300)]
    rows += [(300 + i, rows[4][1]) for i in range(60)]
    found = topk.top_k(vectors(spark, rows), modulus=7, k=5)
    assert sorted(map(tuple, found.collect())) == brute_top(rows, 7, 5)


def test_top_k_odd_rows(spark):
    df = vectors(spark, ODD)
    assert sorted(map(tuple, topk.top_k(df).collect())) == brute_top(ODD, 20, 20)
    assert topk.top_k(df.limit(0)).count() == 0


def searched(matrix, queries, own, k):
    """The k best and the share of vectors scored, over shards of 1,000 with one carried state."""
    best, scored = Best(len(queries), k), 0
    for at in range(0, len(matrix), 1000):
        shard = topk.Shard(np.arange(at, min(at + 1000, len(matrix))), matrix[at : at + 1000])
        scored += shard.search(queries, own, best)
    want = []
    for q, (a, o) in enumerate(zip(queries, own)):
        found = sorted((-int(s), i) for i, s in enumerate(matrix @ a) if i != o)[:k]
        want += [(q, i, -s) for s, i in found]
    assert list(zip(best.group.tolist(), best.ids.tolist(), best.scores.tolist())) == want
    return scored / (len(matrix) * len(queries))


def test_threshold_stops_early():
    rng = np.random.default_rng(2)
    matrix = np.sort(rng.integers(0, 100, (2000, 3)), axis=0)[::-1]
    assert searched(matrix, np.array([[2, 1, 1], [1, 0, 3]]), np.array([-1, 4]), 5) < 0.25


def test_threshold_bound_is_carried_to_later_shards():
    rng = np.random.default_rng(3)
    matrix = rng.integers(-9, 10, (6000, 4))
    matrix[:1000] += rng.integers(0, 2, (1000, 1)) * 40  # only the first shard holds winners
    queries = rng.integers(1, 9, (50, 4))
    assert searched(matrix, queries, np.arange(50), 5) < 0.4


def test_threshold_stays_exact_where_nothing_can_be_skipped():
    rng = np.random.default_rng(4)
    matrix = rng.integers(-9, 10, (2500, 24))
    assert searched(matrix, matrix[:40] - 1, np.arange(40), 7) >= 1


def test_top_k_in_passes_of_bounded_queries(spark, monkeypatch):
    monkeypatch.setattr(topk.in_passes, "__defaults__", (3000,))
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(300)]
    assert sorted(map(tuple, topk.top_k(vectors(spark, rows), modulus=7, k=5).collect())) == brute_top(rows, 7, 5)


def brute_links(rows, bound=0.9):
    ok = [(k, np.array(v, float)) for k, (i, v) in enumerate(rows)
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, label = {}, {i: i for i, _ in rows if i is not None}
    pairs = []
    for x, (a, u) in enumerate(ok):
        for b, v in ok[:x]:
            if len(u) == len(v) and u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= bound:
                links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
                pairs.append((rows[a][0], rows[b][0]))
    for _ in range(len(rows)):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return sorted(((i, links.get(k, 0), label.get(i), i is not None and label[i] == i) for k, (i, _) in enumerate(rows)), key=str)


def clusters(seed, sizes, width=16, spread=0.05, more=200):
    rng = np.random.default_rng(seed)
    rows = []
    for size in sizes:
        centre = rng.normal(size=width)
        centre /= np.linalg.norm(centre)
        rows += (centre + rng.normal(0, spread, (size, width))).tolist()
    rows += rng.normal(size=(more, width)).tolist()
    rows += [rows[0]] * 5
    return list(enumerate([np.array(r, np.float32).tolist() for r in rows]))


def test_forest_recall(spark):
    rows = clusters(3, (2, 3, 10, 40, 80))
    found = sorted(map(tuple, forest.near_vectors(vectors(spark, rows), leaf=32).collect()), key=str)
    want = brute_links(rows)
    assert [f[0] for f in found] == [w[0] for w in want]
    assert all(f[1] <= w[1] for f, w in zip(found, want))
    assert sum(f[1] for f in found) >= 0.95 * sum(w[1] for w in want)
    assert sum(f[2] == w[2] for f, w in zip(found, want)) >= 0.95 * len(want)


def test_forest_splits_large_leaves_and_tiles_tight_ones(spark):
    rows = clusters(4, (150, 5, 5), spread=0.02)
    found = sorted(map(tuple, forest.near_vectors(vectors(spark, rows), leaf=64, most=80, tile=37).collect()), key=str)
    want = brute_links(rows)
    assert all(f[1] <= w[1] for f, w in zip(found, want))
    assert sum(f[1] for f in found) >= 0.95 * sum(w[1] for w in want)


def test_forest_keeps_a_large_group_of_differing_copies_whole(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=64)
    group = centre / np.linalg.norm(centre) + rng.normal(0, 0.03, (2000, 64))
    matrix = np.concatenate((group, rng.normal(size=(4000, 64)))).astype(np.float32).astype(float)
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    found = dict(forest.near_vectors(vectors(spark, list(enumerate(matrix.tolist())))).select("vec_id", "n_links").collect())
    found = np.array([found[i] for i in range(len(want))])
    assert want[:2000].mean() > 1500 and (found <= want).all()
    assert found.sum() >= 0.99 * want.sum()


def test_forest_odd_rows(spark):
    df = vectors(spark, ODD)
    assert sorted(map(tuple, forest.near_vectors(df).collect()), key=str) == brute_links(ODD)
    assert forest.near_vectors(df.limit(0)).count() == 0


def site(body, k, host="a.example"):
    page = f"<!doctype html><html><head><title>T{k}</title><style>p{{}}</style></head><body><header class='site-header'>Site</header>{body}</body></html>"
    return (k, f"https://{host}/p/{k}?x=1", page, "x")


def test_main_text(spark):
    rows = [
        site(
            f"<nav><a href=x>Home {k}</a></nav><div class=cookie-notice>We use {k}</div>"
            f"<article id=post-{k}><h1>Title&nbsp;{k}</h1><p>First <b>bo</b>ld &amp; {k}<p>Second\n\n line<br>after {k}"
            f"<aside>Related {k}</aside><div class='share'>Share</div><footer>By me</footer></article>"
            f"<section class=comments><article><p>Nice {k}!</p></article></section>"
            "<script>if (a < b) { x = '</p>' }</script><form><p>Join</p></form><footer>&copy; 1</footer>", k)
        for k in range(8)
    ]
    found = {r.page_id: r for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    for k in range(8):
        want = f"Title {k} First bold & {k} Second line after {k}"
        assert found[k].text == want and found[k].n_chars == len(want)


def test_main_text_without_article_element(spark):
    rows = [
        site(f"<div id=top><a href=/>Home</a></div><div class=wrap><p>Same on all</p><div class=txt><p>Story {k} one.</p><p>Two {k}</p></div></div>", k, "b.example")
        for k in range(6)
    ]
    found = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, x string")).collect()}
    assert all(found[k].endswith(f"Story {k} one. Two {k}") and "Home" not in found[k] for k in range(6))


def test_theme_classes_do_not_empty_a_page(spark):
    bodies = ["has-sidebar", "with-sidebar", "no-sidebar", "comments-open", "nav-open"]
    articles = ["post category-social-media", "tag-search-engines", "post"]
    rows, every = [], [(b, "post", "wrap") for b in bodies] + [("", a, "wrap") for a in articles]
    every += [("", "post", "has-sidebar"), ("", "post", "layout-sidebar"), ("", "post", "sidebar")]
    for n, (body, article, around) in enumerate(every):
        for k in range(6):
            html = (
                f"<html><body class='{body}'><div class=nav-menu>Go {k}</div><div class='{around}'><article class='{article}'><p>Text {k}</p>"
                f"<div class=share-buttons>Share {k}</div><div class=ad-slot>Buy {k}</div></article></div><div class=widget-area>W {k}</div></body></html>"
            )
            rows.append((10 * n + k, f"http://h{n}.example/{k}", html))
    found = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: f"Text {i % 10}" for i, _, _ in rows}


def test_form_around_the_page():
    root, pieces = pages.parse("<form id=f><div class=nav>N</div><article><p>Text</p></article><form class=x>in</form></form>")
    pages._number(root)
    sums = {}
    for node, _, text in pieces:
        sums.setdefault(id(node), pages._Sums()).add(1, len(text), 0, 1, 1)
    kept = pages.content_nodes(root, sums, 1)
    assert [t.strip() for n, _, t in pieces if id(n) in kept] == ["Text"]


def test_main_text_odd_pages(spark):
    rows = [
        (1, None, None, "x"), (2, "http://h/", "", "x"), (3, "http://h/", "plain words", "x"), (4, "http://h/1", "<article><p>cut of", "x"),
        (4, "http://h/1", "<article><p>cut of", "x"), (None, "http://h/2", "<article>&lt;b&gt; &#233; <!-- no --> x</article>", "x"),
        (6, "http://h/3", "<div>" * 3000 + "<article>deep</article>", "x"), (7, "http://h/4", "<article><p title=\"a>b\">q</p>" + "<p>long text</p>" * 4000, "x"),
        (8, "http://h/5", "<script>never closed <article>x</article>", "x"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    found = sorted(((r.page_id, r.text) for r in pages.main_text(df).collect()), key=str)
    want = [(1, ""), (2, ""), (3, "plain words"), (4, "cut of"), (4, "cut of"), (None, "<b> é x"), (6, "deep"), (7, "q" + " long text" * 4000), (8, "")]
    assert found == sorted(want, key=str)
    assert pages.main_text(df.limit(0)).count() == 0


def test_tree_matching():
    one, two = pages.read_shape("a(b(c,d),e,f)"), pages.read_shape("a(b(d),x,f)")
    score, pairs = pages.match(one, two)
    assert score == 4 and {p.label for p, _ in pairs} == {"a", "b", "d", "f"}
    assert pages.read_shape(one.text()).text() == one.text()


def test_adverts_by_any_class_word_and_at_any_depth(spark):
    deep, out = "<section>" * 60, "</section>" * 60
    rows = []
    for k in range(6):
        rows.append((k, f"http://a.example/{k}", f"<article><p>Text {k}</p><div class='a b c d e advert'>Buy {k}</div><p>more {k}</p></article>"))
        rows.append((10 + k, f"http://b.example/{k}", f"<article><p>Text {k}</p>{deep}<p>low {k}</p><aside>Side {k}<article>x</article></aside>{out}</article>"))
        rows.append((20 + k, f"http://c.example/{k}", f"<body>{deep}<p>Menu {k}</p><article><p>Text {k}</p></article>{out}</body>"))
    found = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(6):
        assert [found[k], found[10 + k], found[20 + k]] == [f"Text {k} more {k}", f"Text {k} low {k}", f"Text {k}"]
