"""Main text of pages: the tree model against enumeration, and pages of other layouts."""

import itertools

import numpy as np
import pytest

from rinse.llm.dom import parse
from rinse.llm.html_extraction import (
    CONTENT,
    Model,
    default_model,
    extract,
    forest,
    gradient,
    label_of,
    main_texts,
    marginals,
    potentials,
    train,
)
from rinse.llm.labelled_pages import labelled_pages

PROSE = "The quick brown fox jumped over the lazy dog, and then it went home. It slept for a long time."


def random_model(trees, seed=3):
    rng = np.random.default_rng(seed)
    names = {name: at for at, name in enumerate(["any", "text", "tag p", "tag div", "name ad", "words 2", "linked 0"])}
    return Model(names, rng.normal(size=(len(names), 3)), rng.normal(size=(3, 3, 3)))


def by_enumeration(trees, model):
    """Probabilities of labels and the logarithm of the sum over all labellings."""
    own, n = potentials(trees, model), len(trees.parents)
    total, each = 0.0, np.zeros((n, 3))
    for labels in itertools.product(range(3), repeat=n):
        score = sum(own[at, label] for at, label in enumerate(labels))
        for at, parent in enumerate(trees.parents):
            if parent >= 0:
                score += model.pairs[trees.kinds[at], labels[parent], labels[at]]
        weight = np.exp(score)
        total += weight
        each[np.arange(n), labels] += weight
    return each / total, np.log(total)


SMALL = ["<p>a b<div class=ad>x</div>y", "<div><p>a<p>b</div>", "text", ""]


def test_sum_product_equals_enumeration():
    model = random_model(SMALL)
    for page in SMALL:
        trees = forest([parse(page)], model.known)
        assert np.allclose(marginals(trees, model), by_enumeration(trees, model)[0])
    together = marginals(forest([parse(page) for page in SMALL], model.known), model)
    alone = [marginals(forest([parse(page)], model.known), model) for page in SMALL]
    assert np.allclose(together, np.concatenate(alone))


def test_gradient_equals_differences():
    tree = parse('<div data-label="content"><p>a b</p><div class="ad" data-label="other">x</div></div>z')
    model = random_model([tree])
    trees, labels = forest([tree], model.known), label_of(tree)
    value, slope = gradient(trees, labels, model)
    own = potentials(trees, model)
    direct = own[np.arange(len(labels)), labels].sum() - by_enumeration(trees, model)[1]
    direct += sum(model.pairs[trees.kinds[at], labels[p], labels[at]] for at, p in enumerate(trees.parents) if p >= 0)
    assert np.isclose(value, direct)
    for weights, found in ((model.nodes, slope.nodes), (model.pairs, slope.pairs)):
        for place in np.ndindex(weights.shape):
            kept = weights[place]
            weights[place] = kept + 1e-5
            more = gradient(trees, labels, model)[0]
            weights[place] = kept
            assert np.isclose((more - value) / 1e-5, found[place], atol=1e-3)


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("a&amp;b &lt;i&gt; &#233;&nbsp;&copy", ["a&b <i> é ©"]),
        ("<p>x<b>y</b> z<br>w<p>next", ["xy z w", "next"]),
        ("a<script>if (a</p>b) {}</script>b<style>p</style>c<!-- <p>d -->e", ["a", "b", "ce"]),
        ("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>", ["1", "2", "3", "4"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("a</b></div></x>b <span hidden>no</span><div style='display: none'>no</div>c", ["ab", "c"]),
        ("5 < 6 <7> <p title='a>b'>x</p><a href=\"x", ["5 < 6 <7>", "x"]),
        ("<title>no</title><textarea><p>no</textarea><noscript>no</noscript><select><option>no</select>yes", ["yes"]),
        ("<P>a\t\n b\r\n</P>\n<DIV>c</DIV>", ["a b", "c"]),
        ("<!doctype html><?x?></ >a<p/>b", ["a", "b"]),
        ("<script>never closed <p>a", []),
        ("a<!-- never closed", ["a"]),
        ("", []),
    ],
)
def test_runs_of_text(page, texts):
    tree = parse(page)
    assert [text for text in tree.texts if text] == texts
    assert all(parent < at for at, parent in enumerate(tree.parents))


def test_odd_pages_take_linear_time():
    for page in ("<div>" * 20_000 + "x" + "</b>" * 20_000, '<a "' * 50_000, "<p" * 50_000, "<!--" * 50_000, "&" * 200_000, "</p>" * 50_000):
        parse(page)
    assert len(main_texts(["<div>" * 3_000 + "x"], default_model())) == 1


LAYOUTS = {
    "blog": f'<div id="page"><header class="site-header"><h1><a href="/">DROP</a></h1><nav><ul><li><a>DROP</a></ul></nav></header>'
    f'<main><article class="post"><header class="entry-header"><h1>KEEP title</h1></header><div class="entry-content"><p>KEEP {PROSE}'
    f'<h2>KEEP head</h2><p>KEEP <a href=x>{PROSE}</a></p><ul><li>KEEP one<li>KEEP two</ul></div></article><div id="comments"><ol><li class="comment">'
    f'<p>DROP {PROSE}</p></ol><form><p>DROP</p></form></div></main><aside class="widget-area"><p>DROP {PROSE}</p></aside></div><footer>DROP</footer>',
    "names": f'<div class="cookie-banner"><p>DROP {PROSE}</p></div><div class="story-body"><h1>KEEP t</h1><p>KEEP {PROSE}</p><div class="ad-container">'
    f'DROP {PROSE}</div><blockquote>KEEP {PROSE}</blockquote></div><div class="related-links"><p>DROP {PROSE}</p></div><div class="footer">DROP {PROSE}</div>',
    "table": f'<table><tr><td class="menu"><a href=x>DROP</a><td class="content"><h2>KEEP h</h2><p>KEEP {PROSE}<p>KEEP {PROSE}</table><div id="footer">DROP</div>',
    "bare": f"<h1>KEEP h</h1><p>KEEP {PROSE}</p><p>KEEP {PROSE}</p>",
    "inside": f'<nav>DROP <a>x</a></nav><div role="alert">DROP {PROSE}</div><article><p>KEEP {PROSE}</p><aside><p>DROP {PROSE}</p></aside>'
    f"<form><p>DROP {PROSE}</p></form><p>KEEP {PROSE}</p></article><div class=sponsored>DROP {PROSE}</div><section class=reader-comments><p>DROP {PROSE}</p></section>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts_written_by_hand(name):
    found = main_texts([LAYOUTS[name]], default_model())[0]
    assert found.count("KEEP") == LAYOUTS[name].count("KEEP")
    assert "DROP" not in found


def test_held_out_layouts():
    model, right, runs, whole = default_model(), 0, 0, 0
    pages = labelled_pages(200, seed=99)
    for page in pages:
        tree = parse(page)
        wanted = label_of(tree) == CONTENT
        found = marginals(forest([tree], model.known), model)[:, CONTENT] > 0.5
        texts = np.array([bool(text) for text in tree.texts])
        right, runs = right + int((wanted == found)[texts].sum()), runs + int(texts.sum())
        whole += bool((wanted == found)[texts].all())
    assert right / runs > 0.98 and whole / len(pages) > 0.8


def test_rows_of_pages(spark):
    page = LAYOUTS["names"].replace("KEEP", "KEEP &eacute;")
    rows = [(1, "u", page, "t", 1), (1, "u", page, "t", 1), (None, None, None, None, None), (2, "", "", "", 2), (3, "v", "<nav><a>x</a></nav>", "t", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    found = extract(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(map(tuple, found.collect()), key=repr)
    text = f"KEEP é t KEEP é {PROSE} KEEP é {PROSE}"
    assert got == sorted([(1, "u", text, len(text))] * 2 + [(None, None, "", 0), (2, "", "", 0), (3, "v", "", 0)], key=repr)
    assert extract(pages.limit(0)).count() == 0


def test_a_model_of_own_labels(spark):
    """What the labels say is learned, whatever it is."""
    pages = [f'<div class="keep" data-label="content"><p>{at}</p></div><div class="drop" data-label="other"><p>{at}</p></div>' for at in range(20)]
    model = train(pages, steps=60)
    assert main_texts(['<div class="drop"><p>a</p></div><div class="keep"><p>b</p></div>'], model) == ["b"]
