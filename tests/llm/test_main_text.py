"""Main text: layouts, markup faults, character references and the scan itself."""

import itertools
import random
import time

import pytest

from readprism.llm import main_text as M

NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
FOOT = '<footer>&copy; site &middot; all rights</footer>'
SCORES = M.Scores({"p": 2.0, "h1": 2.0, "li a": -1.0, "div": 0.5, "body": 0.5, "li": 0.3}, {"p": -0.05, "div": -0.5, "li": -0.4, "ul": -1.0, "a": -1.0})


def page(body, head="<title>T</title><style>p{}</style><script>var t='</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


CASES = [
    (page(f"{NAV}<article><h1>Head line</h1><p>One  two\n three.<p>Four &amp; five&#33;</article>{FOOT}"), "Head line One two three. Four & five!"),
    (page(f'{NAV}<div class="ad">Buy now</div><article><h1>A</h1><p><b>B<br><p>c</p></article>{FOOT}'), "A B c"),
    (page(f"{NAV}<div><h1>Head</h1><p>Plain page text goes here.</p><p>And more of it.</p></div>{FOOT}"), "Head Plain page text goes here. And more of it."),
    (page("<article><p>fo<b>o</b>b<i>ar</i></p><ul><li>x</li><li>y</li></ul><table><tr><td>1</td><td>2</td></tr></table></article>"), "foobar x y 1 2"),
    (page('<article><p>Text</p><div class="comments"><p>I like it</p></div><aside>More</aside><form><label>Mail</label></form><script>x()</script><p>end</p></article>'), "Text end"),
    (page('<header>Site</header><main><header><h1>Title</h1></header><p>Body</p><div id="cookie-notice">We use</div></main>'), "Title Body"),
    (page("<nav><ul><li>unclosed<article><p>kept</p></article>"), "kept"),
    (page("<article><p>cut off here and"), "cut off here and"),
    (page("<article><p>a <!-- no --> b < c &lt;d&gt; <![CDATA[no]]> e</p></article>"), "a b < c <d> e"),
    (page('<article><p title="a>b">q</p><p hidden>no</p><p style="display: none">no</p><p aria-hidden="true">no</p></article>'), "q"),
    (page("<article>   </article>"), ""),
    ("just words without markup", "just words without markup"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize(("html", "expected"), CASES)
def test_pages(html, expected):
    assert M.extract(html, SCORES) == expected


def test_whole_tables(spark):
    rows = [(i, "u", h, "text") for i, (h, _) in enumerate(CASES)] + [(None, None, CASES[0][0], "x"), (0, "u", CASES[0][0], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = M.main_texts(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert all(by[i] == e for i, (_, e) in enumerate(CASES) if i not in (2, 11))
    assert M.main_texts(df.where("false")).count() == 0
    long = "<p>" + "word " * 50_000 + "</p>"
    assert len(M.extract(page(f"<article>{long * 3}</article>"), SCORES)) == 3 * 250_000 - 1


def test_scan_is_optimal():
    rng = random.Random(1)
    for _ in range(300):
        v = [rng.choice([-2, -1, -0.5, 0, 1, 2]) for _ in range(rng.randint(0, 12))]
        a, b = M.best_stretch(v)
        assert sum(v[a:b]) == max([0, *(sum(v[i:j]) for i, j in itertools.combinations(range(len(v) + 1), 2))])


def test_scores_are_learned(spark):
    df = spark.createDataFrame([(CASES[0][0],), (CASES[1][0],), (None,), ("no marks",)], "html string")
    scores = M.fit(df)
    assert scores.word["p"] > 0 > scores.word["li a"] and scores.tag["p"] > scores.tag["nav"] and all(v < 0 for v in scores.tag.values())


def learned(spark, pages):
    return M.fit(spark.createDataFrame([(h,) for h in pages], "html string"))


def test_unmarked_pages_with_learned_scores(spark):
    adverts = [page(f'{NAV}<div class="ad">Buy these now please</div><article><h1>Head</h1><p>Some text {i}</p></article>') for i in range(50)]
    for scores in (learned(spark, adverts), learned(spark, [h for h, _ in CASES])):
        assert scores.word["li a"] < 0 and all(v > 0 for c, v in scores.word.items() if c != "li a")
        for i in (2, 11):
            assert M.extract(CASES[i][0], scores) == CASES[i][1]
        assert M.extract(page(f"{NAV}<div>{'word ' * 30}<br>{'more ' * 30}</div><div class='ad'>Buy</div>{FOOT}"), scores) == ("word " * 30 + "more " * 30).strip()


def test_dropped_elements_do_not_split_unmarked_pages():
    first, last, links = "one " * 200, "last " * 20, "<li><a href='/x'>see this one</a></li>" * 40
    for box in (f'<div class="related">{"other " * 800}</div>', f"<aside><ul>{links}</ul></aside>", f"<form>{'field ' * 500}</form>", f'<div id="newsletter"><ul>{links}</ul></div>'):
        html = page(f"{NAV}<div><p>{first}</p>{box}<p>{last}</p></div>{FOOT}")
        assert M.extract(html, SCORES) == (first + last).strip()


@pytest.mark.parametrize("size", [10, 70_000, 400_000])
@pytest.mark.parametrize("quote", ["'", '"'])
def test_long_attributes(quote, size):
    state = "<b>leak</b> a>b " * (size // 16 + 1)
    assert M.extract(page(f"<article><p data-state={quote}{state}{quote}>text</p><p>end</p></article>"), SCORES) == "text end"
    assert M.extract(f"<article><p>text</p><p title={quote}never closed>{'end ' * size}", SCORES) == "text " + ("end " * size).strip()


def test_scores_decide_on_marked_pages(spark):
    html = page(f"{NAV}<p>{'before ' * 3}</p><article><p>{'inside ' * 9}</p></article>{FOOT}")
    scores = learned(spark, [html] * 3 + [page(f"<p>a b</p><article><p>c {i}</p></article>") for i in range(20)])
    assert scores.word["in p"] > 0 > scores.word["out p"] and M.extract(html, scores) == ("inside " * 9).strip()
    assert M.extract(html.replace("article", "div"), scores) == ("before " * 3 + "inside " * 9).strip()
    scores.word["out p"], scores.word["in p"] = 5.0, -5.0
    assert M.extract(html, scores) == ""  # words outside of a mark are never returned


def test_the_fit_is_bounded_and_distinct(spark):
    df = spark.createDataFrame([(f"<article>{i % 30}</article>",) for i in range(300)] + [("none",), (None,)], "html string")
    assert M.labelled(df, 8).count() == 8 and M.labelled(df, 99).count() == 30 and M.labelled(df.where("html is null"), 9).count() == 0


def test_classes_by_all_their_words():
    def inside(attribute):
        return M.extract(page(f"<article><p>start</p><div {attribute}><p>middle</p></div><p>end</p></article>"), SCORES)

    for kept in ("class=related-work", "id=search-results", "class='notice-of-intent'", "class=ad-hoc", "class=promotional"):
        assert inside(kept) == "start middle end", kept
    for gone in ("class=related-posts", "id=cookie-notice", "class='box ad-slot-3'", "class=newsletter", "id=comments", "role=navigation"):
        assert inside(gone) == "start end", gone
    assert M.extract(page("<article><p>text</p><article class=comment><p>me too</p></article></article>"), SCORES) == "text"


def test_deep_link():
    deep = "<li><a href='/x'>" + "<span>" * 50 + "menu" + "</span>" * 50 + "</a></li>"
    assert [t.context for t in M.tokens(f"<ul>{deep}</ul>") if t.words] == ["li a"]


def test_against_all_stretches():
    """The text of a page is that of the best of all stretches of its tokens, the first and longest of equals."""
    rng = random.Random(9)
    bits = ["<p>", "</p>", "<div>", "</div>", "<li><a>", "</a></li>", "word ", "two words ", "<b>", "</b>", "<br>", "<article>", "</article>", "<div class=ad>x</div>", "&amp;"]
    pages = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(150)]
    scores = M.Scores({"p": 2.0, "li a": -1.0, "div": 0.5, "in p": 1.5, "out p": -1.0}, {"p": -0.25, "div": -0.5, "in div": -0.25, "li": -0.5})
    for html in pages:
        toks = M.tokens(html)
        values = [scores.of(t) for t in toks]
        sums = {(i, j): round(sum(values[i:j]), 9) for i in range(len(toks)) for j in range(i + 1, len(toks) + 1)}
        top = max(sums.values(), default=0)
        words = {"".join(t.text if t.kind == "text" else "" if t.name in M.INLINE else " " for t in toks[a:b] if t.kind != "text" or t.place in ("plain", "marked")) for (a, b), v in sums.items() if v == top} if top > 0 else {""}
        assert M.extract(html, scores) in {" ".join(w.replace("&amp;", "&").split()) for w in words}, html


def test_deep_nesting_takes_linear_time():
    n = 30_000
    pages = ["<div>" * n + "</span>" * n, "<div><p>w " * n, "<article>" * n + "</div>" * n, "<div>" * n + "<main>" * n, "<ul>" * n + "word" + "</ul>" * n]
    began = time.perf_counter()
    assert [len(M.tokens(p)) for p in pages] == [2 * n, 3 * n, 2 * n, 2 * n, 2 * n + 1]
    assert time.perf_counter() - began < 20


def test_open_elements_are_those_of_a_walk():
    """End tags against a walk over all open elements."""
    rng = random.Random(5)
    for _ in range(300):
        opened, walked = M._Open(), []
        for _ in range(60):
            name = rng.choice(["div", "p", "article", "main", "body", "nav"])
            if rng.random() < 0.55:
                dropped = bool(walked and walked[-1][1]) or rng.random() < 0.1
                opened.push(name, dropped, False, name, False)
                walked.append((name, dropped, False, name, False))
            else:
                opened.close(name)
                for i in range(len(walked) - 1, -1, -1):
                    if walked[i][0] == name:
                        del walked[i:]
                        break
                    if walked[i][0] in ("article", "main") and name != "body":
                        break
            assert opened.stack == walked
            assert opened.first_dropped() == next((i for i, s in enumerate(walked) if s[1]), len(walked))
