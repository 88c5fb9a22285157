import math
import random
import time

import pytest

from tallyloom.llm.html_text import INLINE, extract, main_text, parse, weigh

LONG = "It was a long winter in the valley, and the people of the village had begun to count their stores again."
BODY = f"<h1>Title &amp; more</h1><p>{LONG}</p><p>One <b>bold</b>word\n\t and&nbsp;space.<br>Next</p><p>{LONG}"
WANT = f"Title & more\n\n{LONG}\n\nOne boldword and space. Next\n\n{LONG}"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a href=/x>Home</a></ul></nav><article>{BODY}</article><footer>&copy; us</footer></body></html>",
        f"<body><header><h2>Site</h2></header><main>{BODY}</main><aside><p>{LONG}</p></aside><div id='comments'><p>{LONG}</p><p>{LONG}</p></div>",
        f"<div class='menu'><a>1</a><a>2</a></div><div class='no-sidebar wide'>{BODY}<script>var x='</p>';</script></div><!-- {LONG} --><div class=ad>{LONG}</div>",
        f"<article><form><input><p>{LONG}</form>{BODY}</article><div class='cookie-notice'>{LONG}</div>",
        f"<table><tr><td><ul><li><a href=a>One thing</a><li><a href=b>Another thing</a><li><a href=c>A third thing</a></ul><td><div>{BODY}</div></table>",
        f"<ARTICLE>{BODY}</ARTICLE><SCRIPT>if (a<b) {{ x('<p>{LONG}</p>') }}",
    ],
)
def test_article(page):
    assert main_text(page) == WANT


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<p> </p>") == main_text("<script>x</script>") == ""
    assert main_text("only text &lt;b&gt; 5 < 6") == "only text <b> 5 < 6"
    assert main_text("<p>a</p></div></p></b><p>b") == "a\n\nb"
    assert main_text("<a href='x>") == ""
    deep = "<div>" * 20_000 + LONG + "</div>" * 20_000
    assert main_text(deep) == LONG
    assert main_text("<p>" + "word " * 300_000 + "</p>") == ("word " * 300_000).strip()


def test_links_lower_density():
    root = parse(f"<div><p>{LONG}</p></div><div><p><a>{LONG}</a></p></div>")
    weigh(root)
    plain, links = [k for k in root.kids]
    assert plain.kids[0].density > 3 * links.kids[0].density


def test_rows(spark):
    rows = [(1, "u", f"<article>{BODY}</article>", "keep"), (2, None, None, "keep"), (3, "v", "", None), (3, "v", "", None)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, text string")
    got = sorted(map(tuple, extract(df, keep=["page_id", "url"]).collect()), key=str)
    assert got == sorted([(1, "u", WANT, len(WANT)), (2, None, "", 0), (3, "v", "", 0), (3, "v", "", 0)], key=str)
    assert extract(df).columns == ["page_id", "url", "text", "n_chars"] and extract(df.limit(0)).count() == 0


MANY = "".join(f"<p>{LONG} {LONG} {LONG} {i}</p>" for i in range(10))
MANY_WANT = "\n\n".join(f"{LONG} {LONG} {LONG} {i}" for i in range(10))


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body><article><header><h1>T</h1></header><div class=body>{MANY}</div></article><p>by</p>", f"T\n\n{MANY_WANT}"),
        (f"<article><h1>T</h1><p>intro</p><section>{MANY[: len(MANY) // 10 * 5]}</section><section>{MANY}</section></article>", None),
        (f"<main><h1>T</h1><article><p>intro</p><div>{MANY}</div><ul><li>one</li><li>two</li></ul></article></main>", f"T\n\nintro\n\n{MANY_WANT}\n\none\n\ntwo"),
        (f"<article><h1>T</h1><article><h2>A</h2>{MANY}</article><article><h2>B</h2><div>{MANY}</div></article></article>", f"T\n\nA\n\n{MANY_WANT}\n\nB\n\n{MANY_WANT}"),
        (f"<div><div><h1>T</h1><p>intro</p><section>{MANY}</section><section>{MANY}</section></div></div>", f"T\n\nintro\n\n{MANY_WANT}\n\n{MANY_WANT}"),
        (f"<div><div>{MANY}</div></div><p>{MANY_WANT}</p>", f"{MANY_WANT}\n\n{' '.join(MANY_WANT.split())}"),
        (f"<main><article><h2>A</h2><div>{MANY}</div></article><article><h2>B</h2><div>{MANY}</div></article><ul><li><a>x</a><li><a>y</a></ul></main>", f"A\n\n{MANY_WANT}\n\nB\n\n{MANY_WANT}"),
    ],
)
def test_text_beside_the_densest_container_stays(page, want):
    got = main_text(page)
    assert got == want if want else got.startswith("T\n\nintro\n\n") and got.endswith(MANY_WANT)


TWO = f"<p>{LONG}</p><p>Second. {LONG}</p>"
TWO_WANT = f"{LONG}\n\nSecond. {LONG}"
SAYS = "".join(f"<div class=c{{}}><b>Ann {i}</b><p>{LONG} {LONG} I say {i}.</p></div>" for i in range(12))


@pytest.mark.parametrize(
    "page, want",
    [
        # names of parts of an article aren't names of what isn't article
        ("<article><h1>T</h1><p>The price was <span class='share-price'>12 euros</span> a piece.</p></article>", "T\n\nThe price was 12 euros a piece."),
        (f"<article><p>{LONG}</p><section class='related-work'><h2>Related work</h2><p>x y z</p></section></article>", f"{LONG}\n\nRelated work\n\nx y z"),
        (f"<article><p>{LONG}</p><section id=discussion><h2>Discussion</h2><p>x y z</p></section></article>", f"{LONG}\n\nDiscussion\n\nx y z"),
        (f"<article><p>{LONG}</p><div class='notice-period'><p>Four weeks.</p></div><p class=comment>My own.</p></article>", None),
        (f"<article>{TWO}<ul><li>In 2019 it rained.</li><li>In 2020 it did not.</li></ul></article>", f"{TWO_WANT}\n\nIn 2019 it rained.\n\nIn 2020 it did not."),
        (f"<body><div class=post-header><h1>T</h1></div><div>{MANY}</div>", f"T\n\n{MANY_WANT}"),
        # containers that are named so go
        (f"<article>{TWO}<div class='share-buttons'><p>Tweet</p></div><div class=related-posts><p>{LONG}</p></div><span class=ad>Buy</span></article>", TWO_WANT),
        (f"<div id=header><p>Our site, {LONG}</p></div><div class=left-sidebar><p>{LONG}</p></div><article>{TWO}</article><div role=contentinfo>{LONG}</div>", TWO_WANT),
        # comments lose to the article, whatever they are called
        (f"<article>{TWO}</article><div class='discussion'>{SAYS}</div>", TWO_WANT),
        (f"<article>{TWO}</article><div class='zzz'>{SAYS}</div>", TWO_WANT),
        (f"<div class=post>{TWO}</div><div id='responses'>{MANY}</div>", TWO_WANT),
        (f"<body>{TWO}<div id='responses'>{MANY}</div>", TWO_WANT),
        (f"<body><div>{TWO}</div><div class=zzz><h3>12 Comments</h3>{SAYS}</div>", TWO_WANT),
        (f"<body><div class=a><h1>T</h1>{TWO}</div><div class=b>{SAYS}</div>", f"T\n\n{TWO_WANT}"),
        (f"<body><div>{TWO}</div><ul>{''.join(f'<li><cite>Bo</cite><time>now</time><p>{LONG}</p></li>' for _ in range(9))}</ul>", TWO_WANT),
        (f"<article>{TWO}<section><h2>3 comments</h2>{''.join(f'<div class=z><time>now</time><p>{LONG}</p></div>' for _ in range(3))}</section></article>", TWO_WANT),
        # the title in a block of its own
        (f"<body><div class=top-story><div class=t><h1>Title</h1></div><div class=body>{MANY}</div></div><div><a>x</a> <a>y</a></div>", f"Title\n\n{MANY_WANT}"),
        (f"<body><div class=t><h1>Title</h1><p>By us</p></div><p>intro</p><div class=body>{MANY}</div>", f"Title\n\nBy us\n\nintro\n\n{MANY_WANT}"),
        (f"<body><h1>Title</h1><article>{TWO}</article>", f"Title\n\n{TWO_WANT}"),
        (f"<body><div class=page-header><h1>Title</h1></div><div class=row><div class=col>{MANY}</div><div class='col sidebar'>{TWO}</div></div>", f"Title\n\n{MANY_WANT}"),
        (f"<header><h1>Site</h1></header><div class=post><h2>Title</h2><div class=meta>By Ann</div><div>{MANY}<h2>Sub</h2>{TWO}</div></div><div id=comments><h3>2</h3></div>", f"Title\n\nBy Ann\n\n{MANY_WANT}\n\nSub\n\n{TWO_WANT}"),
        (f"<div id=wrap><h1>T</h1><section>{TWO}</section><section class=newsletter-signup>{TWO}</section></div>", f"T\n\n{TWO_WANT}"),
    ],
)
def test_what_is_article(page, want):
    got = main_text(page.replace("c{}", "c"))
    assert got == want if want else "Four weeks." in got and "My own." in got


@pytest.mark.parametrize("unit", ["<div></b></i>", "<li></p>", "<div><b></span>", "<ul><li></ol>", "<main></article>", "<p><i></a>", "<nav><div></p>", "<div title='x></div>", "<table><tr><td></li>"])
def test_broken_markup_takes_linear_time(unit):
    began = time.process_time()
    main_text(f"<p>{LONG}</p>" + unit * 50_000 + f"<p>{LONG}</p>")
    assert time.process_time() - began < 6
    assert main_text("<div>" * 3 + "</b></p></li>" * 3 + f"<p>{LONG}</p>" + "</div>" * 9) == LONG


def slow_weights(node, share):
    """(chars, tags, link chars, link tags, density, sum) from the whole subtree, for each node by its place."""
    below = lambda n: [x for k in n.kids if not isinstance(k, str) for x in (k, *below(k))]
    own = lambda n: sum(1 for k in n.kids if isinstance(k, str) for c in k if not c.isspace())
    chars = lambda n: own(n) + sum(own(x) for x in below(n))
    linked = lambda n: chars(n) if n.tag == "a" else sum(linked(k) for k in n.kids if not isinstance(k, str))

    def density(n):
        c, t, lc, lt = chars(n), max(len(below(n)), 1), linked(n), max(sum(x.tag == "a" for x in below(n)), 1)
        if not c:
            return 0.0
        share_ = linked(node) / max(chars(node), 1)
        base = math.log(c / max(c - lc, 1) * lc + share_ * c + math.e)
        return c / t * math.log(max(c / max(lc, 1) * t / lt, 1.0) + 1e-9) / base

    def total(n):
        return sum(total(k) if k.tag in INLINE else density(k) for k in n.kids if not isinstance(k, str))

    return {id(n): (chars(n), len(below(n)), linked(n), density(n), total(n)) for n in (node, *below(node))}


def test_densities_and_choice_against_brute_force():
    rng = random.Random(7)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return " ".join(rng.choices(["word", "longer", "é"], k=rng.randrange(12)))
        tag = rng.choice(["div", "p", "section", "a", "b", "ul"]) if depth > 1 else rng.choice(["p", "a", "b"])
        return f"<{tag}>{' '.join(tree(depth - 1) for _ in range(rng.randrange(1, 5)))}</{tag}>"

    for _ in range(60):
        root = parse(" ".join(tree(4) for _ in range(4)))
        order = weigh(root)
        want = slow_weights(root, None)
        for n in order:
            got = (n.chars, n.tags, n.link_chars, n.density, n.sum)
            assert got[:3] == want[id(n)][:3] and got[3:] == pytest.approx(want[id(n)][3:])
        blocks_ = [n for n in order if n.tag not in INLINE]
        assert want[id(root.best)][4] == pytest.approx(max(want[id(n)][4] for n in blocks_))


SENTENCE = "The committee met on a Tuesday and spoke for hours about the bridge, the river and the road that leads to the mill. "


def ps(n, word=""):
    return "".join(f"<p>{word} {k} {SENTENCE}</p>" for k in range(n))


def test_article_text_with_names_of_other_things_stays():
    said = lambda page: main_text(page).split("\n\n")
    interview = "<body><h1>Title</h1><p>intro " + SENTENCE + "</p>" + "".join(f"<div class=q><cite>Anna</cite><p>answer {k} {SENTENCE}</p></div>" for k in range(5)) + "</body>"
    assert sum("answer" in x for x in said(interview)) == 5 and "Title" in said(interview)
    history = "<body><h1>Title</h1>" + ps(2) + "<ul>" + "".join(f"<li><time>19{k}0</time> event {SENTENCE}</li>" for k in range(5)) + "</ul></body>"
    assert sum("event" in x for x in said(history)) == 5
    paper = "<body><h1>Title</h1><div class=methods>" + ps(3, "method") + "</div><div class=discussion>" + ps(3, "matter") + "</div></body>"
    assert sum("matter" in x for x in said(paper)) == 3 == sum("method" in x for x in said(paper))
    search = "<body><article><h1>Title</h1>" + ps(2) + "<div class=search>" + ps(3, "index") + "</div></article></body>"
    assert sum("index" in x for x in said(search)) == 3
    widgets = "<body><div class=widgets>" + ps(5, "gear") + "</div></body>"
    assert sum("gear" in x for x in said(widgets)) == 5
    for level in "23456":
        page = f"<body><div><h{level}>The heading</h{level}></div><div class=body>" + ps(4) + "</div></body>"
        assert "The heading" in said(page), level


def test_chrome_by_bare_names_goes():
    links = "".join(f"<li><a href=/{k}>Another story {k}</a></li>" for k in range(6))
    teasers = "".join(f"<div><a href=/{k}>Another story of many words {k}</a><p>teaser {k} of it</p></div>" for k in range(3))
    for name in ("related", "share", "social", "search", "menu", "widgets", "recommended", "login"):
        for inner in (f"<ul>{links}</ul>", teasers, "<p>once only</p>"):
            for page in (f"<body><article><h1>Title</h1>{ps(4)}<div class={name}>{inner}</div></article></body>", f"<body><div class={name}>{inner}</div><h1>Title</h1>{ps(4)}</body>"):
                text = main_text(page)
                assert "Another" not in text and "teaser" not in text and "once" not in text and text.count("committee") == 4, (name, inner)


def test_comments_without_article_go():
    comments = "".join(f"<div class=item><span class=author>Joe {k}</span><p>remark {k} {SENTENCE}</p></div>" for k in range(4))
    dated = "".join(f"<li><time>May {k}</time> remark {k} {SENTENCE}</li>" for k in range(4))
    for page in (
        f"<body><h1>Title</h1>{ps(4)}<div>{comments}</div></body>",
        f"<body><h1>Title</h1>{ps(4)}<div><h3>4 comments</h3><ul>{dated}</ul></div></body>",
        f"<body><h1>Title</h1>{ps(4)}<ul class=discussion>{dated}</ul></body>",
    ):
        text = main_text(page)
        assert "remark" not in text and text.count("committee") == 4, page[:200]
