"""Article text that stands beside furniture, or under names that look like it."""

import pytest

from mnemora.llm import html_mss

LEFT, BOX, RIGHT = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("left", 30), ("box", 60), ("right", 200)))


@pytest.mark.parametrize("box", ["<aside><p>{}</p></aside>", "<div class='newsletter-signup'><p>{}</p></div>", "<div class='related-posts'><ul><li><a href='/'>{}</a></li></ul></div>"])
@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main><div>{}</div></main>", "<div class='post'>{}</div>"])
@pytest.mark.parametrize("weights", [{}, {"w@p": 0.05, "w@p!": -3.0, "<aside!": -10.0, "<div.newsletter-signup!": -10.0}])
def test_text_on_both_sides_of_a_long_box_stays(frame, box, weights):
    page = f"<body><nav>home</nav>{frame.format(f'<p>{LEFT}</p>{box.format(BOX)}<p>{RIGHT}</p>')}<footer>c</footer></body>"
    assert html_mss.extract(page, weights) == f"{LEFT} {RIGHT}"


def test_names_in_an_article_that_tell_its_subject():
    part = "<section id='search'><h2 id='related-work' class='notice'>Head of this very section</h2><p class='social-contract'>One two three.</p><p>See <a id='share' href='#'>this link</a> too.</p></section>"
    page = f"<article>{part}<div class='social-share'>Tell all</div><p>Last words here.</p></article>"
    assert html_mss.extract(page, {}) == "Head of this very section One two three. See this link too. Last words here."


def test_inline_furniture_goes_and_parts_of_the_article_stay():
    words = " ".join(f"word{i}" for i in range(30))
    page = f"<article><p>{words} <button>Share this now please</button> on.</p><p class='byline'>By me</p><p>{words} <span class='ad'>Buy now</span> and <math><mi>x</mi></math> here <label class='newsletter'>join us</label> end.</p><div class='tags'>tag one two</div><p>{words}</p></article>"
    assert html_mss.extract(page, {}) == f"{words} on. By me {words} and x here end. tag one two {words}"


@pytest.mark.parametrize("page", ["<div>" * 60000 + "</x>" * 60000 + "<p>end of it</p>", "<li>a</b>" * 100000, "<span class=ad>" * 60000 + "x" + "</span>" * 60000, "<p>" * 120000 + "</p>" * 120000, "<a>" * 100000 + "</i>" * 100000])
def test_nested_and_unmatched_tags_cost_in_proportion(page):
    import time

    began = time.process_time()
    html_mss.extract(f"<body>{page}</body>", {})
    assert time.process_time() - began < 15  # seconds, for a page of a megabyte; with a walk of the stack for each tag, half an hour


def plain_pages(seed, n=60):
    """Pages of several makes, with the text that their article has."""
    import random

    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "it&#233;s", "a &amp; b", "x &lt; y"]) for _ in range(k))
    links = "".join(f"<li><a href='/{i}'>link {i}</a></li>" for i in range(12))
    out = []
    for i in range(n):
        parts = [text(rng.randint(15, 60)) for _ in range(rng.randint(2, 6))]
        tags = [rng.choice(["p", "p", "blockquote", "h2"]) for _ in parts]
        body = f"<h1>{text(5)}</h1>"
        want = [body[4:-5]]
        for j, (t, tag) in enumerate(zip(parts, tags)):
            body += f"\n<{tag}>{t}</{tag}>"
            want.append(t)
            if j == 1:
                body += rng.choice(["<aside><p>Read also this and that</p></aside>", "<div class='newsletter-signup'>Get our letter <form><input><button>Go now</button></form></div>", "<script>var x = '<p>no</p>';</script>", "<!-- <p>no</p> -->"])
        frame = rng.choice(["<article>{}</article>", "<main><div class='wrap'>{}</div></main>", "<article class='post'><div class='body'>{}</div></article>"])
        page = f"<html><head><title>T {i}</title><style>p {{}}</style></head><body><header><nav><ul>{links}</ul></nav></header>{frame.format(body)}<div id='comments'><p>I liked this one, thanks a lot to all</p></div><footer><p>All rights reserved by us</p></footer></body></html>"
        import html as h

        out.append((i, f"http://x/{i}", page, " ".join(" ".join(h.unescape(w).split()) for w in want)))
    return out


def test_op8_finds_the_article_of_each_page(spark, tmp_path):
    from mnemora.llm import queries

    pages = plain_pages(3)
    odd = [(1000, "u", None), (1001, None, ""), (1002, "u", "<p"), (None, "u", "<script>x"), (1003, "u", pages[0][2]), (1003, "u", pages[0][2])]
    spark.createDataFrame([r[:3] for r in pages] + odd, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    rows = queries.op8_html_mss(spark, str(tmp_path)).collect()
    got = {r["page_id"]: r["text"] for r in rows}
    assert len(rows) == len(pages) + len(odd) and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert [got[i] for i, *_ in pages] == [want for *_, want in pages]
    assert got[1000] == got[1001] == got[1002] == got[None] == "" and got[1003] == pages[0][3]


def test_long_messages_are_cut_in_one_pass(spark):
    import time

    from mnemora.llm import chat_format

    text = "ab é<#😀\n" * 250_000
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text[:5000])], "conv_id long, turn long, role string, text string")
    began = time.time()
    r = chat_format.parse(chat_format.format_conversations(df)).first()
    assert [t["text"] for t in r["turns"]] == [text, text[:5000]] and r["loss_text"] == text[:5000] and time.time() - began < 60
