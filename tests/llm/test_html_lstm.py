import random
import time

import numpy as np

from tallyloom.llm import html_lstm as H

SCHEMA = "page_id long, url string, html string"


def page(rnd, marked=True):
    say = lambda n: " ".join(rnd.choice(["la", "re", "mi", "do", "so", "&amp;", "ti"]) for _ in range(n)) + "."
    paras = [say(rnd.randint(8, 40)) for _ in range(rnd.randint(1, 6))]
    junk = {
        "nav": "<nav><ul>" + "".join(f"<li><a href='/x'>{say(1)}</a></li>" for _ in range(5)) + "</ul></nav>",
        "ad": f"<div class='ad'>{say(4)}</div>",
        "cookie": f"<div id=cookie-notice>{say(6)}<button>ok</button></div>",
        "side": f"<aside><p>{say(9)}</p></aside>",
        "foot": f"<footer>&copy; {say(5)}</footer>",
        "form": f"<form><p>{say(3)}</p><input value='x'></form>",
        "comments": f"<section class='comments'><p>{say(12)}</p></section>",
    }
    body = "\n".join(f"<p><b>{p[:5]}</b>{p[5:]}" + rnd.choice(["</p>", ""]) for p in paras)
    main = f"<article><h1>{say(4)}</h1>{body}</article>" if marked else f"<div><h1>{say(4)}</h1>{body}</div>"
    title = H.leaf_blocks(main)[0].text
    html = f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{junk['nav']}<!-- x -->{junk['ad']}{junk['cookie']}{main}{junk['side']}{junk['form']}{junk['comments']}{junk['foot']}</body></html>"
    return html, "\n".join([title, *[" ".join(p.replace("&amp;", "&").split()) for p in paras]])


def test_extracts_held_out_pages(spark):
    rnd = random.Random(1)
    made = [page(rnd) for _ in range(240)]
    df = spark.createDataFrame([(i, f"u{i}", h) for i, (h, _) in enumerate(made)], SCHEMA)
    out = H.extract(df, sample=120).collect()
    good = [r.text == made[r.page_id][1] for r in out]
    assert len(out) == 240 and np.mean(good) > 0.98
    assert all(r.n_chars == len(r.text) for r in out)


def shown(page):
    return [(" ".join(b.path), b.text) for b in H.leaf_blocks(page)]


def test_leaf_blocks_of_broken_markup():
    assert shown("a <b>b</b>&lt;c&gt;<p>d<p>e<br>f</div>g") == [("", "a b<c>"), ("p", "d"), ("p", "e f"), ("p", "g")]
    assert [t for _, t in shown("x<script>if (a<b) '</p>'</script>y<style>p{}</style><p>q &nbsp; r\n s</p>")] == ["xy", "q r s"]
    assert H.leaf_blocks(None) == H.leaf_blocks("") == H.leaf_blocks("<p> \n</p><!-- c -->") == []
    assert [t for _, t in shown("<div>one<div>two</div>three</div>")] == ["one", "two", "three"]
    assert [t for _, t in shown("1 < 2 and <p>ok")] == ["1 < 2 and", "ok"]
    assert [t for _, t in shown("a<p title='x>y'>b<p title='c>d")] == ["a", "b", "d"]
    assert [t for _, t in shown("a<p title='x'>b<p title=c")] == ["a", "b"]
    assert [t for _, t in shown("a<script>b<p>c")] == ["a"] and [t for _, t in shown("a<svg>b<p>c")] == ["ab", "c"]


def test_tags_are_read_by_attribute_states():
    texts = lambda page: [t for _, t in shown(page)]
    assert texts("<article><p title=don't>Hello world one.</p><p>It's fine two.</p><p>Third para.</p></article>") == ["Hello world one.", "It's fine two.", "Third para."]
    assert texts("<p it's>one</p><p 'a' \"b>two</p><p a=b'c\"d>three</p><p a = 'x>y' b>four") == ["one", "two", "three", "four"]
    assert texts("<p a=>one<p =\"x>two<p a=\"b\"c='d>'>three<p a==\"b>four<p a/='b>five") == ["one", "two", "three", "four", "five"]
    assert texts("a<p a='never>b<p>c it's") == ["a", "b", "c it's"]  # the quote closes, but then the tag never ends
    assert texts("x<!-->y<!--->z<!--a--!>w<!-- > -->v") == ["xyzwv"]
    assert texts("<p>a<script>x</script foo='>b<script>y</SCRIPT/>c") == ["abc"]
    assert shown("<div title='class=ad' CLASS=\"a&amp;b\" class=no><p data-id=3 id=x/>t<p/>u") == [("div a&b p x/", "t"), ("div a&b", "u")]


def test_outer_tags_reach_the_network():
    deep = lambda head: H.leaf_blocks(head + "<div>" * 9 + "<p>one</p>" + "</div>" * 9 + "<p>two</p>")
    nav, art, ad = (deep(h) for h in ("<nav>", "<article>", "<div class='promo x'>"))
    assert [b.path for b in nav] == [b.path for b in art][:1] + [("nav!", "p")]
    assert nav[0].outer != art[0].outer and len(ad[0].outer) == 4 and not nav[1].outer
    assert [b.outer for b in H.hidden(nav)] == [tuple(w for w in nav[0].outer if w[1] != "!"), ()] and len(nav[0].outer) == 2
    words = lambda blocks: {tuple(H.block_features([b])[0]) for b in blocks}
    assert not words(nav[:1]) & words(art[:1])
    short = H.shortened(H.leaf_blocks("<nav><ul class=x><li><p>a"))
    assert short[0].path == ("li", "p") and set(short[0].outer) == {*H.outer_words("nav!"), *H.outer_words("ul x")}
    began = time.process_time()
    H.leaf_blocks("".join(f"<div class='c{i} d{i % 7}'>a" for i in range(30_000)))
    assert time.process_time() - began < 4


def test_deep_outer_tags_decide(spark):
    """Pages whose telling tags lie ten tags up: only outer words tell menus from text."""
    rnd = random.Random(11)
    wrap = lambda h: h.replace("<article>", "<article>" + "<div>" * 10).replace("</article>", "</div>" * 10 + "</article>").replace("<nav>", "<nav>" + "<div>" * 10).replace("</nav>", "</div>" * 10 + "</nav>")
    made = [page(rnd) for _ in range(160)]
    rows = [(i, "u", h if i % 2 else wrap(h)) for i, (h, _) in enumerate(made)]
    out = H.extract(spark.createDataFrame(rows, SCHEMA), sample=80).collect()
    assert np.mean([r.text == made[r.page_id][1] for r in out]) > 0.97


def test_a_class_inside_an_article_does_not_decide_alone(spark):
    said = lambda page: [b.said for b in H.leaf_blocks(page)]
    assert said("<article>a<section class=related-work>b<p>c<aside>d</aside></section><div id=search-results-table>e</div><div class='comments'>f") == [1, None, None, 0, None, 0]
    rnd = random.Random(12)
    made, more = [], ["So re mi, la do fa so far in the prose of this part.", "La la do, re mi so it goes on."]
    for i in range(200):
        html, text = page(rnd)
        if i >= 150:
            html = html.replace("</article>", f"<section class='related-work'><p>{more[0]}</p></section><div id='search-results-table'><p>{more[1]}</p></div></article>")
            text = "\n".join([text, *more])
        made.append((html, text))
    net = H.BiLstm.__new__(H.BiLstm)
    net.p = H.train([(h,) for h, _ in made[:150]])
    got = H.main_texts(net, [h for h, _ in made[150:]])
    assert np.mean([m in g for g in got for m in more]) > 0.9  # the teacher's list alone would drop all of them
    assert np.mean([set(g.split("\n")) <= set(t.split("\n")) for g, (_, t) in zip(got, made[150:], strict=True)]) > 0.95


def test_what_tags_say():
    said = lambda page: [b.said for b in H.leaf_blocks(page)]
    assert said("<body class='search'>a<article><header>t</header><p>b<aside>c</aside></article><header>d</header><div class='comment-list'><article>e") == [None, 1, 1, 0, 0, 0]
    assert said("<div class='has-sidebar'>a<div role=main>b</div><div class='x ad'>c") == [None, 1, 0]


def test_time_is_linear_in_the_page():
    for part, n in (("<p class='x ", 170_000), ("<div><p>a</p>", 100_000), ("<svg>a", 100_000), ("<p a", 500_000), ("<p a='<p>\">'", 100_000)):
        began = time.process_time()
        H.leaf_blocks(part * n)
        assert time.process_time() - began < 4, part


def test_labels_without_telling_names(spark):
    """Where the tags that the teacher reads are hidden it says nothing, and the network still finds the text."""
    rnd = random.Random(7)
    made = [page(rnd)[0] for _ in range(200)]
    net = H.BiLstm.__new__(H.BiLstm)
    net.p = H.train([(h,) for h in made[:150]])
    blocks = [H.leaf_blocks(h) for h in made[150:]]
    said = [b.said == 1 for own in blocks for b in own]
    bare = [[b._replace(path=tuple("div" if x[-1] == "!" else x for x in b.path)) for b in own] for own in blocks]
    assert not any(x[-1] == "!" for own in bare for b in own for x in b.path)
    assert np.mean(np.concatenate(H.judged(net, bare)) == said) > 0.97
    still = net.p | {k: np.zeros_like(net.p[k]) for k in ("wf", "wb", "uf", "ub")}
    net.p = still
    assert np.mean(np.concatenate(H.judged(net, bare)) == said) < 0.97  # without its recurrent part


def test_long_pages_are_read_in_parts():
    rnd, net = random.Random(8), H.BiLstm(5)
    blocks = [H.leaf_blocks("".join(page(rnd)[0] for _ in range(n))) for n in (70, 1, 3)]
    got = H.judged(net, blocks)
    for own, y in zip(blocks, got, strict=True):
        x = net.inputs(*H.block_features(own))[:, None]
        assert ((net.logits(x, np.ones((len(own), 1), np.float32))[:, 0] > 0) == y).all()


def test_gradients_are_those_of_the_loss():
    net, rnd = H.BiLstm(3), np.random.default_rng(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    blocks = [H.Block(("div ad",), "a b c", 0.5, None), H.Block(("p",), "d e.", 0.0, None), H.Block(("p",), "f", 0.0, None)]
    pages = [(*H.block_features(blocks), np.array([0, 1, -1.0])), (*H.block_features(blocks[1:]), np.array([1, 1.0]))]
    start = {k: v.copy() for k, v in net.p.items()}

    def loss():
        net.sums = {k: np.full(v.shape, 1e30) for k, v in net.p.items()}
        return net.fit(pages, 0.0)

    for k in ("o", "wf", "ub", "e"):
        net.p, net.sums = {n: v.copy() for n, v in start.items()}, {n: np.zeros(v.shape) for n, v in start.items()}
        with np.errstate(all="ignore"):
            net.fit(pages, 0.0)
        size = np.sqrt(net.sums[k].ravel())
        net.p = {n: v.copy() for n, v in start.items()}
        at = int(np.argmax(size))
        net.p[k].ravel()[at] += 1e-2
        up = loss()
        net.p[k].ravel()[at] -= 2e-2
        down = loss()
        assert abs(abs(up - down) / 2e-2 - size[at]) < 0.05 * size[at] + 1e-3, k


def test_empty_and_null_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<nav><a>x</a></nav>")]
    assert {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect()}[1] == ""
    assert H.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeats_clashing_names_and_pages_that_tell_nothing(spark):
    rnd = random.Random(9)
    htmls = [page(rnd)[0] for _ in range(30)] * 2
    df = spark.createDataFrame([(i, "old", h, 2.0) for i, h in enumerate(htmls)], "`page.id` int, text string, html string, c0 double")
    out = H.extract(df)
    got = {r["page.id"]: r.text for r in out.collect()}
    assert out.columns == ["page.id", "c0", "text", "n_chars"] and all(got[i] == got[i + 30] != "old" for i in range(30))
    named = H.extract(df.select("c0", df.html.alias("text")), "text")
    assert named.columns == ["c0", "text", "n_chars"] and sorted(r.text for r in named.collect()) == sorted(got.values())
    plain = spark.createDataFrame([("<p>a<p>b",)], "html string")
    assert H.extract(plain).first().text == "a\nb"
