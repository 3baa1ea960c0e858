from siltbed.llm import html

BODY = "<article><h1>Title {i}</h1><p>First &amp; {i}\n  line<br>more.</p><p>Second <b>bold</b>&nbsp;x {i}<p>Third &#233; {i}</article>"


def page(i, body=BODY, extra=""):
    return f"""<!DOCTYPE html><html><head><title>t{i}</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body><!-- <p>no</p> -->
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies {i}</div>{body.format(i=i)}
<aside>Side {i}</aside><div class="ads">Buy {i}</div><form><p>Search</p><button>go</button></form><section id="comments"><p>reader {i}</p></section>{extra}<footer>&copy; {i}</footer></body></html>"""


def want(i):
    return f"Title {i}\nFirst & {i} line more.\nSecond bold x {i}\nThird é {i}"


def test_one_page():
    assert html.content(html.Page(page(1)), set(), ()) == want(1)
    assert html.content(html.Page(page(1).split("</article>")[0]), set(), ()) == want(1)
    plain = "<p>a<p>b <i>c</i><ul><li>d<li>e</ul><table><tr><td>f<td>g</table>tail"
    assert html.content(html.Page(plain), set(), ()).split("\n") == ["a", "b c", "d", "e", "f", "g", "tail"]
    for odd in ("", "<", "<p", "text", "</p>", "<a b='", "<!--", "<script>x", "&lt;p&gt;", "<p>" * 3000):
        html.content(html.Page(odd), set(), ())


def test_matching():
    a, b = "html(head,body(nav(ul(li)),div.ad,article(h1,p),footer))", "html(body(div,article(h1,p,q),footer))"
    labels, children = html.read_tree(a)
    assert labels == ["html", "head", "body", "nav", "ul", "li", "div.ad", "article", "h1", "p", "footer"] and children[2] == [3, 6, 7, 10]
    assert html.read_tree("(html(,x),y)") == (["", "html", "", "x", "y"], [[1, 4], [2, 3], [], [], []])
    assert html.align(a, a) == tuple(range(11))
    assert html.align(b, a) == (0, 2, -1, 7, 8, 9, -1, 10)


def test_induction_drops_recurring_slots(spark, scratch):
    body = "<div><div><p>Nothing names this banner</p></div><div><p>Story {i} begins.</p><p>It has a second paragraph {i}.</p></div></div>"
    rows = [(i, f"http://host.net/{i}", page(i, body)) for i in range(30)] + [(100, "http://other.net/", page(100)), (101, None, None), (102, "x", ""), (102, "x", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as text", "3 as slots")
    for known in (1 << 18, 0):
        found = html.extract(df, scratch, known=known).collect()
        assert len(found) == len(rows)
        by = {r["page_id"]: r["text"] for r in found}
        assert all(by[i] == f"Story {i} begins.\nIt has a second paragraph {i}." for i in range(30))
        assert by[100] == want(100) and by[101] == "" and by[102] == ""
        assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert html.extract(df.limit(0), scratch).count() == 0


def texts(spark, scratch, bodies):
    rows = [(i, "http://host.net/x", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    return {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch).collect()}


def story(i, n=3):
    return [f"Story {i} part {k} says things that no other page of this host says." for k in range(n)]


def test_mirrored_articles_stay(spark, scratch):
    own = [story(min(i, 2)) for i in range(4)]
    found = texts(spark, scratch, [f"<div class='x'><p>Advert {i}</p></div><div class='y'>" + "".join(f"<p>{p}</p>" for p in own[i]) + "</div>" for i in range(4)])
    for i in range(4):
        assert "\n".join(own[i]) in found[i]


def test_blocks_of_all_layouts_are_template(spark, scratch):
    """A constant paragraph beside the article's, and a constant block of the host's second layout."""
    bodies = ["<div class='y'><p>Read on in our shop</p>" + "".join(f"<p>{p}</p>" for p in story(i)) + "</div>" for i in range(12)]
    bodies += ["<table><tr><td><div class='z'><p>A note on every page here</p></div></td></tr></table><div class='w'>" + "".join(f"<p>{p}</p>" for p in story(i)) + "</div>" for i in range(12, 20)]
    found = texts(spark, scratch, bodies)
    assert all(found[i] == "\n".join(story(i)) for i in range(20))


def brute(a, b, i=0, j=0):
    """Nodes of the largest matching, by plain recursion."""
    (la, xs), (lb, ys) = a, b
    if la[i] != lb[j]:
        return 0
    best = [[0] * (len(ys[j]) + 1) for _ in range(len(xs[i]) + 1)]
    for p, x in enumerate(xs[i], 1):
        for q, y in enumerate(ys[j], 1):
            best[p][q] = max(best[p - 1][q], best[p][q - 1], best[p - 1][q - 1] + brute(a, b, x, y))
    return 1 + best[-1][-1]


def test_matching_against_plain_recursion():
    import random

    rng = random.Random(1)

    def tree(depth):
        own = [tree(depth - 1) for _ in range(rng.randrange(4))] if depth else []
        return rng.choice("abc") + ("(" + ",".join(own) + ")" if own else "")

    for _ in range(300):
        a, b = "r(" + tree(3) + ")", "r(" + tree(3) + "," + tree(2) + ")"
        found = html.align(a, b)
        x, y = html.read_tree(a), html.read_tree(b)
        assert sum(k >= 0 for k in found) == brute(x, y)
        assert all(x[0][i] == y[0][k] for i, k in enumerate(found) if k >= 0)


def test_broken_and_very_long_markup():
    import time

    began = time.time()
    n = 100_000
    words = " ".join(f"w{i}" for i in range(n))
    assert html.content(html.Page(f"<article><p>{words}</p></article>"), set(), ()) == words
    for odd in ("<div>" * n + "x", "<p><blockquote>" * n + "x", "<div c " * n, "<a b='" * n, "</div>" * n, "<div>" * n + "</p>" * n, "<title>" * n, "<ul><li>" * n, "<!--" * n, "<" * n, "<table><tr><td>" * n, "<div c=\"" * n, "&lt;" * n, "<x>" * n + "</y>" * n, "<li>" * n):
        page = html.Page(odd)
        html.content(page, set(), ())
        own = page.tree()
        assert html.align(own, own) and len(html.slots_of(own, own[: len(own) // 2].rstrip("(,"))) >= 1
    wide = "(" + ",".join(f"div(p{i % 7},q(r))" for i in range(3000)) + ")"
    other = "(" + ",".join(f"div(q(r),p{i % 5})" for i in range(3000)) + ")"
    assert sum(k >= 0 for k in html.align(wide, other)) > 3000
    assert time.time() - began < 60


def test_what_ends_elements():
    for tail in ("<select><option>a", "<svg><path/>", "<object data=x>", "<iframe src=x>", "<title>"):
        page = f"<html><head><title>t</title><body><div><p>One.</p><div>{tail}</div></div><article><p>Two.</p></article>"
        assert html.content(html.Page(page), set(), ()) == "Two.", tail
    assert html.content(html.Page("<article><script src=/a/>var leak=1;</script><p>Text.</p></article>"), set(), ()) == "Text."
    assert html.content(html.Page("<head><meta charset=utf-8><article><p>No end of head.</p></article>"), set(), ()) == "No end of head."


def test_article_names_and_links():
    inner = "<p>Cited: <a href=1>the first long source</a> and <a href=2>the second long source</a></p><div class='notice-of-award'>Award.</div><p class='post-share-story'>Shared story.</p>"
    ads = "<div class='ad-slot-1'>Buy.</div><div class='share-buttons'>Share.</div><section class='comments'><p>Reader.</p></section>"
    page = f"<main><p>Lead.</p><article><h1>Head</h1>{inner}{ads}</article><p>Tail.</p></main><p>Outside.</p>"
    assert html.content(html.Page(page), set(), ()) == "Lead.\nHead\nCited: the first long source and the second long source\nAward.\nShared story.\nTail."


def test_induction_alone(spark, scratch):
    """Pages without article, main or a telling name: what varies is the text, what recurs in its slot is template."""
    def body(i):
        menu = "".join(f"<td><a href=/{k}>Part {k} of our site</a></td>" for k in range(5))
        return f"<table><tr>{menu}</tr></table><div><b>The Daily Example</b></div><div><div>" + "".join(f"<p>{p}</p>" for p in story(i, 4)) + "</div><div><p>Written by our staff</p></div></div><div><span>All rights are ours</span></div>"

    found = texts(spark, scratch, [body(i) for i in range(20)])
    assert all(found[i] == "\n".join(story(i, 4)) for i in range(20))
