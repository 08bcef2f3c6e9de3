import random
import time
from html.parser import HTMLParser

import pytest

from netweir.llm.html_text import ASIDE, BLOCK, extract, main_text

LONG = "some words of the story " * 8


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<script>var x='<p>no</p>'</script>", ""), ("plain &lt;text&gt;  here", "plain <text> here"),
    ("<article><h1>T &amp; U</h1><p>One<br>two<p>three</article><footer>f</footer>", "T & U\n\nOne two\n\nthree"),
    ("<body><nav>m</nav><main><p>a</p><aside>s</aside><p>b</p><form>f<p>g</p></form></main></body>", "a\n\nb"),
    ("<article><p>a<div class=ad>buy</div><p>b<section id='comments'><p>c</section></article>", "a\n\nb"),
    (f"<div id=menu><a>x</a></div><div class=content><h1>H</h1><p>{LONG}</p><p>end</p></div><div class='site-footer'>c</div>",
     f"H\n\n{LONG.strip()}\n\nend"),
    (f"<p>{LONG}</p><!-- <p>gone</p> --><style>p{{}}</style><p>x</p", f"{LONG.strip()}\n\nx</p"),
    ("<p>only", "only"), ("<p>&#x41;&eacute;&nbsp;b", "Aé b"), ("<ul><li>a<li>b</ul>", "a\n\nb"),
])
def test_pages(page, text):
    assert main_text(page) == text


def test_rows(spark):
    rows = [(1, "u", "<p>a"), (None, None, None), (1, "u", "<p>a"), (2, "v", "<p>" + "w " * 200_000)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = extract(frame, ["page_id", "url"])
    assert sorted(str((r.page_id, r.url, len(r.text))) for r in got.collect()) == sorted(
        ["(1, 'u', 1)", "(None, None, 0)", "(1, 'u', 1)", "(2, 'v', 399999)"])
    assert extract(frame.limit(0), ["page_id"]).count() == 0


def para(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


@pytest.mark.parametrize("page, text", [
    (f"<div id=content>{para(LONG, LONG)}</div><article class=teaser><p>Read on</p></article>", [LONG, LONG]),
    (f"<div id=content>{para(LONG)}</div><article class=comment>{para(LONG)}</article>", [LONG]),
    (f"<div id=content>{para(LONG, LONG)}</div><article><p>small</p></article>", [LONG, LONG, "small"]),
    (f"<div>{para(LONG)}<div class=ad>x</div>{para('The end.')}</div>", [LONG, "The end."]),
    (f"<div>{para(LONG, '<a href=x>a link only</a>', LONG, 'Bye.')}</div>", [LONG, "a link only", LONG, "Bye."]),
    (f"<div>{para(LONG)}<ul>{'<li><a>x</a>' * 3}</ul>{para('x')}</div>", [LONG]),
    (f"<p>T</p>{para(LONG)}" + "<p><a>l</a></p>" * 4 + para(LONG), ["T", LONG, LONG]),
    (f"<main><h2>H</h2>{para('a')}<nav>n</nav>{para('b')}</main><p>o</p>", ["H", "a", "b"]),
    (f"<p title='>'>{LONG}</p><p x='>y", [LONG, "y"]), (f"a < b <p>{LONG}</p> <3", ["a < b", LONG, "<3"]),
])
def test_plateaus(page, text):
    assert main_text(page) == "\n\n".join(t.strip() for t in text)


@pytest.mark.parametrize("piece, tail", [("<b>x", "</i>"), ("<a x='", ""), ("<a x=\"", ""), ("<b><p></p>", ""), ("<p><div><b>", "<p></p>"), ("<", ""),
                                         ("<!--", ""), ("<![CDATA[", ""), ("<li><ul>", "</p>"), ("<script", ""), ("&amp", "")])
def test_time_is_linear_in_hostile_pages(piece, tail):
    page = piece * (1_000_000 // len(piece)) + tail * (200_000 // max(len(tail), 1) if tail else 0)
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 20


class Slow(HTMLParser):
    """Lines of a well-formed page, from the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.text, self.links, self.open = [], "", 0, []

    def flush(self):
        line = " ".join(self.text.split())
        if line and not any(t in ASIDE for t in self.open):
            self.lines.append((line, self.links))
        self.text, self.links = "", 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
        self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        self.open.pop()

    def handle_data(self, data):
        self.text += data
        self.links += 0 if "a" in self.open else len("".join(data.split()))


def slow_text(page):
    parser = Slow()
    parser.feed(page)
    parser.close()
    parser.flush()
    lines, found, i = parser.lines, [], 0
    size = [n for _, n in lines]
    while i < len(lines):
        if size[i]:
            end = i
            while end < len(lines) and any(size[end:end + 3]):
                end += 1
            found.append((i, end, max(sum(size[j:j + 3]) for j in range(i, end))))
            i = end
        else:
            i += 1
    kept = [f for f in found if f[2] > 86] or sorted(found, key=lambda f: (-f[2], f[0]))[:1]
    out = []
    for a, b, _ in kept:
        while not size[b - 1]:
            b -= 1
        out += [text for text, _ in lines[a:b]]
    return "\n\n".join(out)


def test_random_pages_equal_a_slow_search():
    r = random.Random(4)

    def node(depth):
        if depth == 0 or r.random() < 0.3:
            return r.choice(["word ", "x &amp; y ", " \n", "t" * r.randint(1, 120) + " ", "&eacute;<b>bold</b> "])
        tag = r.choice(["div", "p", "ul", "a", "nav", "section", "b", "h2", "footer", "div"])
        inner = "".join(node(0 if tag in ("p", "h2", "a") else depth - 1) for _ in range(r.randint(0, 4)))
        return f"<{tag}>{inner}</{tag}>"

    for _ in range(1500):
        page = "".join(node(4) for _ in range(r.randint(1, 8)))
        assert main_text(page) == slow_text(page), page
