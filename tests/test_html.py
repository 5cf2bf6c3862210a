"""Main text as columns against a plain parser that keeps every piece of text with the elements around it."""

import random
import re
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import functions as F

from skarn.functions.html import BREAKS, ROOTS, VOID, main_text, unescaped
from skarn.operators import clean
from skarn.settings import DEFAULT

PAGES = "/root/testdata/sf0.01/pages.parquet"


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.said, self.made = [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in BREAKS:
            self.handle_data("\n")
        if tag not in VOID:
            noisy = tag in DEFAULT.noise_tags or any(re.search(DEFAULT.noise_attributes, v or "", re.I) for k, v in attrs if k in ("class", "id"))
            self.made.append((tag, noisy))
            self.open.append(len(self.made) - 1)

    def handle_endtag(self, tag):
        names = [self.made[k][0] for k in self.open]
        if tag in names:
            del self.open[len(names) - 1 - names[::-1].index(tag) :]
        if tag in BREAKS:
            self.handle_data("\n")

    def handle_data(self, data):
        self.said.append((tuple(self.open), data))

    def text(self):
        root = next((k for r in ROOTS for k, (tag, _) in enumerate(self.made) if tag == r), None)
        kept = []
        for around, data in self.said:
            if root is None or root in around:
                inner = around[around.index(root) + 1 :] if root is not None else around
                if not any(self.made[k][1] for k in inner):
                    kept.append(data)
        lines = (" ".join(x.split()) for x in "".join(kept).split("\n"))
        return "\n".join(x for x in lines if x)


def plain(html):
    p = Plain()
    p.feed(html)
    p.close()
    return p.text()


def both(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string").repartition(4)
    got = {r["id"]: r["t"] for r in df.select("id", main_text(F.col("html")).alias("t")).collect()}
    return [got[i] for i in range(len(pages))], [plain(h) for h in pages]


def test_pages(spark):
    pages = [r.html for r in spark.read.parquet(PAGES).select("html").collect()]
    got, want = both(spark, pages)
    assert got == want


def test_pages_of_random_tags(spark):
    r = random.Random(5)
    names = ["main", "article", "body", "div", "p", "b", "nav", "form", "ul", "li", "section", "Footer"]
    bits = ["one", " two\n", "x &amp; y", "&lt;p>", "&#8212;", "<br>", "<img src='a>b'>", "<!-- <p>no</p> -->", "<script>if (a<b) '</p>'</script>", " ", "<div/>", "a < b"]
    marks = ["", " class='Cookie-box'", ' id="top" class="sidebar"', " data-x=\"class='banner'\"", " id=navbar", " title='a=b'"]

    def page():
        out = []
        for _ in range(r.randint(0, 40)):
            n = r.choice(names)
            out.append(r.choice([f"<{n}{r.choice(marks) if r.random() < 0.3 else ''}>", f"</{n}>", r.choice(bits), r.choice(bits)]))
        return "".join(out)

    got, want = both(spark, [page() for _ in range(1500)])
    bad = [i for i, (g, w) in enumerate(zip(got, want, strict=True)) if g != w]
    assert not bad, (got[bad[0]], want[bad[0]])


def test_references(spark):
    texts = ["&amp;lt; &ampx &notit; &copy2 &zz; & &; &#65;&#x41;&#0;&#128;&#x110000;&#99999999999999;&#xD800;&#13;|&#1;|&#xFFFE;|&#65 &#x;", "&NotEqualTilde;&hearts", "", "no references"]
    texts += [f"&{n}" for n in ("quot", "AMP;", "Aacute", "lang;", "ngE;", "thinsp;")] + [f"&#{n};" for n in (127, 150, 159, 233, 8212, 0x1F600)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    assert [r[0] for r in df.orderBy("id").select(unescaped(F.col("t"))).collect()] == [unescape(t) for t in texts]


def test_roots_that_are_noisy_or_lie_in_noise(spark):
    got, _ = both(spark, ["<nav>a<main class=cookie>m<nav>q</nav>z</main>b</nav>", "<main/>x<article>y</article>", "<article>a<div><p>b</article>c<article>d</article>"])
    assert got == ["mz", "", "a\nb"]


def test_long_pages(spark):
    many = "<body>" + "<p class='x'>word &amp; word</p>" * 20_000 + "</body>"
    noisy = "<body>" + "<nav>menu</nav>text<br>" * 3_000 + "</body>"
    attribute = "<body><p title='" + "x" * 300_000 + "'>a</p><p " + "k='v' " * 50_000 + ">b</p><!--" + "-" * 100_000 + " --></body>"
    got, _ = both(spark, [many, noisy, attribute])
    assert got == ["\n".join(["word & word"] * 20_000), "\n".join(["text"] * 3_000), "a\nb"]


def test_columns_may_be_called_anything(spark):
    df = spark.createDataFrame([("<p>x", 1, None)], "html string, pieces int, text string")
    assert clean.with_main_text(df).collect() == [("<p>x", 1, "x")]
    assert clean.with_main_text(df.where("pieces > 1")).collect() == []
