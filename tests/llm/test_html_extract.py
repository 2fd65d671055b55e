import itertools
import math
import random
import re
from html import unescape

from tarn.llm import html_extract
from tarn.llm.dom import read


def test_marginals_against_enumeration():
    rnd = random.Random(5)
    page = read("<div class=ad>a<p>b</p></div><article><p>c<p>d</article>")
    feats = {f for fs in page.features for f in fs}
    model = html_extract.TreeModel({f: rnd.uniform(-1, 1) for f in feats}, {(k, a, b): rnd.uniform(-2, 2) for k in ("text", "block") for a in (0, 1) for b in (0, 1)})
    n = len(page.tag)
    total, single = 0.0, [0.0] * n
    for x in itertools.product((0, 1), repeat=n):
        w = sum(model.weights[f] for i in range(n) if x[i] for f in page.features[i])
        w += sum(model.edges[(model._kind(page, i), x[page.parent[i]], x[i])] for i in range(1, n))
        total += math.exp(w)
        for i in range(n):
            single[i] += x[i] * math.exp(w)
    chance, _ = model.marginals(page)
    assert all(abs(c - s / total) < 1e-9 for c, s in zip(chance, single, strict=True))


def test_held_out_layouts():
    model = html_extract.default_model()
    right = wrong = 0
    for x in html_extract.labelled_pages(120, seed=99):
        page = read(x)
        chance, _ = model.marginals(page)
        for t, p, truth in zip(page.text, chance, page.truth, strict=True):
            if t is not None:
                right += (p > 0.5) == truth
                wrong += (p > 0.5) != truth
    assert right / (right + wrong) > 0.97


def test_synthetic_pages_exactly(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    got = html_extract.extract_text(pages).collect()
    assert len(got) == len(html)
    for r in got:
        inner = re.search(r"<article>(.*)</article>", html[r["page_id"]], re.S)[1]
        want = " ".join(b for x in re.split(r"</?(?:p|h1)\b[^>]*>", inner) if (b := " ".join(unescape(re.sub(r"<br>", " ", x).replace("<b>", "").replace("</b>", "")).split())))
        assert r["text"] == want and r["n_chars"] == len(want)


def test_odd_pages(spark):
    rows = [
        (1, None), (2, ""), (3, "<p>Only &lt;this&gt;\n text&nbsp;stays.</p>"), (4, "<article><p>Kept. " + "word " * 50_000 + "</article><footer>&copy; gone</footer>"),
        (5, "<div><div>" * 5000 + "deep text that goes on for a while."), (6, "<p class='x>broken <b attr=\"> quote</p> < 5 > 3"), (7, "<script>if (a < b) '</p>'</script><!-- open"), (None, "<article><p>No id here.</p></article>"), (3, "<article><p>Twice the id.</p></article>"),
    ]
    df = spark.createDataFrame([(i, "u", h, "t") for i, h in rows], "page_id long, url string, html string, text string")
    got = {(r["page_id"], r["text"][:30]): r for r in html_extract.extract_text(df).collect()}
    texts = {k[0]: r["text"] for k, r in got.items()}
    assert texts[1] == texts[2] == texts[7] == ""
    assert (3, "Only <this> text stays.") in got and (3, "Twice the id.") in got and texts[None] == "No id here."
    assert texts[4].startswith("Kept. word") and len(texts[4]) > 200_000 and "gone" not in texts[4]
    assert len(got) == len(rows) and html_extract.extract_text(df.limit(0)).count() == 0


def test_omitted_and_unclosed_tags():
    words = lambda html: " ".join(t for t in read(html).text if t is not None)
    for start in ("<html><head><title>T</title>", "<head><meta charset=utf-8><style>p{}</style><script>x</script>", "<head>"):
        for page in ("<article><p>Kept.</article>", "<body><p>Kept.", "<p>Kept.", "<a href=x>Kept.</a>", "Kept."):
            assert words(start + page) == "Kept."
    for name in ("object", "video", "audio", "canvas", "svg", "math", "template"):
        assert words(f"<p>Before.</p><div>a<{name} class=x></div><article><p>Kept.</p></article>") == "Before. a Kept."
        assert words(f"<article><{name}><p>Kept.</p><p>Too.</article><footer><{name}>no</{name}></footer>") == "Kept. Too."
        assert words(f"<head><{name}></head><body><p>Kept.</body>") == "Kept."
        assert words(f"<p>a</p><{name}><{name}>no</{name}>no</{name}><{name}/><p>b</p>") == "a b"
        assert words(f"<ul><li>a<{name}><li>b</ul><{name}>no</{name}>") == "a b"
    assert words("<p>a</p><video><p>no video</p></video><template><div>no</div></template><p>b</p>") == "a b"
    assert words("<p>a</p><svg><title>no</title><foreignObject><div>no</div></foreignObject></svg><p>b</p>") == "a b"
    assert words("<svg><path><article>Kept.</article></svg><p>b</p>") == "Kept. b"
    assert words("<template><p>no</div></template><p>b</p>") == "b"
    assert words("<svg>" * 3000 + "<p>Kept.") == "Kept."


def test_lines_keep_what_stands_in_them():
    blocks = lambda html: " ".join(html_extract.default_model().blocks(html))
    menu = "<nav><ul><li><a href=x>Home</a></li><li><a href=y>Contact us</a></li></ul></nav>"
    for article, want in (
        ("<p>Text with <label>name</label> and <button>Go</button> inside it, a full sentence.</p>", "Text with name and Go inside it, a full sentence."),
        ("<h1>Tips</h1><ul><li>One</li><li><a>Two</a></li></ul>", "Tips One Two"),
        ("<p><a>See the whole report here</a></p><p>Fine.</p>", "See the whole report here Fine."),
        ("<h1>Words</h1><table><tr><td><a href=x>River</a></td><td>walks over calm stone</td></tr></table>", "Words River walks over calm stone"),
    ):
        for page in (f"<article>{article}</article>", f"<html><body>{menu}<article>{article}</article><footer>&copy; Acme</footer></body></html>"):
            assert blocks(page) == want
    assert blocks(f"<body>{menu}<article><p>The river walks over bright stone every morning.</p><form><label>Your mail</label><input><button>Send</button></form></article></body>") == "The river walks over bright stone every morning."
    assert blocks(f"<body>{menu}<div class=cookie-notice><p>We use cookies here.</p><button>OK</button></div><article><p>The river walks over bright stone every morning.</p></article></body>") == "The river walks over bright stone every morning."
