"""Extraction of main text, and the toxicity model."""

import numpy as np
import pytest

from millrace.llm import site_style, toxicity


@pytest.mark.parametrize(
    "html, blocks",
    [
        ("<div>a<nav>m</nav><p>x&amp;y<br>z<p>q</div>", ["a", "x&y z", "q"]),
        ('<p>a<b>c</p>d<!-- x --><script>var a="</p>"</script>e', ["ac", "de"]),
        ("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>", ["a", "b", "1", "2", "3"]),
        ("a < b <", ["a < b <"]),
        ('<div class="comments">no</div><div class="post">yes <span class="ad">x</span>it</div>', ["yes it"]),
        ('<header>site</header><article><header><h1>T</h1></header><p>t</p><footer>f</footer><aside>s</aside><section class="comments"><article class="comment">c</article></section></article><p>out</p>', ["T", "t"]),
        ('<main><p>in</p><form><label>no</label></form></main><div id="cookie-notice">no</div>', ["in"]),
        ("<form><article><p>in</p></article></form><form>no</form>", ["in"]),
        ('<div role="navigation">no</div><div aria-hidden="true">no</div><div style="display: none">no</div><p>yes', ["yes"]),
        ("<p>&#233;&eacute;&#x1F600;&nbsp;&lt;b&gt; a\n\t b</p>", ["éé😀 <b> a b"]),
        ('<article><p title="a hidden gem">Kept</p><p>And <a href="/x" title="the hidden door">this</a> too</p><p hidden>no</p><div aria-label="x" HIDDEN="">no</div></article>', ["Kept", "And this too"]),
        ('<article><p class="related">Text</p><div class="related">no</div><h2 id="share">Head</h2></article>', ["Text", "Head"]),
        ("<!-- never <p>a", []), ("<script>never", []), ("", []), ('<p title="a>b">q</p>', ["q"]),
    ],
)
def test_blocks(html, blocks):
    assert site_style.Page(html).main() == blocks


@pytest.mark.parametrize("unit", ['<a "', "<a ", "<!--", "<div>", "<p>", "</b>", "<li>", "&", "<script>", "<div></p>"])
def test_hostile_markup_is_linear(unit):
    import time

    began = time.time()
    site_style.Page(unit * 50_000)
    assert time.time() - began < 5


def test_style_tree_removes_what_pages_share(spark):
    page = lambda k: f'<body><div class="x"><p>Same on all</p></div><div class="y"><div class="in"><p>Own text {k} of page {k * 7}</p></div></div></body>'
    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(12)] + [(100, "http://other.example/", page(3)), (101, None, page(4)), (102, "http://h.example/x", None), (None, "nonsense", "")]
    d = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in site_style.extract_main_text(d).collect()}
    assert len(got) == len(rows)
    for k in range(12):
        assert (got[k].text, got[k].n_removed) == (f"Own text {k} of page {k * 7}", 1)
    assert got[100].text == "Same on all\nOwn text 3 of page 21" and got[101].text.startswith("Same") and (got[102].text, got[102].n_chars, got[None].text) == ("", 0, "")
    assert site_style.extract_main_text(d.limit(0)).count() == 0


def test_copies_of_an_article_do_not_erase_it(spark):
    d = spark.createDataFrame([(k, "http://h.example/a", '<div class="menu">m</div><div class="post"><p>One article for all</p></div>') for k in range(20)], "page_id long, url string, html string")
    assert {r.text for r in site_style.extract_main_text(d).collect()} == {"One article for all"}


def test_shared_text_is_removed_at_any_depth(spark):
    deep = lambda k: "<div>" * 11 + f'<div class="x"><p>Same on all</p></div><div class="y"><p>Own text {k} of page {k * 7}</p></div>' + "</div>" * 11
    d = spark.createDataFrame([(k, f"http://h.example/{k}", deep(k)) for k in range(12)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in site_style.extract_main_text(d).collect()} == {k: f"Own text {k} of page {k * 7}" for k in range(12)}
    page = site_style.Page("<div>x" * 20_000)  # what a page holds grows with its length, not with its depth
    assert len(page.blocks) == 20_000 and len(page.up) == len(page.nodes) <= site_style.NESTING + 1


@pytest.mark.parametrize("pages", [2, 4, 12])
def test_short_articles_lose_long_shared_text(spark, pages):
    page = lambda k: f'<div class="x"><p>{"The same long text on all pages. " * 20}</p></div><div class="y"><p>Own {k}</p></div>'
    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(pages)] + [(100, "http://h.example/copy", page(0))]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in site_style.extract_main_text(d).collect()} == {**{k: f"Own {k}" for k in range(pages)}, 100: "Own 0"}


def plain_tree(pages):
    """Importance of every branch of a host's pages, in plain words: each branch by itself."""
    from collections import Counter, defaultdict
    from math import log

    there, styles, features = Counter(), defaultdict(Counter), defaultdict(Counter)
    for page in pages:
        beneath = defaultdict(set)
        for text, _, n in page.blocks:
            while n >= 0:
                beneath[n].add(text)
                n = page.up[n]
        branch = {n: b for b, n in page.nodes.items()}
        for n, texts in beneath.items():
            there[branch[n]] += 1
            features[branch[n]].update(texts)
            styles[branch[n]].update({c for b, c in page.styles if b == branch[n]})
    out = {}
    for b, m in there.items():
        if m > 1:
            p = [c / sum(styles[b].values()) for c in styles[b].values()]
            presentation = -sum(x * log(x) for x in p) / log(m)
            content = 1 - sum(log(c) for c in features[b].values()) / len(features[b]) / log(m)
            g = site_style.GAMMA ** len(p)
            out[b] = (m, content, g * presentation + (1 - g) * content if p else content)
    return out


def test_importance_against_a_plain_version(spark):
    rng = np.random.default_rng(2)
    kinds = ("<nav><a>x</a></nav>", '<div class="n7"><p>{k}</p><p>same</p></div>', '<div class="n8"><b>q</b></div>', '<section id="s"><div class="i"><p>{r}</p></div><h2>h</h2></section>', "<p>{k}</p>", "<footer>f {r}</footer>")
    rows = []
    for k in range(60):
        body = "".join(kinds[j].replace("{k}", f"t{k}").replace("{r}", f"r{rng.integers(0, 5)}") for j in rng.integers(0, 6, 5))
        rows.append((k, f"http://{'hot' if k % 3 else 'cold'}.example/{k}", body + f"<p>of its own {k}</p>"))
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    from pyspark.sql import functions as F

    tree = site_style.style_tree(site_style.once(site_style.parse_pages(d).withColumn("row", F.monotonically_increasing_id())))
    got = {(r.host, r.branch): (r.pages, r.content, r.importance) for r in tree.collect()}
    want = {(h, b): v for h in ("hot.example", "cold.example") for b, v in plain_tree([site_style.Page(s) for _, u, s in rows if h in u]).items()}
    assert got.keys() == want.keys() and len(got) > 8
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


def test_the_tree_speaks_for_what_stands_outside_the_article(spark):
    """Text beside an article stays where the host shows it is no frame; a teaser takes nothing."""
    page = lambda k: f'<body><div class="top">One frame</div><div class="lead"><p>Lead text {k}</p></div><p>Plain {k}</p><article><p>Teaser {k}</p></article><div class="more">Ever the same</div></body>'
    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(8)] + [(50, "http://alone.example/", page(9))]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in site_style.extract_main_text(d).collect()}
    assert {k: (got[k].text, got[k].n_removed) for k in range(8)} == {k: (f"Lead text {k}\nPlain {k}\nTeaser {k}", 2) for k in range(8)}
    assert got[50].text == "Teaser 9"


def test_repeated_pages_ties_and_a_hot_host(spark, monkeypatch):
    frame = lambda k, t: f'<nav><a>Home</a></nav><div class="q{k % 2}">Bar</div><article><p>{t}</p></article><footer>End</footer>'
    rows = [(k, f"http://hot.example/{k % 50}", frame(k, f"Text {k % 50}")) for k in range(120)] + [(k, f"http://h{k}.example/", frame(k, f"Only {k}")) for k in range(200, 230)]
    rows += [rows[0]] * 5 + [(None, "http://hot.example/1", frame(1, "Text 1"))] * 2
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, host string, texts string")
    want = sorted(((k, "Text " + str(int(u.rsplit("/", 1)[1])) if "hot" in u else f"Only {k}") for k, u, _ in rows), key=str)
    for most in (20_000, 0):  # what the tree says is broadcast, or meets the pages' branches in a join
        monkeypatch.setattr(site_style, "BROADCAST_ROWS", most)
        got = site_style.extract_main_text(d).collect()
        assert sorted(((r.page_id, r.text) for r in got), key=str) == want
        assert all(r.n_removed == 3 for r in got if "hot" in r.url)


def test_the_tree_takes_frames_without_a_name(spark, sf):
    """The tables' pages, each host with one frame of its own, and nothing that says what is what:
    what is left is what the article holds."""
    import html as H
    import re

    rows, want = [], {}
    for k, r in enumerate(spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id").collect()):
        host, inner = f"h{k % 5}.example", r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        frame = f'<div class="qa"><ul><li><a href="/">{host}</a><li><a href="/a">About</a></ul></div><div class="qb">Read {host} daily</div>'
        rows.append((r.page_id, f"http://{host}/{k}", f'<html><body>{frame}<div class="qc">{inner}</div><div class="qd"><p>By {host}</p></div>'))
        blocks = [" ".join(H.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))]
        want[r.page_id] = "\n".join(x for x in blocks if x)
    got = site_style.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want and {r.n_removed for r in got} == {4}


def test_articles_of_the_pages(spark, sf):
    import html as H
    import re

    for r in site_style.op1_html(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        want = [" ".join(H.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))]
        assert r.text == "\n".join(x for x in want if x) and r.n_chars == len(r.text)


def test_machine_learns_a_pair():
    """Neither term tells by itself; both together do."""
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(2) < 0.5) for _ in range(1500)]
    y = np.array([len(r) == 2 for r in rows], float)
    m = toxicity.FactorizationMachine(2).fit(rows, y, epochs=60)
    z = [m.logits(np.array(a, np.int64), np.zeros(len(a), np.int64), 1)[0] for a in ([], [0], [1], [0, 1])]
    assert max(z[:3]) < -0.8 < 0 < z[3] and (m.v[0] @ m.v[1]) > 0.1


def test_scores_against_all_pairs():
    """Logits are the bias, the terms' weights, and the product of every two terms' vectors."""
    rng = np.random.default_rng(5)
    m = toxicity.FactorizationMachine(40, 3)
    m.b, m.w, m.v = -0.7, rng.normal(size=40).astype(np.float32), rng.normal(size=(40, 3)).astype(np.float32)
    rows = [np.flatnonzero(rng.random(40) < share) for share in (0, 0.1, 0.5, 1, 0, 0.3)]
    got = m.logits(np.concatenate(rows), np.repeat(np.arange(6), [len(r) for r in rows]), 6)
    want = [m.b + m.w[r].sum() + sum(float(m.v[i] @ m.v[j]) for k, i in enumerate(r) for j in r[k + 1 :]) for r in rows]
    assert got == pytest.approx(want, abs=1e-4)


def test_weights_alone_miss_a_pair():
    """The same texts, with pair vectors and without: two words that tell only by being there both, or neither."""
    rng = np.random.default_rng(1)
    rows = [np.sort(np.concatenate([np.flatnonzero(rng.random(2) < 0.5), rng.choice(np.arange(2, 30), 5, False)])) for _ in range(2000)]
    y = np.array([(0 in r) == (1 in r) for r in rows], float)
    right = {}
    for factors in (8, 0):
        m = toxicity.FactorizationMachine(30, factors).fit(rows, y, epochs=200)
        z = m.logits(np.concatenate(rows), np.repeat(np.arange(2000), [len(r) for r in rows]), 2000)
        right[factors] = np.mean((z > 0) == (y > 0))
    assert right[8] > 0.95 and right[0] < 0.7


def test_fit_learns_a_pair_of_neutral_words(spark):
    """Each word is in half of the toxic texts and in half of the clean ones."""
    rng = np.random.default_rng(3)
    text = lambda words: " ".join(rng.permutation([*words, *rng.choice([f"{a}{b}word" for a in "bcdfgh" for b in "aeiou"], 6, False)]))
    rows = [(k, *(((text(["zorblat", "quimper"]), 1), (text(["frumious"]), 1), (text(["zorblat"]), 0), (text(["quimper"]), 0))[k % 4])) for k in range(1600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scorer = toxicity.fit(d.select("doc_id", "text"), d.select("doc_id", "toxic"))
    at = {w: np.mean(scorer.score([text(w.split()) for _ in range(50)], {}) >= toxicity.THRESHOLD) for w in ("zorblat quimper", "frumious", "zorblat", "quimper")}
    assert min(at["zorblat quimper"], at["frumious"]) > 0.9 and max(at["zorblat"], at["quimper"]) < 0.1


def test_held_out(spark):
    d = "/root/testdata/sf0.01"
    rows = toxicity.op5_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean([(a > b) + (a == b) / 2 for a in toxic for b in clean]) > 0.8  # area under the curve
    assert np.mean([s < toxicity.THRESHOLD for s in clean]) > 0.95


def test_held_out_of_the_larger_table(spark):
    d = "/root/testdata/sf0.1"
    rows = toxicity.op5_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    found, false = ([r.predicted for r in rows if r.toxic == t] for t in (1, 0))
    print("held out: found", sum(found), "of", len(found), "false", sum(false), "of", len(false))
    assert np.mean(found) > 0.9 and np.mean(false) < 0.005


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (6, 0), (7, None), (999, 1), (None, 1)], "doc_id long, toxic int")
    for docs, lab in ((odd_docs, labels), (odd_docs, labels.limit(0)), (no_docs, labels), (odd_docs, labels.where("toxic = 0"))):
        s = toxicity.fit(docs, lab)
        got = toxicity.score_documents(docs, s).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
        whole = toxicity.score_documents(docs, s, whole_rows=True)
        assert whole.columns[:-1] == docs.columns


def test_pipeline(spark, sf):
    import corpus_pipeline
    from millrace.workspace import table

    docs = table(spark, sf, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
    assert quality_then_all(spark, sf) <= before * 2
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_pipeline_of_odd_rows(spark, odd_docs, no_docs, tmp_path):
    """Each stage takes nulls, empty and long texts, repeated rows, clashing names and an empty table."""
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 0), (6, 1, 0), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    clashing = odd_docs.withColumnsRenamed({"n_chars": "_h", "rep": "row"}).withColumn("_score", odd_docs.doc_id).withColumn("mark", odd_docs.lang).withColumn("n_tokens", odd_docs.doc_id)
    for docs in (clashing, clashing.where("doc_id is null"), clashing.limit(0), no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            rows = out.collect()
            if name == "bpe":
                assert len(rows) == docs.count() and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                assert out.columns == docs.columns and len(rows) <= 2 * docs.count(), name
                assert set(map(str, rows)) <= set(map(str, docs.collect())), name
        left = docs
        for name, stage in corpus_pipeline.STAGES:
            left = stage(spark, left, str(tmp_path))
        left.collect()


def quality_then_all(spark, sf):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf).count()
