"""HTML extraction by site style trees.

The pages of a host are merged into one tree of branches, a branch being a chain of
elements with their classes and ids. Of each branch the tree holds how many pages have
it, how often each presentation (the sequence of its child elements) occurs, and on how
many pages each of its text features occurs. Importance joins two entropies:

* presentation: the entropy of the styles over pages, base the number of pages ``m``;
* content: one less the mean, over distinct features, of ``log_m`` of a feature's pages;
  text that every page repeats has importance 0, text of one page has 1;

``composite = g**l * presentation + (1 - g**l) * content`` with ``l`` the number of
styles. All text of a page goes to the tree, that of menus and adverts too. A branch of
``MIN_PAGES`` pages or more is noise if its importance is below ``LEAST`` and all beneath it
is too, that is, its content is below ``LEAST_CONTENT``: one frame around texts of their own
is no noise. Noise leaves every page of the host.

Entropy cannot know a menu that differs from page to page, nor a host of one page. Three
priors stand beside it: an element or class that says what it is (navigation, footer, advert,
form, comment) goes, whatever its importance, but inside an article only containers are asked
for their class, not paragraphs; plain paragraphs and headings, in no branch with a
name, stay; and where a page has an article (else a main part), what stands
outside it stays only in a branch that the tree has found important.
Pages of a host with the same text are one page to the tree, since copies of an article
would else erase each other. A page that holds nothing but noise has an empty text.

Each page is parsed once, to a written table of blocks; the tree is counted from it with
sums before every shuffle, so a host with a third of all pages is no single task's work. What
the tree says goes to pages by a broadcast only if it is counted small, else by a join of
pages' branches with it.

Defined results: null or empty html gives an empty text; a page whose URL is null or has
no host belongs to no site and is judged by itself; markup that never ends is closed at
the end of the page; repeated rows are extracted alike; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.text import pieces, strings
from millrace.workspace import Written, mapped, spread, table

GAMMA, LEAST, LEAST_CONTENT, MIN_PAGES = 0.9, 0.3, 0.4, 2
#: As in browsers, elements below so many open ones stand beside each other there; they keep branches of their own.
NESTING = 512
BROADCAST_ROWS = 20_000

#: Element names of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    # The second line is no text, and no break in a block either.
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "script style template noscript button select textarea svg math canvas object iframe audio video map".split()
)
DROPPED = frozenset(
    "head script style noscript template nav aside footer form button select option textarea datalist iframe svg math canvas object audio video menu dialog map title xmp noembed noframes".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: Of the dropped, those whose content is no text of the page, and so in no style tree.
SILENT = frozenset("head script style noscript template title textarea iframe svg math canvas object audio video map xmp noembed noframes".split())
#: A start tag of the key closes an open element of the values, up to the fence.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = frozenset("ul ol dl table select body article main section div".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbox adslot sponsor sponsored promo promotion banner menu nav navbar navigation navigator breadcrumb breadcrumbs "
    "sidebar sidemenu footer masthead topbar cookie cookies consent gdpr notice notices popup popups modal overlay newsletter subscribe signup login comment comments "
    "commentlist disqus replies share sharing social related recommended recommendations widget widgets toolbar pagination pager searchbox searchform skiplink".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
KEEPERS = frozenset("html body article main".split())
#: In an article these are asked for no class.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table tr td th thead tbody li dl dt dd figure figcaption".split())
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th tr tbody thead table ul ol dl dt dd figure figcaption article main body html header".split())

_TAG = re.compile(r"""<(?:!--(?:.*?--!?>|.*)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|[!?/][^>]*+>)""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|["'=/]""")
_NAMED = re.compile(r"[a-z]+")
_NUMBER = re.compile(r"[0-9]+")


def key64(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def host_of(url: str | None) -> str | None:
    if not url or "://" not in url:
        return None
    return re.split(r"[/?#]", url.split("://", 1)[1], maxsplit=1)[0].lower() or None


#: Branches of text outside every named one, by rank.
OWN = (key64("own/0"), key64("own/1"))


class Page:
    """One pass over a page: its text blocks, each with the branches it stands in."""

    def __init__(self, source: str):
        #: (text, rank, the innermost node it stands in). rank: 2 in an article, 1 in a main part, 0 elsewhere, -1 where a name says it goes.
        #: Text of an article in no branch with a name has node -1; such text elsewhere stands in the branch OWN.
        self.blocks: list[tuple[str, int, int]] = []
        #: The branches that entropy may take, outer before inner, each with the node it stands in; a branch's key is of its whole chain.
        self.nodes: dict[int, int] = {}
        self.up: list[int] = []
        self.styles: Counter[tuple[int, str]] = Counter()
        self.buffer: list[str] = []
        self.stack: list[list] = []  # [tag, branch, innermost node, rank, child tags, where dropping began]
        self.open: Counter[str] = Counter()
        self.read(source)

    def flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            self.buffer.clear()
            if text:
                top = self.stack[-1] if self.stack else None
                rank, node = (-1 if top[5] else top[3], top[2]) if top else (0, -1)
                if node < 0 and 0 <= rank < 2:
                    node = self.node(OWN[rank], -1)
                self.blocks.append((text, rank, node))

    def node(self, branch: int, outer: int) -> int:
        if branch not in self.nodes:
            self.nodes[branch] = len(self.up)
            self.up.append(outer)
        return self.nodes[branch]

    def push(self, tag: str, attrs: str) -> None:
        top = self.stack[-1] if self.stack else None
        outer = self.stack[min(len(self.stack), NESTING) - 1] if top else None
        branch, node, rank, dropped = (outer[1], outer[2], top[3], top[5]) if top else (0, -1, 0, None)
        named, hint = "", False
        if attrs:
            found = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTR.findall(attrs) if m[0]}
            named = f"{found.get('class', '')} {found.get('id', '')}".strip().lower()
            role = found.get("role", "").lower()
            hint = role in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
            if role == "main" or role == "article":
                rank = max(rank, 1)
        if tag in ("article", "main"):
            rank = max(rank, 2 if tag == "article" else 1)
            if dropped == "form":
                dropped = None
        if named and (tag not in KEEPERS or tag == "article") and not (rank == 2 and tag in TEXT):
            hint = hint or not HINTS.isdisjoint(_NAMED.findall(named))
        if dropped is None and (hint or tag in DROPPED or tag == "header" and rank == 0):
            dropped = "script" if tag in INLINE else tag
        if tag not in INLINE:
            self.flush()
            if top is not None:
                top[4].append(tag)
            branch = key64(f"{branch}/{tag}" + (f".{_NUMBER.sub('0', named)}" if named else ""))
            if named or tag not in PLAIN:
                node = self.node(branch, node)
        self.stack.append([tag, branch, node, rank, [], dropped])
        self.open[tag] += 1

    def pop(self) -> None:
        tag, branch, _, _, children, dropped = self.stack[-1]
        if tag not in INLINE:
            self.flush()
            if dropped not in SILENT and children:
                self.styles[branch, " ".join(children)] += 1
        self.stack.pop()
        self.open[tag] -= 1

    def start(self, tag: str, attrs: str) -> None:
        if tag in CLOSES_P and self.open["p"]:
            while self.open["p"]:
                self.pop()
        elif tag in CLOSES:
            closes = CLOSES[tag]
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in closes:
                    while len(self.stack) > k:
                        self.pop()
                elif self.stack[k][0] in FENCE:
                    break
        if tag == "body" and self.open["head"]:
            while self.open["head"]:
                self.pop()
        if tag in VOID:
            if tag in ("br", "wbr"):
                if tag == "br":
                    self.data(" ")
            elif tag not in INLINE:
                self.flush()
            return
        self.push(tag, attrs)
        if attrs.endswith("/") and tag in ("svg", "path", "use"):
            self.pop()

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
            return
        if not self.open[tag]:
            return
        while self.stack[-1][0] != tag:
            self.pop()
        self.pop()

    def data(self, text: str) -> None:
        if not (self.stack and self.stack[-1][5] in SILENT):
            self.buffer.append(entities.unescape(text) if "&" in text else text)

    def read(self, source: str) -> None:
        at, last = 0, source.rfind(">") + 1
        while True:
            lt = source.find("<", at)
            if lt < 0:
                break
            m = _TAG.match(source, lt) if lt < last or source.startswith("<!--", lt) else None
            if lt > at:
                self.data(source[at:lt])
            if m is None:
                # What never ends is no text if it began as a tag.
                if source[lt + 1 : lt + 2].isalpha() or source[lt + 1 : lt + 2] in ("/", "!"):
                    if lt >= last:
                        at = len(source)
                        break
                self.data("<")
                at = lt + 1
                continue
            at = m.end()
            slash, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if slash:
                self.end(tag)
                continue
            self.start(tag, attrs)
            if tag in RAW and self.open[tag]:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
                at = close.start() if close else len(source)
                if not close:
                    break
        if at < len(source):
            self.data(source[at:])
        while self.stack:
            self.pop()
        self.flush()

    def main(self) -> list[str]:
        """What a page of its own host alone keeps: the article if it names one, else the main part, else all."""
        best = max((rank for _, rank, _ in self.blocks), default=-1)
        return [t for t, rank, _ in self.blocks if rank == best >= 0]


PARSED = (
    "page_id long, url string, host string, texts array<string>, digest long, ranks array<int>, nodes array<int>, branches array<long>, up array<int>, facts array<struct<node: int, kind: int, value: long>>"
)
SAID = "host string, branch long, kind int, value long"


def parse_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Blocks of every page with their nodes, the branch of each node and the node it stands
    in, and what the page says about a node itself: kind 1, a presentation; 2, a text feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, html):
                urls = piece.column(1).to_pylist()
                hosts, texts, digests, ranks, nodes, branches, up, facts = [], [], [], [], [], [], [], []
                for u, source in zip(urls, strings(piece, html), strict=True):
                    page = Page(source)
                    host = host_of(u)
                    said: set[tuple[int, int, int]] = set()
                    if host is not None:
                        said.update((n, 2, key64(text)) for text, _, n in page.blocks if n >= 0)
                        said.update((page.nodes[b], 1, key64(children)) for b, children in page.styles if b in page.nodes)
                    hosts.append(host)
                    texts.append([t for t, _, _ in page.blocks])
                    digests.append(key64("\n".join(page.main())))
                    ranks.append([r for _, r, _ in page.blocks])
                    nodes.append([n for _, _, n in page.blocks])
                    branches.append(list(page.nodes))
                    up.append(page.up)
                    facts.append([{"node": n, "kind": k, "value": v} for n, k, v in sorted(said)])
                fact = pa.list_(pa.struct([("node", pa.int32()), ("kind", pa.int32()), ("value", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(hosts, pa.string()), pa.array(texts, pa.list_(pa.string()))]
                    + [pa.array(digests, pa.int64()), pa.array(ranks, pa.list_(pa.int32())), pa.array(nodes, pa.list_(pa.int32())), pa.array(branches, pa.list_(pa.int64())), pa.array(up, pa.list_(pa.int32())), pa.array(facts, fact)],
                    names=["page_id", "url", "host", "texts", "digest", "ranks", "nodes", "branches", "up", "facts"],
                )

    return mapped(spread(pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias(html))), run, PARSED)


def _say(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a page says about each branch: kind 0, it is there; 1, a presentation; 2, a text
    feature of its own or of a branch beneath. Inner nodes first, so that a feature set is
    held no longer than until its outer node has it."""
    for batch in batches:
        out: list[tuple[str, int, int, int]] = []
        for row in range(batch.num_rows):
            host, branches, up, facts = (batch.column(c)[row].as_py() for c in range(4))
            styles: dict[int, list[int]] = {}
            under: dict[int, set[int]] = {}
            for f in facts:
                if f["kind"] == 1:
                    styles.setdefault(f["node"], []).append(f["value"])
                else:
                    under.setdefault(f["node"], set()).add(f["value"])
            for n in range(len(up) - 1, -1, -1):
                values = under.pop(n, None)
                if not values:
                    continue
                out.append((host, branches[n], 0, 0))
                out.extend((host, branches[n], 1, v) for v in styles.get(n, ()))
                for v in values:
                    out.append((host, branches[n], 2, v))
                    if len(out) >= 50_000:
                        yield _rows(out, SAID)
                        out = []
                if up[n] >= 0:
                    outer = under.setdefault(up[n], values)
                    if outer is not values:
                        outer.update(values)
        yield _rows(out, SAID)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], names=[f for f, _ in fields])


LEFT = "page_id long, url string, text string, n_removed long"


def kept_blocks(ranks: list[int], nodes: list[int], branches: list[int], up: list[int], noise: set[int], important: set[int]) -> tuple[list[bool], int]:
    """Which blocks of a page stay, and how many the tree takes."""
    gone: list[bool] = []
    for b, n in zip(branches, up, strict=True):
        gone.append(b in noise or n >= 0 and gone[n])
    taken = [n >= 0 and gone[n] for n in nodes]
    best = max((r for r, t in zip(ranks, taken, strict=True) if not t), default=-1)
    keep = [not t and r >= 0 and (r == best or branches[n] in important) for r, n, t in zip(ranks, nodes, taken, strict=True)]
    return keep, sum(taken)


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages without the blocks that the tree, or a prior, takes."""
    for batch in batches:
        out, held = [], 0
        for row in range(batch.num_rows):
            page_id, url, texts, ranks, nodes, branches, up, noise, important = (batch.column(c)[row].as_py() for c in range(9))
            keep, taken = kept_blocks(ranks, nodes, branches, up, set(noise or ()), set(important or ()))
            out.append((page_id, url, "\n".join(t for t, k in zip(texts, keep, strict=True) if k), taken))
            held += len(out[-1][2])
            if held > 4 << 20:
                yield _rows(out, LEFT)
                out, held = [], 0
        yield _rows(out, LEFT)


def style_tree(parsed: DataFrame) -> DataFrame:
    """(host, branch, pages, styles, presentation, content, importance)."""
    said = parsed.where("host is not null and size(facts) > 0").select("host", "branches", "up", "facts")
    said = mapped(said, _say, SAID).groupBy("host", "branch", "kind", "value").agg(F.count("*").alias("n"))
    n = F.col("n").cast("double")
    tree = said.groupBy("host", "branch").agg(
        F.max(F.when(F.col("kind") == 0, n)).alias("pages"),
        F.coalesce(F.sum(F.when(F.col("kind") == 1, n)), F.lit(0.0)).alias("style_n"),
        F.coalesce(F.sum(F.when(F.col("kind") == 1, n * F.log(n))), F.lit(0.0)).alias("style_log"),
        F.sum((F.col("kind") == 1).cast("long")).alias("styles"),
        F.sum((F.col("kind") == 2).cast("long")).alias("features"),
        F.coalesce(F.sum(F.when(F.col("kind") == 2, F.log(n))), F.lit(0.0)).alias("feature_log"),
    )
    m = F.log("pages")
    return (
        tree.where(F.col("pages") > 1)
        .withColumn("presentation", F.when(F.col("style_n") > 0, (F.log("style_n") - F.col("style_log") / F.col("style_n")) / m).otherwise(0.0))
        .withColumn("content", 1 - F.col("feature_log") / F.greatest(F.col("features"), F.lit(1)) / m)
        .withColumn("importance", F.pow(F.lit(GAMMA), F.col("styles")) * F.col("presentation") + (1 - F.pow(F.lit(GAMMA), F.col("styles"))) * F.col("content"))
        .withColumn("importance", F.when(F.col("styles") == 0, F.col("content")).otherwise(F.col("importance")))
        .select("host", "branch", "pages", "styles", "presentation", "content", "importance")
    )


def once(parsed: DataFrame) -> DataFrame:
    """One row of those of a host with the same text. Only texts that more rows have are joined."""
    copied = parsed.where("host is not null").groupBy("host", "digest").agg(F.count("*").alias("n"), F.min("row").alias("first")).where("n > 1").drop("n")
    copied = Written(copied, "copied", few=True).df
    small = F.broadcast(copied) if copied.count() <= BROADCAST_ROWS else copied
    return parsed.join(small, ["host", "digest"], "left").where("first is null or first = row").drop("first")


def verdicts(tree: DataFrame) -> DataFrame:
    """(host, branch, noise) of the branches that the tree can tell of."""
    noise = (F.col("importance") < LEAST) & (F.col("content") < LEAST_CONTENT)
    # Text in no named branch is never noise: its branch can only speak for it.
    return tree.where(F.col("pages") >= MIN_PAGES).select("host", "branch", noise.alias("noise")).where(~F.col("noise") | ~F.col("branch").isin(*OWN))


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_removed (blocks that the tree takes) of every row: blocks joined by newline."""
    parsed = Written(parse_pages(pages, key, url, html).withColumn("row", F.monotonically_increasing_id()), "pages").df
    said = Written(verdicts(style_tree(once(parsed))), "verdicts", few=True).df
    of = lambda noise: F.collect_list(F.when(F.col("noise") == noise, F.col("branch")))
    if said.count() <= BROADCAST_ROWS:
        per_host = said.groupBy("host").agg(of(True).alias("noise"), of(False).alias("important"))
        d = parsed.join(F.broadcast(per_host), "host", "left")
    else:
        # A page's own branches meet the tree, so that no host is held whole.
        asked = parsed.where("host is not null").select("row", "host", F.explode("branches").alias("branch"))
        per_page = Written(asked.join(said, ["host", "branch"]).groupBy("row").agg(of(True).alias("noise"), of(False).alias("important")), "said").df
        d = parsed.join(per_page, "row", "left")
    own = lambda c: F.array_intersect("branches", c)
    d = mapped(d.select("page_id", "url", "texts", "ranks", "nodes", "branches", "up", own("noise").alias("noise"), own("important").alias("important")), _keep, LEFT)
    return d.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_removed")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
