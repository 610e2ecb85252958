"""URL filters: logistic regression on hashed character n-grams of host and path,
under a small table of host and path rules.

The model is trained on the driver from a small labelled URL table (a parameter; its
size is the bound). A URL's score is the sum of its host's part and its path's part, so
each distinct host and path of a batch is hashed once.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits
no rule, and is scored by the bias alone; with an empty labelled table nothing is
unwanted; repeated rows are judged alike; of two rules
of one length the block wins; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.text import strings
from millrace.workspace import mapped, table

#: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: The labelled URL table. 1 is unwanted.
UNWANTED = (
    "casino-royal.com/play bestcasino.net/slots online-casino.org/bonus casino-spin.info/en poker-bets.com/tables bets-bonus.org/today "
    "bets-live.net/odds sportsbets.com/free freebet.info/win win-jackpot.net/spin slots-casino.com/free lucky-win.org/bets "
    "discount-pills.com/buy pills-online.net/order buy-pills.org/cheap cheap-meds.com/pills viagra-pills.net/cheap pharma-pills.info/sale "
    "diet-pills.com/offer cheap-viagra.org/now adult-films.com/video xxx-adult.net/cam adult-video.org/free porn-x.com/tube free-porn.net/xxx "
    "sex-cam.com/live adult-chat.net/x adults-only.info/pics hot-sex.org/video xxx-tube.com/watch porn-hub-x.net/free adult-dating.com/x "
    "click-ads.com/click tracker.net/pixel ad-tracker.org/r clickads.com/track ads-server.net/banner popup-ads.info/go tracking-ads.com/c "
    "ads.doubletrack.net/imp adtrack.org/click banner-ads.com/track spam-list.com/list link-farm.net/links seo-spam.org/farm "
    "content-farm.info/page spam-links.com/go farmed-links.net/spam spammers.org/x bulk-spam.com/mail replica-watches.com/cheap "
    "cheap-replica.net/buy payday-loan.com/fast fast-loans.net/cash free-warez.org/crack crack-keygen.com/download torrent-crack.net/free "
    "malware-drop.com/exe phish-login.net/account free-iphone-win.com/claim click-here-win.org/prize get-rich-fast.com/now"
).split()
WANTED = (
    "news.daily.com/world/2024 blog.travel.org/spain/3 www.library.edu/books wiki.science.org/article/physics docs.python.org/3/library "
    "university.edu/research/paper www.museum.org/history/12.html garden.org/plants/rose cooking.com/recipes/bread m.weather.com/today "
    "health.gov/advice/flu www.city.gov/services school.org/math/lesson thesis.edu/2019/45.html blog.code.net/post/17 "
    "forum.bikes.com/thread/88 recipes.net/soup/9 music.org/jazz/albums film.com/reviews/77 maps.org/europe/en trainlines.net/timetable "
    "encyclopedia.org/wiki/tree poetry.net/en/55 www.thehen.org/en/12/ another.net/de/900.html history.info/rome/caesar painting.org/oil "
    "shop.books.com/novel/5 journal.science.com/vol/3 m.theredon.com/fr/67#top blog.tionand.org/en/8 www.tinhered.net/de/31 onthere.org/es/4.html "
    "ermine.com/en/23?page=2 theater.org/plays/6 blog.thinker.com/en/70 www.ering.net/en/8.html station.org/de/44 estate.com/en/7?ref=x "
    "handwork.net/fr/12/ redbrick.org/en/90 www.other.com/es/15 m.hester.net/en/3 ration.org/en/38 ionics.com/de/2 northern.org/news/en "
    "blog.father.net/family/6 nation.org/politics/21 weather.net/rain/de mathematics.edu/proof/1 chess.org/openings/4 birds.com/watching/8 "
    "river.net/fish/en farmhouse.org/visit trackday.com/race bettergarden.net/soil adulteducation.org/courses pillow.com/bedding spamalot.org/play "
    "windmill.net/tour freedom.org/essay/2 addition.edu/sum cheapside.org/london winter.com/ski betterment.org/plan"
).split()
#: What says nothing. A listed name is also seen with these before and after it.
BEFORE, AFTER, PATHS = ("", "www.", "blog.", "m."), (".com", ".net", ".org", ".info", ".co.uk", ".site.com", ".site.org"), ("/", "/index.html", "/en/4", "/page/33.html", "/item/705/")


def labelled_table() -> tuple[tuple[str, int], ...]:
    """(url, 1 if unwanted): the listed URLs, and each name under four neutral frames."""
    rows = [(f"http://{u}", y) for part, y in ((UNWANTED, 1), (WANTED, 0)) for u in part]
    for part, y in ((UNWANTED, 1), (WANTED, 0)):
        for k, u in enumerate(part):
            name = re.sub(r"^(?:www|blog|m)\.|\.[a-z]+$", "", u.partition("/")[0])
            name = re.sub(r"^(?:www|blog|m)\.", "", name)
            rows += [(f"http://{b}{name}{AFTER[(k + j) % len(AFTER)]}{PATHS[(k + j) % len(PATHS)]}", y) for j, b in enumerate(BEFORE)]
    return tuple(rows)


LABELLED = labelled_table()


#: Hosts and paths whose scores a task remembers, and the longest of them.
KNOWN, KNOWN_CHARS = 100_000, 256


def split_url(url: str) -> tuple[str, str]:
    """Host and path: after the first ``://`` up to ``/ ? #``; then up to ``? #``."""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def rule_for(host: str, path: str, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[str, str] | None:
    """(rule as text, verdict) of the longest rule that fits."""
    fits = [(len(h) + len(p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
    return max(fits)[2:] if fits else None


class UrlModel:
    """Weights over 2**bits hashed n-grams; host and path have n-grams of their own."""

    def __init__(self, bits: int = 16, least: int = 3, most: int = 5):
        self.bits, self.least, self.most = bits, least, most
        self.w, self.b = np.zeros(1 << bits), 0.0

    def grams(self, part: str, text: str) -> np.ndarray:
        """Bucket of every n-gram; ends are marked, digits are alike."""
        if not text:
            return np.empty(0, np.int64)
        mask, s = (1 << self.bits) - 1, re.sub(r"[0-9]", "0", f"^{text}$")
        return np.array([zlib.crc32(f"{part}{s[i : i + n]}".encode()) & mask for n in range(self.least, self.most + 1) for i in range(len(s) - n + 1)], np.int64)

    def part(self, part: str, text: str) -> float:
        g = self.grams(part, text)
        return float(self.w[g].sum() / np.sqrt(len(g))) if len(g) else 0.0

    def fit(self, urls: Sequence[tuple[str, int]], rounds: int = 1500, rate: float = 1.0, l2: float = 1e-3) -> UrlModel:
        """Full-batch gradient steps: the same table gives the same weights."""
        if not urls:  # nothing is known to be unwanted
            self.b = -50.0
            return self
        rows = []
        for url, y in urls:
            host, path = split_url(url)
            rows.append(([(g, 1 / np.sqrt(len(g))) for g in (self.grams("h", host), self.grams("p", path)) if len(g)], y))
        at = np.concatenate([g for r, _ in rows for g, _ in r])
        x = np.concatenate([np.full(len(g), v) for r, _ in rows for g, v in r])
        row = np.concatenate([np.full(sum(len(g) for g, _ in r), k) for k, (r, _) in enumerate(rows)])
        y = np.array([y for _, y in rows], float)
        for _ in range(rounds):
            z = np.bincount(row, x * self.w[at], len(rows)) + self.b
            e = (1 / (1 + np.exp(-z)) - y) / len(rows)
            self.w -= rate * 10 * (np.bincount(at, x * e[row], len(self.w)) + l2 * self.w / len(rows))
            self.b -= rate * e.sum()
        return self


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, labelled: Sequence[tuple[str, int]] = LABELLED, threshold: float = 0.5) -> DataFrame:
    """``key``, host, path, rule, verdict, score of every row."""
    model = UrlModel().fit(labelled)
    schema = pages.select(key).schema.add("host", "string").add("path", "string").add("rule", "string").add("verdict", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: dict[str, float] = {}
        paths: dict[str, float] = {}
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for u in strings(batch, url):
                host, path = split_url(u)
                if (h := hosts.get(host)) is None:
                    h = model.part("h", host)
                    if len(host) <= KNOWN_CHARS:
                        hosts[host] = h
                if (p := paths.get(path)) is None:
                    p = model.part("p", path)
                    if len(path) <= KNOWN_CHARS:
                        paths[path] = p
                score = 1 / (1 + np.exp(-(model.b + h + p)))
                rule = rule_for(host, path, rules)
                for col, v in zip(out, (host, path, rule and rule[0], rule[1] if rule else "block" if score >= threshold else "allow", float(score)), strict=True):
                    col.append(v)
            for cache in (hosts, paths):
                if len(cache) > KNOWN:
                    cache.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, (pa.string(),) * 4 + (pa.float64(),), strict=True))], names=schema.names)

    return mapped(pages.select(key, url), run, schema)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
