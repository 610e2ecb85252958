"""Relations, registries, components and streams over Spark, and every query's SQL twin."""

import random

import pytest
from pyspark.sql import functions as F

from millrace import queries, tool_queries
from millrace.config import EngineConfig
from millrace.functions import scalars
from millrace.operators import assemble as A
from millrace.operators import dissect as D
from millrace.plans import components
from millrace.plans.components import connected_components
from millrace.sources import registries as R
from millrace.sources.messages import read_messages, stream_messages, with_keys


QUERIES = queries.QUERIES | tool_queries.QUERIES
ORACLES = queries.ORACLES | tool_queries.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, sf, duck, same_rows, name):
    same_rows(QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_suffixes(spark):
    r = R.load()
    hosts = ["example.com", "a.example.co.uk", "foo.bar.ck", "www.ck", "x.www.ck", "ck", "a.b.mm", "github.io", "blogspot.com", "wersja.1.2", "localhost", "nothing.invalidtld", "", ".com", "a..com", "A.ORG."]
    rng = random.Random(3)
    hosts += [".".join(rng.choice(["a", "www", "ck", "mm", "com", "co", "uk", "jp", "kobe", "city", "zz"]) for _ in range(rng.randint(1, 5))) for _ in range(300)]
    got = {x.host: x.suffix for x in R.host_suffixes(spark.createDataFrame([(h,) for h in hosts], "host string"), R.suffix_rules(spark, r)).collect()}
    assert {h: got.get(h) for h in hosts} == {h: r.public_suffix(h) for h in hosts}
    assert r.public_suffix("foo.bar.ck") == "bar.ck" and r.public_suffix("www.ck") == "ck" and r.public_suffix("github.io") == "io" and r.public_suffix("wersja.1.2") is None
    assert R.load(("ps1",)).version != r.version and "ps1" in R.load(("ps1",)).extensions


def test_scalars(spark):
    d = spark.createDataFrame([(n,) for n in ("notes.pdf", "A.PDF", "a.b.c", ".a.b", "a..b", "dir/.a.b", "C:\\t.d\\N.PDF", "notes", ".profile", "archive.exe.", "dir.d/file", "...")], "n string")
    got = [r[0] for r in d.select(scalars.extension(F.col("n"))).collect()]
    assert got == ["pdf", "pdf", "c", "b", "b", "b", "pdf", None, None, None, None, None]
    names = spark.createDataFrame([("../../etc/passwd",), ("in\r\nX: yes.pdf",), ("C:\\windows\\evil.exe",), ("",), ("..",), ("a" * 300 + ".pdf",), ("résumé  v2.pdf",), (None,)], "n string")
    got = [r[0] for r in names.select(scalars.safe_name(F.col("n"), F.lit("none"))).collect()]
    assert got == ["passwd", "inX: yes.pdf", "evil.exe", "none", "none", "a" * 96 + ".pdf", "résumé v2.pdf", "none"]
    types = spark.createDataFrame([("APPLICATION/PDF; charset=binary",), ("image/png",), (None,)], "t string")
    assert [r[0] for r in types.select(scalars.is_document(F.col("t"))).collect()] == [True, False, False]


@pytest.mark.parametrize("small", [200_000, 0])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(components, "BROADCAST_EDGES", small)
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5001 + k) for k in range(300)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges + [(None, 1)], "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


RAW = b"From: a@example.org\r\nSubject: seen twice b@example.org b@example.org\r\nContent-Type: text/html\r\n\r\n<a href='https://w.example/?u=https%3A%2F%2Fzly.host%2F'>b@example.org</a><img src='cid:none'>"


def test_observables_of_a_message(spark):
    from millrace.functions.urls import UnwrapRule

    c = EngineConfig(unwrap_rules=(UnwrapRule("w.example", "query:u"),))
    d = D.dissect(with_keys(spark.createDataFrame([(bytearray(RAW),)], "content binary")), c)
    o = {(r.value, r.type): r for r in A.all_observables(d, R.load(), c).collect()}
    assert o["b@example.org", "email"].occurrences == 3 and [s.source_kind for s in o["b@example.org", "email"].sources] == ["header", "body_html"]
    assert o["https://zly.host/", "url"].value_raw == "https://zly.host/" and ("zly.host", "domain") in o
    link = D.links(d).first()
    assert (link.href, link.host, link.text) == ("https://zly.host/", "zly.host", "b@example.org") and link.rewritten_from.startswith("https://w.example")
    ordered = sorted(o.values(), key=lambda r: r.ordinal)
    assert [r.ordinal for r in ordered] == list(range(len(ordered))) and ordered[0].value == "a@example.org"


def test_tools_only_extend(spark):
    raw = b"Subject: x.example.org\r\nContent-Type: application/pdf\r\n\r\n%PDF-1 y"
    messages = with_keys(spark.createDataFrame([(bytearray(raw),)], "content binary"))
    d = D.dissect(messages)
    texts = A.extract_documents(d, lambda data, mime: (f"{mime} names z.example.org", "ok"))
    before = [(r.value, r.ordinal) for r in A.all_observables(d, R.load()).orderBy("ordinal").collect()]
    after = [(r.value, r.ordinal) for r in A.all_observables(d, R.load(), extracted=texts).orderBy("ordinal").collect()]
    assert after[: len(before)] == before and "z.example.org" in dict(after)
    broken = A.extract_documents(d, lambda data, mime: 1 / 0)
    assert [r.state for r in broken.collect()] == ["down"]
    assert spark.createDataFrame([("ok",), ("timeout",), ("skipped",)], "s string").agg(A.worst_state(F.col("s"))).first()[0] == "timeout"


def test_links_are_capped(spark):
    raw = b"Subject: x\r\nContent-Type: text/html\r\n\r\n" + b"<a href=a>x</a>" * 5
    d = D.dissect(with_keys(spark.createDataFrame([(bytearray(raw),)], "content binary")), EngineConfig(max_links=3))
    assert D.links(d).count() == 3 and D.flag_table(d).first().flag == "truncated"


def test_files_and_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.eml").write_bytes(RAW)
    (tmp_path / "in" / "b.eml").write_bytes(b"Subject: " + b"x" * 500 + b"\r\n\r\n")
    c = EngineConfig(max_message_bytes=400)
    rows = {r.ok: r for r in D.dissect(read_messages(spark, str(tmp_path / "in"), c), c).collect()}
    assert rows[False].error.code == "TOO_LARGE" and len(rows[True].messages) == 1
    from millrace.streaming.dissect import dissect_stream, write_dissected

    q = write_dissected(dissect_stream(stream_messages(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert {r.msg_key for r in streamed.collect()} == {r.msg_key for r in read_messages(spark, str(tmp_path / "in")).collect()}


def test_a_part_of_the_fields_is_what_all_give(spark):
    raw = [RAW, b"Subject: x\r\nReceived: from a by b; c\r\n\r\ny http://w.example/", b"no header"]
    messages = with_keys(spark.createDataFrame([(bytearray(x),) for x in raw], "content binary"))
    whole = D.dissect(messages)
    for fields, relation in ((("headers",), D.headers), (("addresses",), D.addresses), (("received",), D.received), (("parts",), D.mime_parts), (("parts",), D.attachments), (("mentions",), D.mention_table), (("events", "parts"), D.links)):
        rows = lambda d: sorted(map(str, relation(d).collect()))
        assert rows(D.dissect(messages, fields=fields)) == rows(whole)
    with pytest.raises(ValueError):
        D.dissect(messages, fields=("header",))


def test_what_is_late_is_left_and_flagged():
    inner = b"Content-Type: multipart/mixed; boundary=B\r\n\r\n--B\r\nContent-Type: message/rfc822\r\n\r\nSubject: in\r\n\r\nx\r\n--B--\r\n"
    ticks = iter(range(1000))
    row = D.dissect_bytes(inner, EngineConfig(max_input_millis=1), clock=lambda: next(ticks))
    assert row["ok"] and row["flags"] == ["truncated"] and len(row["messages"]) == 1
    assert len(D.dissect_bytes(inner, EngineConfig())["messages"]) == 2


def test_observed_counts(spark):
    messages = with_keys(spark.createDataFrame([(bytearray(RAW),), (bytearray(b"no"),)], "content binary"))
    d, seen = D.observed(D.dissect(messages))
    d.write.format("noop").mode("overwrite").save()
    assert seen.get == {"inputs": 2, "failed": 1, "messages": 1}


def test_tool_states_and_a_renderer_that_fails(spark):
    raw = b"Subject: x\r\nContent-Type: text/html\r\n\r\n<p>x</p>"
    messages = with_keys(spark.createDataFrame([(bytearray(raw),), (bytearray(b"Subject: y\r\n\r\nz"),)], "content binary"))
    d = D.dissect(messages)
    payloads = A.render_payloads(d)
    for answer, state in (((b"i", "image/png", "ok"), "ok"), ((b"i", "text/html", "ok"), "down"), ((b"", "image/png", "ok"), "down"), ((None, None, "timeout"), "timeout")):
        rendered = A.render_messages(payloads, lambda html, assets, a=answer: a)
        assert [(r.state, r.image is None) for r in rendered.collect()] == [(state, state != "ok")]
        assert sorted(tuple(r)[1:] for r in A.tool_states(d, None, rendered).collect()) == sorted([("disabled", state), ("disabled", "skipped")])
    assert [r.state for r in A.render_messages(payloads, lambda html, assets: 1 / 0).collect()] == ["down"]


def test_flags_of_places_and_runs(spark):
    many = b"Subject: x\r\n\r\n" + b" ".join(b"u%d@example.org" % k for k in range(9))
    messages = with_keys(spark.createDataFrame([(bytearray(many),), (bytearray(b"Subject: y\r\n\r\nz"),)], "content binary"))
    d = D.dissect(messages)
    assert sorted(r.flags for r in A.flags(d, R.load(), EngineConfig(max_observable_places=4)).collect()) == [[], ["truncated"]]
    assert {tuple(r.flags) for r in A.flags(d, R.load()).collect()} == {()}
    assert A.all_observables(d, R.load(), EngineConfig(max_observable_places=4)).count() == 4


def plain_observables(text, registry):
    """What a text mentions, gathered in one loop."""
    from millrace.functions.grammar import mentions

    found = {}
    for m in mentions(text or ""):
        typed = [(m.kind, m.value)] if m.kind not in ("token", "host") else []
        known = m.host is not None and registry.public_suffix(m.host) is not None
        is_file = m.kind == "token" and "." in m.value and m.value.rsplit(".", 1)[-1].lower() in registry.extensions
        typed += [("domain", m.host)] * known + [("filename", m.value)] * is_file
        for kind, value in typed:
            o = found.setdefault((value, kind), [m.raw, m.subtype, m.defanged, known and is_file and m.kind == "token", 0])
            o[-1] += 1
    return [(n, value, kind, *o) for n, ((value, kind), o) in enumerate(found.items())]


@pytest.mark.parametrize("name, key, texts", [("observables_documents", "doc_id", "documents"), ("observables_pages", "page_id", None)])
def test_observables_against_a_loop(spark, sf, name, key, texts):
    r = R.load()
    rows = spark.read.parquet(f"{sf}/documents.parquet") if texts else queries.html_text(spark, sf)
    want = sorted(((getattr(x, key), *o) for x in rows.collect() for o in plain_observables(x.text, r)), key=str)
    got = QUERIES[name](spark, sf).select(key, "ordinal", "value", "type", "value_raw", "subtype", "defanged", "ambiguous", "occurrences")
    assert sorted(map(tuple, got.collect()), key=str) == want and len(want) > 5


@pytest.mark.parametrize("name", ["top_domains", "host_suffix", "grammar_cases", "observables_documents", "tool_answers", "truncated_places", "dissect_json"])
def test_a_machine_without_lists_answers_alike(spark, sf, duck, same_rows, monkeypatch, name):
    R.load.cache_clear()
    monkeypatch.setattr(R, "_from_class_path", lambda: None)
    monkeypatch.setattr(R, "_from_jars", lambda: None)
    monkeypatch.setattr(R, "MIME_TYPES", "/nowhere/mime.types")
    try:
        same_rows(QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLES[name]).df())
    finally:
        R.load.cache_clear()


def test_page_texts_are_what_their_sql_gives(spark, duck, same_rows, tmp_path):
    parts = "<p>|</P>|<br|<br/>|<td x>|<TH>|<b>|<!--|-->|<!-->|<script>|</script>|<SCRIPT>|<style a>|</style>|<pre\n>|<li a>|<|>|</|&amp;|&amp|&copy;|&copy|&quot;|&middot;|&lt;|&#38;|&|;|\n|\r\n| |\t|\f|\xa0|x|yz|\u00e9|<\u017fection>|<lin\u212a>|<bloc\u212aquote>|<d\u0130alog>|<d\u0131v>|<a href='x>y'>".split("|")
    rng = random.Random(9)
    pages = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(3000)] + ["the&&amp</p>", "", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duck.cursor()
    con.sql(f"CREATE TEMP VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    same_rows(QUERIES["html_text"](spark, str(tmp_path)).toPandas(), con.sql(ORACLES["html_text"]).df())


def test_addresses_are_counted_as_their_sql_does(spark, duck, same_rows, tmp_path):
    texts = ["u-v@W.Org x+y@w.ORG, w.ORG@w.org", "http://a@b.com/ mailto:q@w.org?cc=q@w.org", "v@w.org-x v@w.org_x v@w.org", "..a@b.c .a@b.c a..b@c.d a.@b.c", "one[at]w.org", "(é_@w.org)", "a@b.c_d@e.f@g.h", "", None]
    rows = [*enumerate(texts), (0, "v@W.Org"), (None, "v@w.org")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duck.cursor()
    con.sql(f"CREATE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same_rows(QUERIES["emails_documents"](spark, str(tmp_path)).toPandas(), con.sql(ORACLES["emails_documents"]).df())


def test_observables_of_a_table_are_not_capped(spark, duck, same_rows, tmp_path):
    places = EngineConfig().max_observable_places
    texts = [" ".join(f"u{k}@w.example.com" for k in range(places + 7)), "x," * 140_000 + "far@end.example.com near@end.example.com", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duck.cursor()
    con.sql(f"CREATE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {name: QUERIES[name](spark, str(tmp_path)).toPandas() for name in ("emails_documents", "observables_documents")}
    assert len(got["emails_documents"]) == places + 9
    for name, rows in got.items():
        same_rows(rows, con.sql(ORACLES[name]).df())
