"""Queries over intake, tools, stored artifacts, flags and streams, and their SQL twins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import EngineConfig
from millrace.functions.register import register
from millrace.operators import assemble as A
from millrace.operators import dissect as D
from millrace.operators import spans as S
from millrace.operators.observables import observables, place_cuts, text_mentions, truncated_inputs, typed_mentions, within_places
from millrace.queries import filled, filled_sql
from millrace.sources import registries as R
from millrace.sources.messages import form_messages
from millrace.streaming.dissect import dissect_stream, write_dissected
from millrace.workspace import shared_dir, table, written

PARTS = {"n": "p_partkey", "name": "p_name"}


def _of_parts(spark: SparkSession, sf_dir: str, lines: tuple[str, ...]) -> DataFrame:
    """A message for each row of ``part``."""
    values = {"n": F.col("p_partkey").cast("string"), "name": F.col("p_name")}
    return table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("msg_key"), filled(lines, values).alias("content"))


# -- intake ----------------------------------------------------------------------------

FORM = ("--Z9", 'Content-Disposition: form-data; name="note"', "", "n {n}", "--Z9", 'Content-Disposition: form-data; name="eml"; filename="a.eml"', "", "Subject: {name}", "", "body {n}", "--Z9--", "")
MAIL = ("Subject: {name}", "", "body {n}")


def form_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages posted as a form's field, and the same posted as they are: one key each."""
    forms = _of_parts(spark, sf_dir, FORM).select(F.col("content").alias("body"), F.lit('multipart/form-data; boundary="Z9"').alias("content_type"))
    plain = _of_parts(spark, sf_dir, MAIL).select(F.col("content").alias("body"), F.lit("message/rfc822").alias("content_type"))
    return form_messages(forms.union(plain)).groupBy("msg_key").agg(F.count("*").alias("n"), F.max(F.octet_length("content")).cast("long").alias("size"))


_FORMS = f"SELECT sha256({filled_sql(MAIL, PARTS)}) AS msg_key, 2 * count(*) AS n, max(strlen({filled_sql(MAIL, PARTS)}))::BIGINT AS size FROM part GROUP BY 1"


# -- tools -----------------------------------------------------------------------------

WITH_DOCUMENT = (
    "Subject: {name}", "Content-Type: multipart/related; boundary=R1", "", "--R1", "Content-Type: text/html; charset=utf-8", "", '<p>{name}</p><img src="CID:pic{n}"><img src="cid:pic{n}0"><a href="cid:doc{n}?x">d</a>',
    "--R1", 'Content-Type: application/pdf; name="d{n}.pdf"', "Content-Id: <doc{n}>", "", "%PDF-1.7 see host{n}.example.org", "--R1", "Content-Type: image/png", "Content-Id: <pic{n}>", "", "\x89PNG", "--R1--", "",
)


def _extractor(data: bytes, mime: str) -> tuple[str | None, str]:
    return data.decode("latin-1").partition(" ")[2], "ok"


def _renderer(html: str, assets: dict[str, tuple[bytes, str]]) -> tuple[bytes | None, str | None, str]:
    return html.encode() + b"".join(k.encode() for k in sorted(assets)), "image/png", "ok"


def _with_tools(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = written(D.dissect(_of_parts(spark, sf_dir, WITH_DOCUMENT)), "dissected")
    extracted = written(A.extract_documents(d, _extractor), "extracted")
    return d, extracted, written(A.render_messages(A.render_payloads(d), _renderer), "rendered")


def render_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a renderer is given: HTML whose references point at the parts beside it."""
    d = A.render_payloads(D.dissect(_of_parts(spark, sf_dir, WITH_DOCUMENT), fields=("parts",)))
    return d.select("msg_key", "message_index", "html", F.array_join(F.transform("assets", lambda a: F.concat_ws(":", a["cid"], a["name"], a["mime"])), " ").alias("assets"))


_PAYLOADS = """
SELECT 'p' || p_partkey AS msg_key, 0 AS message_index,
  '<p>' || p_name || '</p><img src="' || 'cid-3.png"><img src="cid:pic' || p_partkey || '0"><a href="cid-2.pdf?x">d</a>' AS html,
  'doc' || p_partkey || ':cid-2.pdf:application/pdf pic' || p_partkey || ':cid-3.png:image/png' AS assets
FROM part
"""


def tool_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tools add to the answer: states, the text of a document and its mentions, a picture."""
    d, extracted, rendered = _with_tools(spark, sf_dir)
    j = A.dissected_json(d, R.for_config(EngineConfig()), extracted=extracted, rendered=rendered)
    get = lambda path: F.get_json_object("json", path)
    found = F.filter(F.from_json(get("$.messages[0].observables"), "array<struct<value: string, type: string, sources: array<struct<source_kind: string, part_index: int>>>>"), lambda o: (o["sources"][0]["source_kind"] == "attachment") & (o["type"] == "domain"))
    linked = get("$.messages[0].attachments[0].text_artifact_id") == get("$.tool_artifacts[0].artifact_id")
    return j.select(
        "msg_key", get("$.tools.extractor").alias("extractor"), get("$.tools.renderer").alias("renderer"), get("$.tool_artifacts[0].filename").alias("text_name"), get("$.tool_artifacts[1].filename").alias("picture_name"),
        linked.alias("linked"), F.array_join(F.transform(found, lambda o: F.concat_ws(":", o["type"], o["value"], o["sources"][0]["part_index"])), " ").alias("found"),
    )


_ANSWERS = """
SELECT 'p' || p_partkey AS msg_key, 'ok' AS extractor, 'ok' AS renderer, 'd' || p_partkey || '.pdf.txt' AS text_name, '0-screenshot.png' AS picture_name, true AS linked,
  'domain:host' || p_partkey || '.example.org:2' AS found
FROM part
"""


def tool_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, extracted, rendered = _with_tools(spark, sf_dir)
    a = A.all_artifacts(d, extracted, rendered).where("kind in ('attachment_text', 'screenshot', 'attachment')")
    return a.select("msg_key", "kind", "part_index", "filename", "size", "sha256")


_POINTED = """'<p>' || p_name || '</p><img src="cid-3.png"><img src="cid:pic' || p_partkey || '0"><a href="cid-2.pdf?x">d</a>'"""
_TOOL_ARTIFACTS = f"""
WITH a AS (
  SELECT 'p' || p_partkey AS msg_key, 'attachment_text' AS kind, 2 AS part_index, 'd' || p_partkey || '.pdf.txt' AS filename, 'see host' || p_partkey || '.example.org' AS data FROM part
  UNION ALL SELECT 'p' || p_partkey, 'screenshot', NULL, '0-screenshot.png', {_POINTED} || 'cid-2.pdfcid-3.png' FROM part
  UNION ALL SELECT 'p' || p_partkey, 'attachment', 2, 'd' || p_partkey || '.pdf', '%PDF-1.7 see host' || p_partkey || '.example.org' FROM part
  UNION ALL SELECT 'p' || p_partkey, 'attachment', 3, 'part-3.bin', chr(137) || 'PNG' FROM part)
SELECT msg_key, kind, part_index, filename, strlen(data)::BIGINT AS size, sha256(data) AS sha256 FROM a
"""


# -- stored artifacts ------------------------------------------------------------------

def artifact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts asked for after some have expired, some are swept, and some never were."""
    now = F.lit(datetime(2024, 1, 1, 12)).cast("timestamp")
    key = F.col("p_partkey").cast("string")
    parts = table(spark, sf_dir, "part")
    stored = parts.where("p_partkey % 3 <> 2").select(
        key.alias("msg_key"), F.lit("a").alias("artifact_id"), F.lit("eml").alias("kind"), F.col("p_name").alias("filename"), F.encode("p_name", "UTF-8").alias("data"),
        F.when(F.col("p_partkey") % 3 == 0, now - F.expr("INTERVAL 1799 SECONDS")).otherwise(now - F.expr("INTERVAL 1800 SECONDS")).alias("created_at"),
    )
    kept = D.swept(stored, now)
    return D.looked_up(parts.select(key.alias("msg_key"), F.lit("a").alias("artifact_id")), kept, now).select("msg_key", "status", F.octet_length("data").cast("long").alias("size"))


_LOOKUP = """
SELECT p_partkey::VARCHAR AS msg_key, CASE p_partkey % 3 WHEN 0 THEN 'FOUND' WHEN 1 THEN 'EXPIRED' ELSE 'UNKNOWN' END AS status,
  CASE WHEN p_partkey % 3 = 0 THEN strlen(p_name) END::BIGINT AS size FROM part
"""


# -- flags and counts ------------------------------------------------------------------

def truncated_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs with more places than there are, and with a run too long to read: both are flagged."""
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), (F.col("p_partkey") % 4 + 1).cast("int")), lambda k: F.concat(F.lit("u"), k.cast("string"), F.lit("@example.com"))))
    text = F.when(F.col("p_partkey") % 50 == 0, F.concat(words, F.lit(" "), F.expr("repeat('x.', 140000)"))).otherwise(words)
    m = written(text_mentions(table(spark, sf_dir, "part").select("p_partkey", text.alias("t")), "p_partkey", "t"), "mentions")
    typed = written(typed_mentions(m, R.for_config(EngineConfig())), "typed")
    cuts = place_cuts(typed, 5)
    per = observables(within_places(typed, 5, cuts)).groupBy("msg_key").agg(F.count("*").alias("n_observables"))
    return per.join(truncated_inputs(m, cuts).withColumn("truncated", F.lit(True)), "msg_key", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))


#: k addresses and the domain they share are k + 1 places, if the domain is one.
_TRUNCATED = """
SELECT p_partkey::VARCHAR AS msg_key, least(p_partkey % 4 + 2, 5)::BIGINT AS n_observables, p_partkey % 50 = 0 OR p_partkey % 4 + 2 > 5 AS truncated FROM part
"""


def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, F.lit("no header")).when(k == 1, F.lit("Subject: x\r\nContent-Type: text/plain; charset=x-none\r\n\r\ny")).otherwise(F.lit("Subject: x\r\n\r\ny"))
    return D.run_metrics(D.dissect(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("msg_key"), F.encode(raw, "UTF-8").alias("content"))))


_COUNTS = """
SELECT count(*) AS inputs, sum((p_partkey % 3 = 0)::INT)::BIGINT AS failed, sum((p_partkey % 3 <> 0)::INT)::BIGINT AS messages, sum((p_partkey % 3 <> 0)::INT)::BIGINT AS parts,
  sum(CASE p_partkey % 3 WHEN 0 THEN 9 WHEN 1 THEN 57 ELSE 15 END)::BIGINT AS bytes, 0::BIGINT AS truncated, 0::BIGINT AS malformed_mime, sum((p_partkey % 3 = 1)::INT)::BIGINT AS encoding_fallback,
  0::BIGINT AS attachment_unreadable, 0::BIGINT AS artifact_store_failed
FROM part
"""


# -- the grammar -----------------------------------------------------------------------

#: A text for each row of ``part``, and what it mentions, in order: value, type, what was written
#: (null: the value), subtype, defanged, occurrences. What stands in braces is of the row.
CASES = (
    "(see https://h{n}.example.org/p_(x)?q=1). u{n}@mail.example.com, www.w{n}.example.net/a; b{n}.example.net/path! 203.0.113.{byte}. 2001:DB8::{byte} {md5} {sha} report{n}.pdf t{n}.example.net "
    "hxxps://d{n}[.]example[.]org/x v{n}(at)example[.]com mailto:a{n}@example.net,c{n}@example.net http://bücher.example.org/{n} http://[2001:db8:1::7]:8080/{n} <u{n}@mail.example.com> 300.1.1.1",
)
MENTIONED = (
    ("https://h{n}.example.org/p_(x)?q=1", "url", None, None, False, 1), ("h{n}.example.org", "domain", "https://h{n}.example.org/p_(x)?q=1", None, False, 1),
    ("u{n}@mail.example.com", "email", None, None, False, 2), ("mail.example.com", "domain", "u{n}@mail.example.com", None, False, 2),
    ("www.w{n}.example.net/a", "url", None, None, False, 1), ("www.w{n}.example.net", "domain", "www.w{n}.example.net/a", None, False, 1),
    ("b{n}.example.net/path", "url", None, None, False, 1), ("b{n}.example.net", "domain", "b{n}.example.net/path", None, False, 1),
    ("203.0.113.{byte}", "ip", None, "ipv4", False, 1), ("2001:db8::{byte}", "ip", "2001:DB8::{byte}", "ipv6", False, 1),
    ("{low}", "hash", "{md5}", "md5", False, 1), ("{sha}", "hash", None, "sha256", False, 1), ("report{n}.pdf", "filename", None, None, False, 1), ("t{n}.example.net", "domain", None, None, False, 1),
    ("https://d{n}.example.org/x", "url", "hxxps://d{n}[.]example[.]org/x", None, True, 1), ("d{n}.example.org", "domain", "hxxps://d{n}[.]example[.]org/x", None, True, 1),
    ("v{n}@example.com", "email", "v{n}(at)example[.]com", None, True, 1), ("example.com", "domain", "v{n}(at)example[.]com", None, True, 1),
    ("mailto:a{n}@example.net", "url", None, None, False, 1), ("a{n}@example.net", "email", "mailto:a{n}@example.net", None, False, 1), ("example.net", "domain", "mailto:a{n}@example.net", None, False, 2),
    ("c{n}@example.net", "email", None, None, False, 1),
    ("http://xn--bcher-kva.example.org/{n}", "url", "http://bücher.example.org/{n}", None, False, 1), ("xn--bcher-kva.example.org", "domain", "http://bücher.example.org/{n}", None, False, 1),
    ("http://[2001:db8:1::7]:8080/{n}", "url", None, None, False, 1), ("2001:db8:1::7", "ip", "http://[2001:db8:1::7]:8080/{n}", "ipv6", False, 1),
)


def grammar_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of mention in one text: found, typed by the registries, deduplicated, in order."""
    n = F.col("p_partkey").cast("string")
    values = {"n": n, "byte": (F.col("p_partkey") % 250 + 1).cast("string"), "md5": F.upper(F.md5(n.cast("binary"))), "sha": F.sha2(n.cast("binary"), 256)}
    texts = table(spark, sf_dir, "part").select("p_partkey", F.decode(filled(CASES, values), "UTF-8").alias("t"))
    typed = written(typed_mentions(text_mentions(texts, "p_partkey", "t"), R.for_config(EngineConfig())), "typed")
    o = observables(within_places(typed, EngineConfig().max_observable_places))
    return o.select(F.col("msg_key").cast("long").alias("p_partkey"), "ordinal", "value", "type", "value_raw", "subtype", "defanged", "occurrences", F.size("sources").alias("n_sources"))


def _mentioned_sql() -> str:
    fill = {"n": "p_partkey", "byte": "(p_partkey % 250 + 1)", "md5": "upper(md5(p_partkey::VARCHAR))", "low": "md5(p_partkey::VARCHAR)", "sha": "sha256(p_partkey::VARCHAR)"}
    said = lambda x: "NULL" if x is None else f"'{x}'"
    rows = [
        f"{{'ordinal': {k}, 'value': {filled_sql((value,), fill)}, 'type': '{kind}', 'raw': {filled_sql((raw or value,), fill)}, 'subtype': {said(subtype)}, 'defanged': {str(defanged).lower()}, 'n': {n}}}"
        for k, (value, kind, raw, subtype, defanged, n) in enumerate(MENTIONED)
    ]
    return f"""
SELECT p_partkey::BIGINT AS p_partkey, m.ordinal::INT AS ordinal, m.value AS value, m.type AS type, m.raw AS value_raw, m.subtype AS subtype, m.defanged AS defanged, m.n::BIGINT AS occurrences, 1 AS n_sources
FROM (SELECT p_partkey, unnest([{", ".join(rows)}]) AS m FROM part)
"""


# -- limits, and forms that are hard to read --------------------------------------------

def _message(spark: SparkSession, sf_dir: str, content: Column, config: EngineConfig = EngineConfig(), fields: tuple[str, ...] = D.FIELDS) -> DataFrame:
    """A message of text for each row of ``part``, dissected."""
    return D.dissect(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("msg_key"), F.encode(content, "UTF-8").alias("content")), config, fields)


def _choice(*of: str) -> Column:
    """One of the texts for each row, by its key; ``{n}`` is the key."""
    k, n = F.col("p_partkey") % len(of), F.col("p_partkey").cast("string")
    return F.get(F.array(*(F.replace(F.lit(x), F.lit("{n}"), n) for x in of)), k.cast("int"))


def part_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of one to six parts in a container, read with a limit of four."""
    k = (F.col("p_partkey") % 6 + 1).cast("int")
    content = F.concat(F.lit("Content-Type: multipart/mixed; boundary=B\r\n\r\n"), F.array_join(F.array_repeat(F.lit("--B\r\n\r\nx\r\n"), k), ""), F.lit("--B--\r\n"))
    d = _message(spark, sf_dir, content, EngineConfig(max_mime_parts=4))
    return d.select("msg_key", F.size(F.col("messages")[0]["parts"]).cast("long").alias("n_parts"), F.array_join("flags", ",").alias("flags"))


_PART_LIMITS = "SELECT 'p' || p_partkey AS msg_key, least(p_partkey % 6 + 2, 4)::BIGINT AS n_parts, CASE WHEN p_partkey % 6 + 2 > 4 THEN 'truncated' ELSE '' END AS flags FROM part"


def nesting_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages nested up to three deep, read with a limit of one: what is deeper is left and flagged."""
    k = (F.col("p_partkey") % 4).cast("int")
    content = F.concat(F.array_join(F.array_repeat(F.lit("Content-Type: message/rfc822\r\n\r\n"), k), ""), F.lit("Subject: last\r\n\r\nx"))
    d = _message(spark, sf_dir, content, EngineConfig(max_nesting_depth=1))
    return d.select("msg_key", F.size("messages").cast("long").alias("n_messages"), F.array_join("flags", ",").alias("flags"))


_NESTING_LIMITS = "SELECT 'p' || p_partkey AS msg_key, least(p_partkey % 4 + 1, 2)::BIGINT AS n_messages, CASE WHEN p_partkey % 4 > 1 THEN 'truncated' ELSE '' END AS flags FROM part"


def size_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An input past its limit is refused; a part past its own keeps digests and loses its bytes."""
    content = F.concat(F.lit("Content-Type: application/pdf\r\n\r\n"), F.expr("repeat('y', int(p_partkey % 3 * 50))"))
    d = _message(spark, sf_dir, content, EngineConfig(max_message_bytes=100, max_attachment_bytes=20))
    part = F.get(F.get("messages", F.lit(0))["parts"], F.lit(0))
    return d.select("msg_key", "ok", "error.code", part["size"].alias("size"), part["md5"].alias("md5"), part["payload"].isNotNull().alias("has_bytes"), F.array_join("flags", ",").alias("flags"))


_SIZE_LIMITS = """
SELECT 'p' || p_partkey AS msg_key, k < 2 AS ok, CASE WHEN k = 2 THEN 'TOO_LARGE' END AS code, CASE WHEN k < 2 THEN k * 50 END::BIGINT AS size, CASE WHEN k < 2 THEN md5(repeat('y', k * 50)) END AS md5,
  k = 0 AS has_bytes, CASE WHEN k = 1 THEN 'truncated' ELSE '' END AS flags
FROM (SELECT p_partkey, (p_partkey % 3)::INT AS k FROM part)
"""


def link_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to four links and pictures, read with a limit of two each."""
    k = (F.col("p_partkey") % 4 + 1).cast("int")
    content = F.concat(F.lit("Content-Type: text/html\r\n\r\n"), F.array_join(F.array_repeat(F.lit("<a href=/x>l</a><img src=/y>"), k), ""))
    d = _message(spark, sf_dir, content, EngineConfig(max_links=2, max_resources=2), ("events", "parts"))
    n = lambda kind: F.size(F.filter(F.col("messages")[0]["events"], lambda e: e["kind"] == kind)).cast("long")
    return d.select("msg_key", n("anchor").alias("n_links"), n("resource").alias("n_resources"), F.array_join("flags", ",").alias("flags"))


_LINK_LIMITS = """
SELECT 'p' || p_partkey AS msg_key, least(p_partkey % 4 + 1, 2)::BIGINT AS n_links, least(p_partkey % 4 + 1, 2)::BIGINT AS n_resources, CASE WHEN p_partkey % 4 > 1 THEN 'truncated' ELSE '' END AS flags FROM part
"""


def header_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folded value, an unknown charset, an address inside quotes, a value past its limit, bytes that are no text."""
    head = _choice(
        "Subject: one\r\n two {n}\r\n\r\n", "Subject: =?x-none?q?a{n}?=\r\n\r\n", 'From: "Bob <bob{n}@example.net>"\r\nSubject: s\r\n\r\n', "Subject: " + "z" * 65_537 + "\r\n\r\n", "Subject: s\r\nTo: " + "a@b.c, " * 2000 + "\r\n\r\n"
    )
    d = _message(spark, sf_dir, head, fields=("headers", "addresses"))
    m = F.col("messages")[0]
    subject = F.get(F.filter(m["headers"], lambda h: h["name"] == "subject"), F.lit(0))["value"]
    address = F.get(m["addresses"], F.lit(0))
    return d.select(
        "msg_key", F.length(subject).cast("long").alias("n"), F.when(F.col("msg_key").isNotNull() & (F.length(subject) < 99) & ~F.array_contains("flags", "encoding_fallback"), subject).alias("subject"),
        address["header"].alias("header"), address["display_name"].alias("display_name"), address["address"].alias("address"), F.array_join("flags", ",").alias("flags"),
    )


_HEADER_FORMS = """
SELECT 'p' || p_partkey AS msg_key, CASE k WHEN 0 THEN 8 + length(p_partkey::VARCHAR) WHEN 1 THEN 1 + length(p_partkey::VARCHAR) WHEN 3 THEN 65537 ELSE 1 END::BIGINT AS n,
  CASE k WHEN 0 THEN 'one two ' || p_partkey WHEN 2 THEN 's' WHEN 4 THEN 's' END AS subject, CASE k WHEN 2 THEN 'from' WHEN 4 THEN 'to' END AS header, CASE WHEN k = 2 THEN 'Bob' END AS display_name,
  CASE WHEN k = 2 THEN 'bob' || p_partkey || '@example.net' END AS address, CASE k WHEN 1 THEN 'encoding_fallback' WHEN 3 THEN 'truncated' WHEN 4 THEN 'truncated' ELSE '' END AS flags
FROM (SELECT p_partkey, p_partkey % 5 AS k FROM part)
"""


def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's name in five forms."""
    head = _choice(
        'Content-Disposition: attachment; filename="a{n};b.pdf"', "Content-Disposition: attachment; filename*=utf-8''%C3%A9{n}.txt", "Content-Disposition: attachment; filename=plain{n}.txt; filename*=x-none''%E9.txt",
        "Content-Disposition: attachment; filename*0=a; filename*1={n}.txt", "Content-Type: application/pdf; name==?utf-8?q?=C3=A9{n}?=",
    )
    d = _message(spark, sf_dir, F.concat(head, F.lit("\r\n\r\nx")), fields=("parts",))
    return d.select("msg_key", F.col("messages")[0]["parts"][0]["filename"].alias("filename"), F.array_join("flags", ",").alias("flags"))


_NAME_FORMS = """
SELECT 'p' || p_partkey AS msg_key, CASE k WHEN 0 THEN 'a' || p_partkey || ';b.pdf' WHEN 1 THEN 'é' || p_partkey || '.txt' WHEN 2 THEN 'plain' || p_partkey || '.txt' WHEN 3 THEN 'a' || p_partkey || '.txt' ELSE 'é' || p_partkey END AS filename,
  CASE WHEN k = 2 THEN 'encoding_fallback' ELSE '' END AS flags
FROM (SELECT p_partkey, p_partkey % 5 AS k FROM part)
"""


def transfer_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies in five transfer encodings, sound, damaged and unknown."""
    coded = F.base64(F.encode(F.concat(F.lit("b64 "), F.col("p_partkey").cast("string")), "UTF-8"))
    heads = _choice("quoted-printable", "base64", "base64", "base64", "x-unknown")
    bodies = F.get(F.array(_choice("a=3D{n}=\r\nz"), coded, F.concat(F.lit("****"), coded), F.lit("QUJDR"), _choice("raw {n}")), (F.col("p_partkey") % 5).cast("int"))
    d = _message(spark, sf_dir, F.concat(F.lit("Subject: x\r\nContent-Type: text/plain\r\nContent-Transfer-Encoding: "), heads, F.lit("\r\n\r\n"), bodies), fields=("parts",))
    part = F.get(F.get("messages", F.lit(0))["parts"], F.lit(0))
    return d.select("msg_key", part["text"].alias("text"), part["sha1"].alias("sha1"), F.array_join("flags", ",").alias("flags"))


_TRANSFER_FORMS = """
SELECT 'p' || p_partkey AS msg_key, text, sha1(text) AS sha1, CASE k WHEN 2 THEN 'malformed_mime' WHEN 3 THEN 'attachment_unreadable' WHEN 4 THEN 'malformed_mime' ELSE '' END AS flags
FROM (SELECT p_partkey, p_partkey % 5 AS k, CASE p_partkey % 5 WHEN 0 THEN 'a=' || p_partkey || 'z' WHEN 1 THEN 'b64 ' || p_partkey WHEN 2 THEN 'b64 ' || p_partkey WHEN 4 THEN 'raw ' || p_partkey END AS text FROM part)
"""


# -- HTML, SQL functions, streams ------------------------------------------------------

def html_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that a page loads by itself, with the element that does."""
    n = F.col("p_partkey").cast("string")
    html = F.concat(
        F.lit('<img src="i'), n, F.lit('.png" srcset="a'), n, F.lit(" 1x, b"), n, F.lit(' 2x"><link href=l'), n, F.lit("><video poster=v></video><style>p{background:url('u"), n, F.lit("')}</style><input src=no>")
    )
    e = S.html_events(table(spark, sf_dir, "part").select("p_partkey", html.alias("html")), "p_partkey", "html").where("kind = 'resource'")
    return e.select("p_partkey", "element", "href")


_RESOURCES = """
SELECT p_partkey, e.element, e.href FROM (SELECT p_partkey, unnest([
  {'element': 'img', 'href': 'i' || p_partkey || '.png'}, {'element': 'img', 'href': 'a' || p_partkey}, {'element': 'img', 'href': 'b' || p_partkey},
  {'element': 'link', 'href': 'l' || p_partkey}, {'element': 'other', 'href': 'v'}, {'element': 'style', 'href': 'u' || p_partkey}]) AS e FROM part)
"""


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine's functions under their SQL names."""
    register(spark, R.for_config(EngineConfig()))
    table(spark, sf_dir, "part").createOrReplaceTempView("millrace_part")
    return spark.sql(
        "SELECT p_partkey, canonical_url(u) AS url, m.kind, m.value, public_suffix(m.host) AS suffix FROM (SELECT p_partkey, concat('HTTP://H', p_partkey, '.Example.ORG/', p_size, '?a#b') AS u FROM millrace_part), "
        "LATERAL mentions(concat('write to u', p_partkey, '@example.com')) AS m"
    )


_FUNCTIONS = """
SELECT p_partkey, 'http://h' || p_partkey || '.example.org/' || p_size || '?a#b' AS url, m.kind, m.value, m.suffix FROM (
  SELECT *, unnest([{'kind': 'email', 'value': 'u' || p_partkey || '@example.com', 'suffix': NULL}, {'kind': 'host', 'value': 'example.com', 'suffix': 'com'}]) AS m FROM part)
"""


def stream_dissect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of stored messages, dissected and written once; its relation is that of a batch."""
    import uuid

    at = f"{shared_dir(spark)}/millrace/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    source = _of_parts(spark, sf_dir, MAIL)
    source.write.parquet(f"{at}/in")
    streamed = spark.readStream.schema(source.schema).parquet(f"{at}/in")
    query = write_dissected(dissect_stream(streamed), f"{at}/out", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return D.headers(spark.read.parquet(f"{at}/out")).select("msg_key", "message_index", "name", "value")


_STREAMED = "SELECT 'p' || p_partkey AS msg_key, 0 AS message_index, 'subject' AS name, p_name AS value FROM part"

QUERIES = {
    f.__name__: f
    for f in (part_limits, nesting_limits, size_limits, link_limits, header_forms, name_forms, transfer_forms, grammar_cases, form_intake, render_payloads, tool_answers, tool_artifacts, artifact_lookup, truncated_places, run_counts, html_resources, sql_functions, stream_dissect)
}
ORACLES: dict[str, str] = {
    "part_limits": _PART_LIMITS, "nesting_limits": _NESTING_LIMITS, "size_limits": _SIZE_LIMITS, "link_limits": _LINK_LIMITS, "header_forms": _HEADER_FORMS, "name_forms": _NAME_FORMS,
    "transfer_forms": _TRANSFER_FORMS, "grammar_cases": _mentioned_sql(), "form_intake": _FORMS, "render_payloads": _PAYLOADS, "tool_answers": _ANSWERS, "tool_artifacts": _TOOL_ARTIFACTS, "artifact_lookup": _LOOKUP, "truncated_places": _TRUNCATED, "run_counts": _COUNTS,
    "html_resources": _RESOURCES, "sql_functions": _FUNCTIONS, "stream_dissect": _STREAMED,
}
