"""Messages taken apart: one Python pass over each, relations by Spark.

:func:`dissect` runs the row-local work once, in Arrow batches, and gives one nested row a
message; write or checkpoint it, and every relation below is a projection, a filter or a
join over it, pruned to the columns it reads. Rows carry ordinals; nothing depends on the
order of rows. A row that cannot be read has ``ok`` false and an error, and fails nothing.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.config import EngineConfig
from millrace.functions.decoding import writable
from millrace.functions.grammar import Mention, mentions, skips_a_run, url_mentions
from millrace.functions.headers import auth_results, received_hop
from millrace.functions.html import read_html
from millrace.functions.mime import Parsed, Part, header_end, is_message, messages_of
from millrace.functions.scalars import digests, extension, is_document
from millrace.functions.urls import unwrap, url_parts
from millrace.sources.messages import TOO_LARGE
from millrace.workspace import mapped, spread

#: Fixed value: the order flags are given in.
FLAGS = ("truncated", "malformed_mime", "encoding_fallback", "attachment_unreadable", "artifact_store_failed")

URL_FIELDS = "href string, scheme string, host string, port int, userinfo string, path string, query string, fragment string, host_idn string, host_punycode string, rewritten_from string, unwrap_failed boolean"
MESSAGE = f"""
message_index int, depth int, eml binary, header_block binary, text_part_index int, html_part_index int, text_from_html string,
headers array<struct<field_ordinal int, name_ordinal int, name string, header_index int, value string>>,
addresses array<struct<ordinal int, header string, display_name string, address string, local_part string, domain string>>,
received array<struct<ordinal int, from_host string, from_ip string, by_host string, `with` string, id string, `for` string, timestamp string>>,
auth array<struct<ordinal int, method string, result string, params map<string, string>>>,
parts array<struct<part_index int, content_type string, disposition string, filename string, content_id string, size bigint, charset_declared string, charset_used string,
  transfer_encoding string, is_container boolean, is_message boolean, md5 string, sha1 string, sha256 string, detected_mime string, text string, payload binary>>,
events array<struct<ordinal int, kind string, text string, element string, {URL_FIELDS}>>,
mentions array<struct<stage int, unit int, `match` int, fan int, kind string, value string, value_raw string, subtype string, defanged boolean, host string,
  source_kind string, header_name string, header_index int, part_index int>>
"""


#: What a caller may want of each message beside its place and its bodies' places.
FIELDS = ("eml", "header_block", "text_from_html", "headers", "addresses", "received", "auth", "parts", "events", "mentions")
#: Rows, and bytes of their inputs, that leave the pass in one batch.
BATCH_ROWS, BATCH_INPUT = 256, 4 << 20


def row_schema(fields: Sequence[str] = FIELDS) -> T.StructType:
    """The nested row of an input; made where a session is."""
    whole = T.StructType.fromDDL(MESSAGE.replace("\n", " "))
    message = T.StructType([f for f in whole.fields if f.name not in FIELDS or f.name in fields])
    row = T.StructType.fromDDL("msg_key string, ok boolean, error struct<code string, message string>, source struct<size bigint, md5 string, sha1 string, sha256 string>, flags array<string>")
    return row.add("messages", T.ArrayType(message))


class _Row:
    """One input's nested row: texts made writable on their way out, what that loses flagged."""

    def __init__(self, config: EngineConfig, fields: Sequence[str] = FIELDS, late: Callable[[], bool] = lambda: False):
        self.config, self.fields, self.late, self.flags = config, frozenset(fields), late, set()
        self.links, self.resources = config.max_links, config.max_resources

    def t(self, text: str | None) -> str | None:
        if text is None:
            return None
        clean, lost = writable(text)
        if lost:
            self.flags.add("encoding_fallback")
        return clean

    def event(self, n: int, e) -> dict | None:
        if e.kind == "text":
            return {"ordinal": n, "kind": "text", "text": self.t(e.text)}
        left = "links" if e.kind == "anchor" else "resources"
        if getattr(self, left) <= 0:
            self.flags.add("truncated")
            return None
        setattr(self, left, getattr(self, left) - 1)
        target = unwrap(e.href, self.config.unwrap_rules)
        p = url_parts(target.href)
        fields = {k: self.t(v) if isinstance(v, str) else v for k, v in p._asdict().items()}
        return {"ordinal": n, "kind": e.kind, "text": self.t(e.text), "element": e.element, **fields, "rewritten_from": self.t(target.rewritten_from), "unwrap_failed": target.failed}

    def mention(self, stage: int, unit: int, m: Mention, **source) -> dict:
        return {
            "stage": stage, "unit": unit, "match": m.match, "fan": m.fan, "kind": m.kind, "value": self.t(m.value), "value_raw": self.t(m.raw), "subtype": m.subtype,
            "defanged": m.defanged, "host": self.t(m.host), **source,
        }

    def read(self, text: str, found: list[dict], stage: int, unit: int, **source) -> None:
        if self.late():
            self.flags.add("truncated")
            return
        if skips_a_run(text):
            self.flags.add("truncated")
        found += [self.mention(stage, unit, m, **source) for m in mentions(text)]

    def mentioned(self, p: Parsed, fields: list[tuple], events: list) -> list[dict]:
        """The mentions of a message: of its headers, its text, its HTML."""
        found: list[dict] = []
        text = p.parts[p.text_part].text if p.text_part is not None else None
        for unit, (_, _, name, i, v) in enumerate(fields):
            self.read(v, found, 0, unit, source_kind="header", header_name=self.t(name), header_index=i)
        if text:
            self.read(text.text, found, 1, 0, source_kind="body_text", part_index=p.text_part)
        for unit, e in enumerate(events):
            if e.kind == "text":
                self.read(e.text, found, 2, unit, source_kind="body_html", part_index=p.html_part)
            else:
                href = unwrap(e.href, self.config.unwrap_rules).href
                found += [self.mention(2, unit, m, source_kind="body_html", part_index=p.html_part) for m in url_mentions(href)]
        return found

    def part(self, p: Parsed, x: Part) -> dict:
        body = x.text.text if x.text and x.index in (p.text_part, p.html_part) else None
        return {
            "part_index": x.index, "content_type": self.t(x.content_type), "disposition": self.t(x.disposition), "filename": self.t(x.filename), "content_id": self.t(x.content_id), "size": x.size,
            "charset_declared": self.t(x.charset_declared), "charset_used": x.text.charset_used if x.text else None, "transfer_encoding": self.t(x.transfer_encoding),
            "is_container": x.container, "is_message": x.nested is not None, **dict(zip(("md5", "sha1", "sha256"), x.digests or (None,) * 3, strict=True)), "detected_mime": x.detected,
            "text": self.t(body), "payload": x.payload if self.config.keep_payloads else None,
        }

    def message(self, p: Parsed) -> dict:
        """What is wanted of a message; what is not is not worked out."""
        wants = self.fields.__contains__
        names: dict[str, list[tuple[int, str]]] = {}
        for n, f in enumerate(p.block.fields):
            names.setdefault(f.name, []).append((n, f.value))
        fields = [(n, k, name, i, v) for k, (name, values) in enumerate(names.items()) for i, (n, v) in enumerate(values)]
        html = p.parts[p.html_part].text if p.html_part is not None and not self.fields.isdisjoint(("events", "text_from_html", "mentions")) else None
        events, shown = read_html(html.text) if html else ([], None)
        keep = self.config.keep_payloads
        out = {"message_index": p.index, "depth": p.depth, "text_part_index": p.text_part, "html_part_index": p.html_part}
        if wants("eml") and keep:
            out["eml"] = p.raw
        if wants("header_block") and keep:
            out["header_block"] = p.raw[: min((k for k in (p.raw.find(b"\r\n\r\n"), p.raw[: header_end(p.raw)].find(b"\n\n"), header_end(p.raw)) if k >= 0))]
        if wants("text_from_html"):
            out["text_from_html"] = self.t(shown)
        if wants("headers"):
            out["headers"] = [{"field_ordinal": n, "name_ordinal": k, "name": self.t(name), "header_index": i, "value": self.t(v)} for n, k, name, i, v in sorted(fields)]
        if wants("addresses"):
            out["addresses"] = [{"ordinal": n, "header": a.name, **{k: self.t(getattr(a, k)) for k in ("display_name", "address", "local_part", "domain")}} for n, a in enumerate(p.block.addresses)]
        if wants("received"):
            out["received"] = [{"ordinal": n, **{k.rstrip("_"): self.t(x) for k, x in received_hop(v)._asdict().items()}} for n, (_, v) in enumerate(names.get("received", ()))]
        if wants("auth"):
            claims = (a for _, v in names.get("authentication-results", ()) for a in auth_results(v))
            out["auth"] = [{"ordinal": n, "method": self.t(a.method), "result": self.t(a.result), "params": [(self.t(k), self.t(v)) for k, v in a.params.items()]} for n, a in enumerate(claims)]
        if wants("parts"):
            out["parts"] = [self.part(p, x) for x in p.parts]
        if wants("events"):
            out["events"] = [e for e in (self.event(n, e) for n, e in enumerate(events)) if e]
        if wants("mentions"):
            out["mentions"] = self.mentioned(p, fields, events)
        return out


#: What needs the header block read. The flags are those of what was read.
_OF_HEADERS = frozenset(("headers", "addresses", "received", "auth", "mentions"))


def _failed(code: str, message: str) -> dict:
    return {"ok": False, "error": {"code": code, "message": message}, "flags": [], "messages": []}


def dissect_bytes(raw: bytes | None, config: EngineConfig, fields: Sequence[str] = FIELDS, clock: Callable[[], float] = time.monotonic) -> dict:
    """The nested row of one input."""
    if raw is None or len(raw) > config.max_message_bytes:
        return _failed(TOO_LARGE, "the message is larger than the limit")
    if not is_message(raw):
        return _failed("UNPARSABLE", "no header field before the first empty line")
    end = clock() + config.max_input_millis / 1000
    late = (lambda: clock() >= end) if config.max_input_millis else lambda: False
    try:
        row = _Row(config, fields, late)
        found, flags = messages_of(raw, config.max_mime_parts, config.max_nesting_depth, config.max_attachment_bytes, not _OF_HEADERS.isdisjoint(fields), late)
        messages = [row.message(p) for p in found]
        flags |= row.flags
        return {"ok": True, "error": None, "flags": [f for f in FLAGS if f in flags], "messages": messages}
    except Exception as e:  # one hostile message must not end the job
        return _failed("INTERNAL", type(e).__name__)


def _source(raw: bytes | None) -> dict | None:
    if raw is None:
        return None
    return {"size": len(raw), **{name: getattr(hashlib, name)(raw).hexdigest() for name in ("md5", "sha1", "sha256")}}


def dissect(messages: DataFrame, config: EngineConfig = EngineConfig(), fields: Sequence[str] = FIELDS) -> DataFrame:
    """``messages(msg_key, content)`` -> one nested row each: :func:`row_schema`, with the
    ``fields`` wanted of each message. Flags speak of what was read for them: with all fields
    (the default) of everything."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = tuple(fields)
    if unknown := set(fields).difference(FIELDS):
        raise ValueError(f"no fields of a message: {', '.join(sorted(unknown))}")
    row = row_schema(fields)
    schema = to_arrow_schema(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for key, content in zip(batch.column(0), batch.column(1), strict=True):
                raw = content.as_py()
                rows.append({"msg_key": key.as_py(), "source": _source(raw), **dissect_bytes(raw, config, fields)})
                size += len(raw or b"")
                # A message may be as large as the limit: batches end by bytes.
                if size > BATCH_INPUT or len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return mapped(spread(messages.select("msg_key", "content")), run, row)


def _each(dissected: DataFrame, field: str) -> DataFrame:
    """(msg_key, message_index, the fields of each element)."""
    m = dissected.select("msg_key", F.explode("messages").alias("m"))
    return m.select("msg_key", "m.message_index", F.explode(f"m.{field}").alias("x")).select("msg_key", "message_index", "x.*")


def message_table(dissected: DataFrame) -> DataFrame:
    return dissected.select("msg_key", F.explode("messages").alias("m")).select("msg_key", "m.message_index", "m.depth", "m.text_part_index", "m.html_part_index")


def headers(dissected: DataFrame) -> DataFrame:
    return _each(dissected, "headers")


def addresses(dissected: DataFrame) -> DataFrame:
    return _each(dissected, "addresses")


def received(dissected: DataFrame) -> DataFrame:
    return _each(dissected, "received")


def auth(dissected: DataFrame) -> DataFrame:
    return _each(dissected, "auth")


def mime_parts(dissected: DataFrame) -> DataFrame:
    return _each(dissected, "parts")


def attachments(dissected: DataFrame) -> DataFrame:
    """Parts that hold no parts and are no body."""
    m = dissected.select("msg_key", F.explode("messages").alias("m"))
    held = F.explode(F.filter("m.parts", lambda p: is_attachment(F.col("m"), p)))
    parts = m.select("msg_key", "m.message_index", held.alias("x")).select("msg_key", "message_index", "x.*")
    return parts.withColumn("extension", extension(F.col("filename"))).withColumn("is_document", is_document(F.col("detected_mime")) | is_document(F.col("content_type")))


def body_texts(m: Column, config: EngineConfig) -> list[Column]:
    """The chosen bodies of a message struct; a text past the inline limit is null and its length stays."""
    kinds = {"text": text_of(m, m["text_part_index"]), "html": text_of(m, m["html_part_index"]), "text_from_html": m["text_from_html"]}
    inline = lambda c: F.when(F.octet_length(c) <= config.max_inline_body_bytes, c)
    return [*(inline(c).alias(k) for k, c in kinds.items()), *(F.octet_length(c).cast("long").alias(f"{k}_bytes") for k, c in kinds.items())]


def bodies(dissected: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    m = dissected.select("msg_key", F.explode("messages").alias("m"))
    return m.select("msg_key", "m.message_index", "m.text_part_index", "m.html_part_index", *body_texts(F.col("m"), config))


def bare_cid(content_id: Column) -> Column:
    return F.regexp_replace(F.trim(content_id), "^[<>]+|[<>]+$", "")


def cid_parts(dissected: DataFrame) -> DataFrame:
    """(msg_key, message_index, cid, cid_part): the first part of each Content-ID."""
    found = mime_parts(dissected).where("content_id is not null")
    return found.groupBy("msg_key", "message_index", bare_cid(F.col("content_id")).alias("cid")).agg(F.min("part_index").alias("cid_part"))


def _addressed(dissected: DataFrame, kind: str) -> DataFrame:
    e = _each(dissected, "events").where(F.col("kind") == kind).drop("kind")
    wanted = F.when(F.col("scheme") == "cid", bare_cid(F.col("path")))
    return e.withColumn("cid", wanted).join(cid_parts(dissected), ["msg_key", "message_index", "cid"], "left").drop("cid")


def links(dissected: DataFrame) -> DataFrame:
    """Anchors in order, with the part a ``cid:`` address means."""
    return _addressed(dissected, "anchor").drop("element")


def resources(dissected: DataFrame) -> DataFrame:
    return _addressed(dissected, "resource").drop("text")


def mention_table(dissected: DataFrame) -> DataFrame:
    """Mentions with one ordinal a message: (stage, unit, match, fan)."""
    d = _each(dissected, "mentions")
    return d.withColumn("ord", F.struct("stage", "unit", "match", "fan")).drop("stage", "unit", "match", "fan")


def is_attachment(message: Column, part: Column) -> Column:
    """A part that holds no parts and is no body."""
    body = part["part_index"].eqNullSafe(message["text_part_index"]) | part["part_index"].eqNullSafe(message["html_part_index"])
    return ~part["is_container"] & ~body


def text_of(message: Column, index: Column) -> Column:
    return F.get(F.filter(message["parts"], lambda p: p["part_index"] == index), F.lit(0))["text"]


def artifact_id(msg_key: Column, kind: Column, message_index: Column, part_index: Column) -> Column:
    key = F.concat_ws("/", msg_key, kind, message_index.cast("string"), F.coalesce(part_index.cast("string"), F.lit("-")))
    return F.substring(F.sha2(key, 256), 1, 22)


def own_artifacts(msg_key: Column, m: Column) -> Column:
    """The artifacts of a message struct, with their bytes: (kind, part_index, filename, data, artifact_id)."""
    none = F.lit(None).cast("int")
    index = m["message_index"]
    rows = [
        ("eml", none, F.format_string("message-%d.eml", index), m["eml"]),
        ("headers", none, F.format_string("headers-%d.txt", index), m["header_block"]),
        ("body_text", m["text_part_index"], F.format_string("%d-body.txt", index), F.encode(text_of(m, m["text_part_index"]), "UTF-8")),
        ("body_html", m["html_part_index"], F.format_string("%d-body.html", index), F.encode(text_of(m, m["html_part_index"]), "UTF-8")),
        ("body_text_from_html", m["html_part_index"], F.format_string("%d-body-from-html.txt", index), F.encode(m["text_from_html"], "UTF-8")),
    ]
    row = lambda kind, part, name, data: F.struct(kind.alias("kind"), part.alias("part_index"), name.alias("filename"), data.alias("data"), artifact_id(msg_key, kind, index, part).alias("artifact_id"))
    held = F.transform(
        F.filter(m["parts"], lambda p: is_attachment(m, p)),
        lambda p: row(F.lit("attachment"), p["part_index"], F.coalesce(p["filename"], F.format_string("part-%d.bin", p["part_index"])), p["payload"]),
    )
    every = F.concat(F.array(*(row(F.lit(kind), part, name, data) for kind, part, name, data in rows)), held)
    return F.filter(every, lambda a: a["data"].isNotNull())


def artifacts(dissected: DataFrame) -> DataFrame:
    """(msg_key, message_index, kind, part_index, filename, data, artifact_id, size, sha256)."""
    d = dissected.select("msg_key", F.explode("messages").alias("m"))
    d = d.select("msg_key", "m.message_index", F.explode(own_artifacts(F.col("msg_key"), F.col("m"))).alias("a")).select("msg_key", "message_index", "a.*")
    return d.withColumn("size", F.octet_length("data").cast("long")).withColumn("sha256", F.sha2("data", 256))


def artifact_status(created: Column, now: Column, ttl_seconds: int = 1_800) -> Column:
    """FOUND, EXPIRED, or UNKNOWN (a null creation time, as an outer join leaves it)."""
    return F.when(created.isNull(), "UNKNOWN").when(created + F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS") <= now, "EXPIRED").otherwise("FOUND")


def looked_up(wanted: DataFrame, stored: DataFrame, now: Column, ttl_seconds: int = 1_800) -> DataFrame:
    """``wanted(msg_key, artifact_id)`` with the status, name and bytes of what is stored
    (:func:`artifacts` with ``created_at``); bytes only of what is found."""
    d = wanted.select("msg_key", "artifact_id").join(stored.select("msg_key", "artifact_id", "kind", "filename", "data", "created_at"), ["msg_key", "artifact_id"], "left")
    d = d.withColumn("status", artifact_status(F.col("created_at"), now, ttl_seconds))
    # Bytes that are gone without having expired: nothing is known of them.
    d = d.withColumn("status", F.when((F.col("status") == "FOUND") & F.col("data").isNull(), "UNKNOWN").otherwise(F.col("status")))
    return d.withColumn("data", F.when(F.col("status") == "FOUND", F.col("data")))


def swept(stored: DataFrame, now: Column, ttl_seconds: int = 1_800) -> DataFrame:
    """What is kept of stored artifacts: all rows, the expired without their bytes."""
    return stored.withColumn("data", F.when(artifact_status(F.col("created_at"), now, ttl_seconds) == "FOUND", F.col("data")))


def source_digests(messages: DataFrame) -> DataFrame:
    return messages.select("msg_key", digests(F.col("content")).alias("d")).select("msg_key", "d.*")


def flag_table(dissected: DataFrame) -> DataFrame:
    return dissected.select("msg_key", F.posexplode("flags").alias("ordinal", "flag"))


def run_metrics(dissected: DataFrame) -> DataFrame:
    """One row of counts of a run: inputs, what failed, messages, parts, bytes, and inputs with each flag."""
    parts = F.aggregate("messages", F.lit(0).cast("long"), lambda n, m: n + F.size(m["parts"]))
    flagged = [F.sum(F.array_contains("flags", f).cast("long")).alias(f) for f in FLAGS]
    counts = [F.count("*").alias("inputs"), F.sum((~F.col("ok")).cast("long")).alias("failed"), F.sum(F.size("messages")).cast("long").alias("messages"), F.sum(parts).alias("parts")]
    return dissected.agg(*counts, F.sum("source.size").alias("bytes"), *flagged)


def observed(dissected: DataFrame, name: str = "dissect") -> tuple[DataFrame, Observation]:
    """The same rows, and what is counted as they go by: inputs, failures, messages. No content."""
    seen = Observation(name)
    counts = [F.count(F.lit(1)).alias("inputs"), F.sum((~F.col("ok")).cast("long")).alias("failed"), F.sum(F.size("messages")).alias("messages")]
    return dissected.observe(seen, *counts), seen
