"""The row-local functions under SQL names: Arrow-batched functions, and table functions for
``LATERAL``. A null argument gives null, or no rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from millrace.config import EngineConfig
from millrace.functions import decoding, grammar, headers, html, mime, urls
from millrace.sources.registries import Registry

#: Fixed value: the names that :func:`register` makes.
NAMES = "canonical_url canonical_host ip_address unwrap_href decode_header transfer_decode charset_text sniff_bytes is_message text_from_html public_suffix is_file_extension".split()


class HtmlEvents:
    def eval(self, source: str):
        for n, e in enumerate(html.read_html(source)[0] if source is not None else ()):
            yield n, e.kind, e.href, e.text, e.element


class Mentions:
    def eval(self, text: str):
        for m in grammar.mentions(text) if text is not None else ():
            yield m.match, m.fan, m.kind, m.value, m.raw, m.subtype, m.defanged, m.host


class ReceivedHop:
    def eval(self, value: str):
        if value is not None:
            yield tuple(headers.received_hop(value))


def _batched(of: Callable, returns: str):
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else of(v))

    return pandas_udf(run, returns)


def _pairs(of: Callable, returns: str):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else of(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return pandas_udf(run, returns)


def register(spark: SparkSession, registry: Registry, config: EngineConfig = EngineConfig()) -> None:
    """Make the functions known to this session's SQL."""
    clean = lambda s: None if s is None else decoding.writable(s)[0]
    rules, suffix, known = config.unwrap_rules, registry.public_suffix, registry.extensions
    one = {
        "canonical_url": (urls.canonical_url, "string"),
        "canonical_host": (lambda h: urls.canonical_host(h)[0], "string"),
        "ip_address": (lambda t: (urls.ip_of(t) or (None,))[0], "string"),
        "unwrap_href": (lambda h: urls.unwrap(h, rules).href, "string"),
        "sniff_bytes": (lambda b: mime.sniff(bytes(b)), "string"),
        "is_message": (lambda b: mime.is_message(bytes(b)), "boolean"),
        "text_from_html": (lambda h: clean(html.read_html(h)[1]), "string"),
        "public_suffix": (suffix, "string"),
        "is_file_extension": (lambda e: e.lower().lstrip(".") in known, "boolean"),
    }
    two = {
        "decode_header": (lambda name, value: clean(headers.decoded(name, value)[0]), "string"),
        "transfer_decode": (lambda b, how: decoding.transfer_decode(bytes(b), how)[0], "binary"),
        "charset_text": (lambda b, declared: decoding.charset_decode(bytes(b), declared).text, "string"),
    }
    for name, (of, returns) in one.items():
        spark.udf.register(name, _batched(of, returns))
    for name, (of, returns) in two.items():
        spark.udf.register(name, _pairs(of, returns))
    tables = {
        "html_events": (HtmlEvents, "ordinal int, kind string, href string, text string, element string"),
        "mentions": (Mentions, "`match` int, fan int, kind string, value string, value_raw string, subtype string, defanged boolean, host string"),
        "received_hop": (ReceivedHop, "from_host string, from_ip string, by_host string, `with` string, id string, `for` string, `timestamp` string"),
    }
    for name, (of, returns) in tables.items():
        spark.udtf.register(name, udtf(of, returnType=returns))
