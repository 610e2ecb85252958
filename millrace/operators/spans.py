"""Row-local functions over a table's column, as relations: HTML events and texts, URLs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions.decoding import writable
from millrace.functions.grammar import plain_addresses
from millrace.functions.html import read_html, tags_removed
from millrace.functions.urls import UnwrapRule, unwrap, url_parts
from millrace.workspace import mapped

FLUSH = 20_000


def exploded(df: DataFrame, key: str, column: str, fields: str, rows_of: Callable[[str], Iterator[tuple]]) -> DataFrame:
    """(key, fields) of every row that ``rows_of`` makes of a text; null gives none."""
    from pyspark.sql.pandas.types import to_arrow_schema

    made = StructType.fromDDL(fields)
    schema = StructType([*df.select(key).schema.fields, *made.fields])
    types = [f.type for f in to_arrow_schema(made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[int] = []
            cols: list[list] = [[] for _ in types]
            for k, text in enumerate(batch.column(1)):
                if text.is_valid:
                    for row in rows_of(text.as_py()):
                        keys.append(k)
                        for c, v in zip(cols, row, strict=True):
                            c.append(v)
                if len(keys) >= FLUSH or k == batch.num_rows - 1 and keys:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys)), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=schema.names)
                    keys, cols = [], [[] for _ in types]

    return mapped(df.select(F.col(key), F.col(column).alias(f"_{column}")), run, schema)


def _t(text: str | None) -> str | None:
    return None if text is None else writable(text)[0]


def html_events(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, ordinal, kind, href, text, element) in document order."""
    return exploded(df, key, html, "ordinal int, kind string, href string, text string, element string", lambda h: ((n, e.kind, _t(e.href), _t(e.text), e.element) for n, e in enumerate(read_html(h)[0])))


def html_texts(df: DataFrame, key: str, html: str) -> DataFrame:
    return exploded(df, key, html, "text string", lambda h: ((_t(read_html(h)[1]),),))


def plain_texts(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, text) of every row by plain replacements; null gives an empty text."""
    d = df.select(F.col(key), F.coalesce(F.col(html), F.lit("")).alias(html))
    return exploded(d, key, html, "text string", lambda h: ((tags_removed(h),),))


def address_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, value, occurrences) of the plain addresses of each key's texts, as they are written."""
    found = exploded(df, key, text, "value string, occurrences long", lambda t: Counter(plain_addresses(t)).items())
    return found.groupBy(key, "value").agg(F.sum("occurrences").alias("occurrences"))


def url_table(df: DataFrame, key: str, href: str) -> DataFrame:
    """(key, href, scheme, host, port, userinfo, path, query, fragment, host_idn, host_punycode)."""
    fields = "href string, scheme string, host string, port int, userinfo string, path string, query string, fragment string, host_idn string, host_punycode string"
    return exploded(df, key, href, fields, lambda u: (tuple(_t(x) if isinstance(x, str) else x for x in url_parts(u)),))


def unwrapped(df: DataFrame, key: str, href: str, rules: Sequence[UnwrapRule]) -> DataFrame:
    """(key, target, rewritten_from, failed)."""
    rules = tuple(rules)
    return exploded(df, key, href, "target string, rewritten_from string, failed boolean", lambda u: (tuple(unwrap(u, rules)),))
