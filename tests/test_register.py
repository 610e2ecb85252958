"""The functions under their SQL names."""

from millrace.functions.register import register
from millrace.sources.registries import load


def test_sql_names(spark):
    register(spark, load())
    r = spark.sql(
        """SELECT canonical_url('HTTP://A.example.ORG/X') AS u, canonical_host('BÜCHER.de.') AS h, ip_address('[2001:DB8::1]') AS ip, ip_address('x') AS none,
        decode_header('subject', '=?utf-8?q?=C3=A9?=') AS s, transfer_decode(encode('aGVsbG8=', 'UTF-8'), 'base64') AS b, charset_text(X'E9', 'utf-8') AS c, sniff_bytes(X'4D5A90') AS m,
        is_message(encode('A: b', 'UTF-8')) AS ok, text_from_html('<p>a<p>b') AS t, public_suffix('a.example.co.uk') AS p, is_file_extension('PDF') AS e, unwrap_href('x') AS w, public_suffix(NULL) AS n"""
    ).first()
    assert (r.u, r.h, r.ip, r.none, r.s, bytes(r.b), r.c, r.m) == ("http://a.example.org/X", "xn--bcher-kva.de", "2001:db8::1", None, "é", b"hello", "é", "application/vnd.microsoft.portable-executable")
    assert (r.ok, r.t, r.p, r.e, r.w, r.n) == (True, "a\nb", "co.uk", True, "x", None)
    rows = spark.sql("SELECT id, m.value FROM (SELECT 1 AS id, 'see a.example.org and 192.0.2.1' AS t UNION ALL SELECT 2, NULL) d, LATERAL mentions(t) m ORDER BY m.match").collect()
    assert [(x.id, x.value) for x in rows] == [(1, "a.example.org"), (1, "192.0.2.1")]
    assert [x.href for x in spark.sql("SELECT * FROM html_events('<a href=/x>y</a>') WHERE kind = 'anchor'").collect()] == ["/x"]
    assert spark.sql("SELECT from_ip FROM received_hop('from h (h [192.0.2.1]) by m')").first()[0] == "192.0.2.1"
