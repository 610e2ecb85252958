"""Decoding, HTML, URLs, unwrapping, headers, MIME."""

import base64
import random
import time

import pytest

from millrace.config import EngineConfig, extensions
from millrace.functions import decoding, headers, html, mime, urls


@pytest.mark.parametrize(
    "payload, how, data, damaged",
    [
        (b"plain", None, b"plain", False), (b"aGVsbG8=\r\n", "base64", b"hello", False), (b"a=3Db", "quoted-printable", b"a=b", False), (b"", "base64", b"", False),
        (b"QUJDR", "base64", None, True), (b"raw", "x-unknown", b"raw", True), (b"aGVs*bG8=", "BASE64", b"hello", True),
    ],
)
def test_transfer(payload, how, data, damaged):
    assert decoding.transfer_decode(payload, how) == (data, damaged)


@pytest.mark.parametrize(
    "data, declared, is_html, expected",
    [
        (b"plain", None, False, ("plain", "utf-8", False)),
        ("zażółć".encode("iso-8859-2"), "iso-8859-2", False, ("zażółć", "iso8859-2", False)),
        ("zażółć".encode("iso-8859-2"), "utf-8", False, ("za¿ó³æ", "cp1252", True)),
        (b"plain", "x-nonsense", False, ("plain", "utf-8", True)),
        (b"plain", "rot13", False, ("plain", "utf-8", True)),
        (bytes(range(256)), "utf-8", False, (bytes(range(256)).decode("latin-1"), "iso8859-1", True)),
        (b'<meta charset="iso-8859-2">\xbf', None, True, ('<meta charset="iso-8859-2">ż', "iso8859-2", False)),
        (b"\xef\xbb\xbfx", "utf-8", False, ("x", "utf-8-sig", True)),
    ],
)
def test_charsets(data, declared, is_html, expected):
    assert tuple(decoding.charset_decode(data, declared, is_html)) == expected


def test_writable():
    assert decoding.writable("é") == ("é", False)
    assert decoding.writable("\udcc3\udca9") == ("é", False)
    assert decoding.writable("a\udcff") == ("a\ufffd", True)
    assert decoding.writable("\ud800") == ("?", True)


def test_html_text_and_events():
    assert html.read_html("<div>Hello <b>world</b></div><p>Second&nbsp;line</p>")[1] == "Hello world\n\nSecond line"
    events, text = html.read_html('<a href="/x">l <img src=a srcset="b 1x, c 2x"></a><style>@import "e"; x{background:url( f )}</style><script>no</script><area href=g>')
    assert [(e.kind, e.href, e.element) for e in events if e.kind != "text"] == [
        ("resource", "a", "img"), ("resource", "b", "img"), ("resource", "c", "img"), ("anchor", "/x", "a"), ("resource", "f", "style"), ("resource", "e", "style"), ("anchor", "g", "area"),
    ]
    assert text == "l"
    assert list(html.css_urls("url('a')URL(b)url(c d)url(")) == ["a", "b"]


def test_url_parts():
    p = urls.url_parts("https://bank.example@ZLY.host:8x/")
    assert (p.scheme, p.host, p.port, p.userinfo) == ("https", "zly.host", None, "bank.example")
    assert urls.url_parts("cid:logo")[:3] == ("cid:logo", "cid", None) and urls.url_parts("cid:logo").path == "logo"
    assert urls.url_parts("http://[bad").href == "http://[bad"
    assert urls.canonical_url("HTTP://A.example.ORG:80/X") == "http://a.example.org:80/X"


def test_unwrap():
    rules = (urls.UnwrapRule("wrap.example", "query:u"), urls.UnwrapRule("seg.example", "path_segment:1", "base64url"))
    inner = "https://target.example/x"
    once = "https://a.wrap.example/?u=https%3A%2F%2Ftarget.example%2Fx"
    twice = "https://seg.example/go/" + base64.urlsafe_b64encode(once.encode()).decode().rstrip("=")
    assert urls.unwrap(once, rules) == (inner, once, False)
    assert urls.unwrap(twice, rules) == (inner, twice, False)
    assert urls.unwrap("https://wrap.example/?v=1", rules) == ("https://wrap.example/?v=1", None, True)
    assert urls.unwrap("https://evilwrap.example/?u=x", rules).rewritten_from is None
    for bad in (("x.example", "header:u"), ("x.example", "path_segment:x"), ("", "query:u"), (".x", "query:u")):
        with pytest.raises(ValueError):
            urls.UnwrapRule(*bad)
    with pytest.raises(ValueError):
        urls.UnwrapRule("x", "query:u", "rot13")


def test_config():
    assert extensions("scr,hta,ps1") == ("hta", "ps1", "scr") and extensions(' .SCR , hta ') == ("hta", "scr") and extensions('["b","a"]') == ("a", "b")
    with pytest.raises(ValueError):
        extensions("a/b")
    with pytest.raises(ValueError):
        EngineConfig(max_links=-1)
    c = EngineConfig.from_conf({"spark.millrace.max_links": "7", "spark.millrace.unwrap_rules": '[{"host_suffix": "x.example", "source": "query:u"}]'}.get)
    assert c.max_links == 7 and c.unwrap_rules[0].decoder == "none"


def test_hops_and_results():
    h = headers.received_hop("from mail.example.com (x [192.0.2.1]) by mx.example.org with ESMTP id 12; Mon")
    assert (h.from_host, h.from_ip, h.by_host, h.with_, h.id, h.for_, h.timestamp) == ("mail.example.com", "192.0.2.1", "mx.example.org", "ESMTP", "12", None, "Mon")
    assert headers.received_hop("from [192.0.2.7] by x")[:2] == (None, "192.0.2.7")
    found = headers.auth_results('mx; spf=Pass smtp.mailfrom=a; dkim=fail x="y z" x=2; junk')
    assert [(a.method, a.result, a.params) for a in found] == [("spf", "pass", {"smtp.mailfrom": "a"}), ("dkim", "fail", {"x": "2"})]
    for hostile in ("from a (" * 20_000, "a" * 60_000, ";" * 60_000):
        began = time.time()
        headers.received_hop(hostile), headers.auth_results("x;" + hostile)
        assert time.time() - began < 3


def message(*heads, body=b"x"):
    return "\r\n".join(heads).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + body


def test_addresses():
    b = headers.read_block(b'From: =?utf-8?q?Jan_=C5=BB?= <jan@example.com>\r\nTo: "Doe, J" <j@x.org>, "Bob <bob@example.net>"\r\nCc: nobody at all')
    assert [(a.name, a.display_name, a.address) for a in b.addresses][:3] == [("from", "Jan Ż", "jan@example.com"), ("to", "Doe, J", "j@x.org"), ("to", "Bob", "bob@example.net")]
    long = headers.read_block(b"To: " + b"a@b.c, " * 2000)
    assert long.flags == {"truncated"} and long.addresses[0].address is None
    assert headers.read_block(b"Subject: \xff").flags == {"encoding_fallback"}


@pytest.mark.parametrize(
    "head, name, fell_back",
    [
        ('Content-Disposition: attachment; filename="a;b.pdf"', "a;b.pdf", False),
        ("Content-Type: text/plain; name=n.txt", "n.txt", False),
        ("Content-Disposition: attachment; filename=plain.txt; filename*=utf-8''%C3%A9.txt", "é.txt", False),
        ("Content-Disposition: attachment; filename=plain.txt; filename*=x-none''%E9.txt", "plain.txt", True),
        ("Content-Disposition: attachment; filename*0=a; filename*1=b.txt", "ab.txt", False),
        ("Content-Disposition: attachment; filename==?utf-8?q?=C3=A9=2Etxt?=", "é.txt", False),
        ("Content-Disposition: attachment", None, False),
    ],
)
def test_part_names(head, name, fell_back):
    assert headers.part_name(mime._parse(message(head))) == (name, fell_back)


MIXED = message(
    "Subject: a\r\n b", "Content-Type: multipart/mixed; boundary=BB",
    body=b"pre\r\n--BB\r\nContent-Type: text/plain; charset=iso-8859-2\r\n\r\nza\xbf\r\n--BBX\r\n--BB\r\nContent-Type: text/html\r\n\r\n<p>x</p>\r\n--BB  \r\n"
    b"Content-Type: image/png\r\nContent-Transfer-Encoding: base64\r\n\r\n" + base64.b64encode(b"%PDF-1") + b"\r\n--BB\r\nContent-Type: message/rfc822\r\n\r\nSubject: in\r\n\r\nbody\r\n--BB--\r\n",
)


def test_tree():
    found, flags = mime.messages_of(MIXED, 500, 5, 10**6)
    assert flags == set() and [(m.index, m.depth) for m in found] == [(0, 0), (1, 1)]
    parts = found[0].parts
    assert [p.content_type for p in parts] == ["multipart/mixed", "text/plain", "text/html", "image/png", "message/rfc822"]
    assert parts[1].text.text == "zaż\r\n--BBX" and parts[3].detected == "application/pdf" and parts[4].payload == b"Subject: in\r\n\r\nbody"
    assert (found[0].text_part, found[0].html_part) == (1, 2) and found[0].block.fields[0] == ("subject", "a b")


def test_tree_damage_and_limits():
    assert "malformed_mime" in mime.messages_of(MIXED.replace(b"--BB--\r\n", b""), 500, 5, 10**6)[1]
    found, flags = mime.messages_of(MIXED, 3, 5, 10**6)
    assert flags == {"truncated"} and sum(len(m.parts) for m in found) <= 3
    assert mime.messages_of(MIXED, 500, 0, 10**6)[1] == {"truncated"}
    big, flags = mime.messages_of(MIXED, 500, 5, 4)
    assert "truncated" in flags and big[0].parts[3].payload is None and big[0].parts[3].digests
    assert mime.messages_of(message("Content-Type: a/b", "Content-Transfer-Encoding: base64", body=b"QUJDR"), 500, 5, 10)[1] == {"attachment_unreadable"}
    inner = base64.b64encode(b"Subject: in\r\n\r\nbody")
    coded = mime.messages_of(message("Content-Type: message/rfc822", "Content-Transfer-Encoding: base64", body=inner), 500, 5, 10**6)[0]
    assert [m.depth for m in coded] == [0, 1] and coded[1].raw == b"Subject: in\r\n\r\nbody"


def test_many_parts_are_cut_before_the_parse():
    raw = message("Content-Type: multipart/mixed; boundary=B", body=b"--B\r\n\r\nx\r\n" * 100_000)
    began = time.time()
    found, flags = mime.messages_of(raw, 50, 5, 10**6)
    assert time.time() - began < 3 and len(found[0].parts) <= 50 and flags == {"truncated"}


def test_gate_and_forms():
    assert mime.is_message(b"A: b\n\nx") and not mime.is_message(b"\n\nA: b") and mime.is_message(b"From x\nA: b\n") and not mime.is_message(b"no")
    body = b'--Z\r\nContent-Disposition: form-data; name="other"\r\n\r\n1\r\n--Z\r\nContent-Disposition: form-data; name="eml"\r\n\r\nA: b\r\n\r\nx\r\n\r\n--Z--\r\n'
    assert mime.form_field(body, 'multipart/form-data; boundary="Z"') == b"A: b\r\n\r\nx\r\n" and mime.form_field(body, "text/plain") is None


def test_mutations_never_raise():
    from millrace.operators.dissect import dissect_bytes

    for seed in (1, 7, 42, 1337):
        rng = random.Random(seed)
        for _ in range(40):
            raw = bytearray(MIXED)
            for _ in range(rng.randint(1, 6)):
                at = rng.randrange(len(raw))
                how = rng.randrange(5)
                if how == 0:
                    raw[at] = rng.randrange(256)
                elif how == 1:
                    del raw[at : at + rng.randrange(60)]
                elif how == 2:
                    raw[at:at] = bytes(rng.randrange(256) for _ in range(5))
                elif how == 3:
                    raw[at:at] = raw[at : at + 80]
                else:
                    raw[at:at] = rng.choice([b"\r\n", b"\n", b"--BB\r\n", b"--BB--\r\n", b"=?x?q?", b"\xff\xfe"])
            row = dissect_bytes(bytes(raw), EngineConfig())
            assert row["ok"] or row["error"]["code"] in ("UNPARSABLE", "TOO_LARGE"), row["error"]


@pytest.mark.parametrize("unit", ["<", "<br", "<p ", "<td", "<!--", "<!-->", "<script>", "<style", "<!--<style>", "&amp", " \n", "\t", ">"])
def test_tags_are_removed_in_linear_time(unit):
    began = time.time()
    for end in ("", ">", "<br>", "-->"):
        html.tags_removed(unit * (300_000 // len(unit)) + end)
    assert time.time() - began < 5
