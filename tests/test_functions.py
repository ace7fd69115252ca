"""Functions on literal pairs: what each should give, stated by hand."""

import hashlib
import hmac
import ipaddress
import json
import random
import re
import time
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.functions import addresses, dates, evidence, fields, keys, text, web


def values(spark, build, inputs, kind="string"):
    """``build`` of each input, in order."""
    rows = spark.createDataFrame(list(enumerate(inputs)), f"i int, x {kind}")
    return [r.y for r in rows.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


PAIRS = {
    text.stem: [("sklepami", "sklep"), ("sklepowego", "sklep"), ("krajowej", "kraj"), ("panowie", "panow"), ("domow", "domow"), ("umowa", "umow"), ("stores", "store"), ("cafes", "cafes"), ("bus", "bus"), ("oferty", "ofert"), ("mody", "mody")],
    text.query_normalize: [("a  a A. b", "a b"), ('"New York" "new york" hotels', '"New York" hotels'), ("x - - y", "x - y"), ("x . , y", "x . , y"), ("fee fees fee", "fee fees fee"), ("", "")],
    text.site_domains: [("site:Example.COM. fees site:b.pl site:example.com", ["example.com", "b.pl"]), ("website:x.pl", []), ("", [])],
    text.routing_tokens: [("Franczyza Żabka, KOSZTY koszty fee 2024 About", ["koszty", "2024"]), ("", [])],
    web.canonical_url: [
        ("HTTPS://User.Example.COM:443/a?utm_source=x&b=1&TRK=2#f", "https://user.example.com/a?b=1"), ("http://a.com:8080", "http://a.com:8080/"), ("http://a.com/x).", "http://a.com/x"), ("http://a.com/x_(y).", "http://a.com/x_(y)"), ('"http://a.com/x",', 'http://a.com/x"'),
        ("ftp://a.com", None), ("http://u:p@a.com/", None), ("http://localhost/", None), ("http://x.local/", None), ("http://intranet/", None), ("http://10.0.0.1/", None), ("http://172.20.1.1/", None), ("http://172.32.1.1/", "http://172.32.1.1/"),
        ("http://100.64.0.9/", None), ("http://8.8.8.8/", "http://8.8.8.8/"), ("http://a.com./?ref=1", "http://a.com/?ref=1"), (None, None),
    ],
    web.registrable: [("www.shop.com.pl", "shop.com.pl"), ("a.b.co.nz", "b.co.nz"), ("x.com.au", "x.com.au"), ("deep.a.example.com", "example.com"), ("www.example.com", "example.com"), ("com.tr", "com.tr"), ("localhost", "localhost")],
    web.anti_bot: [
        ("<title>Just a moment...</title>", True), ("<p>served by cloudflare</p>", False), ("<p>Cloudflare Ray ID: 7</p>", True), ("<p>" + "word " * 5000 + "captcha</p>", False), ("<title>Shop</title>" + "x" * 17000 + "captcha", False), (None, False),
    ],
    web.url_problem: [("", "empty"), ("http://a/" + "x" * 4000, "too_long"), ("ftp://a.b", "scheme"), ("http://u@a.b", "credentials"), ("http://intranet/x", "local_host"), ("http://127.0.0.1/", "numeric_host"), ("http://a.b:8080/", "port"), ("https://a.b:443/", None)],
    fields.is_unit_format: [("Master  Franchise", True), ("przejęcie istniejącego sklepu", True), ("jednego sklepu", True), ("three shops", False)],
    fields.transient_code: [("request failed (APITimeoutError)", "timeout"), ("request failed (BadRequestError) with timeout", None), ('{"error_code": "rate_limit"}', "rate_limit"), ("fine", None), ("request failed (RateLimitError)" + "x" * 100_000, None)],
    fields.inherited_note: [("a", fields.INHERITED + "a"), (fields.INHERITED * 3 + "a", fields.INHERITED + "a"), ("b" * 2000, (fields.INHERITED + "b" * 2000)[:1000])],
    fields.first_object: [('say {"a": {"b": 1}} {"c": 2}', '{"a": {"b": 1}}'), ("{x {}", "{}"), ("none", None), (None, None)],
    lambda x: fields.currency(x, F.lit("5 zł")): [("EUR", "EUR"), ("EUR or USD", "PLN"), ("Euro", "EUR"), ("50 £", "GBP"), ("dolary", "USD"), ("$", "PLN"), (None, "PLN"), ("europe", "EUR"), ("cheap", "PLN")],
    lambda x: dates.lenient_iso(x).cast("timestamp_ntz").cast("string"): [("2024-02-03T04:05:06Z", "2024-02-03 04:05:06"), ("2024-02-03T04:05:06+02:00", "2024-02-03 02:05:06"), ("2024-02-03 04:05:06", "2024-02-03 04:05:06"), ("soon", None), (None, None)],
}


@pytest.mark.parametrize("build", list(PAIRS))
def test_pairs(spark, build):
    given, want = zip(*PAIRS[build], strict=True)
    assert values(spark, build, given) == list(want)


def test_keyed_hashes_and_ids_equal_the_standard_library(spark):
    space = uuid.uuid4()
    names = ["10.0.0.1", "", "żółć", "x" * 300]
    for secret in (b"k", b"long" * 40):
        want = [hmac.new(secret, n.encode(), hashlib.sha256).hexdigest() if n else "" for n in names]
        assert values(spark, lambda c, secret=secret: keys.hmac_sha256(secret, c), names) == want
    assert values(spark, lambda c: keys.uuid5(space, c), names) == [str(uuid.uuid5(space, n)) for n in names]
    assert values(spark, keys.first_hop, [" 1.2.3.4 , 5.6.7.8", "9.9.9.9", ""]) == ["1.2.3.4", "9.9.9.9", ""]


def test_epoch_seconds(spark):
    rows = spark.createDataFrame([(0,), (None,), (1_700_000_000,)], "x long")
    assert [str(r.y) for r in rows.select(dates.from_epoch(F.col("x")).cast("timestamp_ntz").alias("y")).collect()] == ["None", "None", "2023-11-14 22:13:20"]


def test_passages_keep_blocks_and_add_windows():
    source = "Label\n\nValue one\n\nmenu\n\nafter\n\n" + "long " * 60 + "\n\nlast\fnext page\n\n\n\nend"
    got = [source[a:b] for a, b in evidence.split_passages(source)]
    assert "Label" in got and "Value one" in got and "Label\n\nValue one" in got  # blocks stay beside their window
    assert "menu" in got and not any("menu" in p and p != "menu" for p in got)  # notices are in no window
    assert ("long " * 60).strip() in got and "after" in got and "last" in got
    assert "next page\n\n\n\nend" in got and not any("last" in p and "next" in p for p in got)  # windows stay on their page
    assert evidence.split_passages("") == evidence.split_passages(" \n\n\f ") == []


def test_long_blocks_break_in_their_second_half():
    source = "a" * 40 + ". " + "b" * 50 + "\n" + "c" * 300
    got = [source[a:b] for a, b in evidence.split_passages(source, most=100, context=0, short=0)]
    assert got[0] == "a" * 40 + ". " + "b" * 50 and got[1] == "c" * 99 and "".join(got[1:]) == "c" * 300
    early = "a" * 10 + ". " + "b" * 200
    assert [early[a:b] for a, b in evidence.split_passages(early, most=100, context=0, short=0)][0] == early[:100]


def test_windows_hold_short_neighbours_up_to_the_limit():
    rng = random.Random(1)
    source = "\n\n".join("w" * rng.randint(1, 250) for _ in range(200))
    got = evidence.split_passages(source)
    blocks = [b for b in source.split("\n\n")]
    assert {source[a:b] for a, b in got} >= set(blocks)
    windows = [source[a:b] for a, b in got if "\n\n" in source[a:b]]
    assert windows and all(len(w) <= 600 and all(len(x) <= 200 for x in w.split("\n\n")) for w in windows)


def _fitting(pages, terms, most):
    """What a loop over the pages in order would take."""
    full = [(i, p.strip()) for i, p in enumerate(pages) if p.strip()]
    points = [len(set(terms) & set(re.findall(r"[^\W_]+", p.lower()))) for _, p in full]
    n, k = len(full), min(20, len(full))
    even = {round(j * (n - 1) / max(k - 1, 1)) for j in range(k)}
    tier = lambda j: 0 if points[j] else 1 if j == 0 else 2 if j in even else 3
    kept, used, cut = [], 0, False
    for j in sorted(range(n), key=lambda j: (tier(j), -points[j] if tier(j) == 0 else 0, j)):
        page, text = full[j]
        room = most - used - len(f"[PDF page {page + 1}]\n") - (3 if kept else 0)
        if room >= 10 and used < most:
            cut |= len(text) > room
            kept.append(page + 1)
            used = most - room + len(text[:room].rstrip())
    return sorted(kept), used, cut or len(kept) < n


def test_pages_that_fit_equal_the_walk(spark):
    rng = random.Random(4)
    rows = [([rng.choice(["", " ", "fees", "x y " * rng.randint(1, 40), "royalty fees " * rng.randint(1, 9)]) for _ in range(rng.choice([0, 1, 5, 60]))],) for _ in range(80)]
    rows += [(["intro", "fees and royalty", " ", "x" * 500],)]
    frame = spark.createDataFrame(rows, "pages array<string>")
    for most in (0, 100, 700, 100_000):
        got = frame.select("pages", evidence.pages_that_fit(F.col("pages"), ["royalty", "fees"], most).alias("p")).collect()
        for r in got:
            assert (r.p.pages, r.p.chars, r.p.truncated) == _fitting(r.pages, ["royalty", "fees"], most)
    assert evidence.locator("a\fb", 2, 3) == "page:0002" and evidence.locator("ab", 1, 2) == "chars:1-2"


def test_pages_are_looked_through_once(spark):
    pages = ["a fees-b", "feest", "x1fees", "Fées", "royalty\nFEES fees", "fees", "é royalty", "royaltyé", "\x0b fees1 \t", "straße łan"]
    frame = spark.createDataFrame([(pages,), ([],), (None,)], "pages array<string>")
    ranked = frame.select(evidence.ranked_pages(F.col("pages"), ["royalty", "fees", "fees", "Fees", "fees-b", "strasse", "lan", ""]).alias("r")).collect()
    points = {p["page"]: -p["points"] for p in ranked[0].r}
    assert points == {0: 1, 1: 0, 2: 0, 3: 1, 4: 2, 5: 1, 6: 1, 7: 0, 8: 0, 9: 2} and ranked[1].r == [] and ranked[2].r is None
    assert {p["page"]: p["size"] for p in ranked[0].r}[8] == 5
    plan = frame.select(evidence.pages_that_fit(F.col("pages"), ["royalty", "fees"], 100).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("translate(") == 1


def test_page_parts():
    parts = web.page_parts
    assert parts("<p>a<p>b<br/>c &amp; d&nbsp;<b>e</b>") == ("", "a\nb\nc & d\xa0e", [])
    assert parts("<title> A &lt;b> \n c</title><div>x</div><svg><p>no<svg></svg>no</svg>yes") == ("A <b> c", "x\n\nyes", [])[:1] + ("x\nyes", [])
    assert parts('<a title="1 > 0" href=\'x>y\'>in</a> 1 < 2 <3') == ("", "in 1 < 2 <3", [])
    assert parts("a<!-- <p> -->b<!doctype html>c<?x y?>d") == ("", "abcd", [])
    assert parts("<noscript>n<p>m</noscript>a<template>b") == ("", "a", [])  # never closed: hides the rest
    assert parts("</svg></p>a</div></div>") == ("", "a", [])
    assert parts("<SCRIPT>var a = '</p><b>' </script x>t<style>p{}") == ("", "t", [])
    data = '<script type="application/LD+json">{"name": "<b>"}</script><script id=__NEXT_DATA__>[1]</script><script>no</script><script type="application/json"></script>'
    assert parts(data) == ("", "", ['{"name": "<b>"}', "[1]"])
    assert parts("a <b title=\"never closed") == ("", 'a <b title="never closed', []) and parts("a<!-- b") == ("", "a<!-- b", [])
    assert parts("l1\r\n\r\n\r\n  l2\t x \r l3") == ("", "l1\n\nl2 x\nl3", []) and parts("") == ("", "", [])


@pytest.mark.parametrize("piece", ["<p>word ", '<a b="', "<", "<!--", "<svg>", "</p", "<title>", "&amp;"])
def test_pages_of_ten_megabytes_take_linear_time(piece):
    def seconds(n):
        began = time.process_time()
        web.page_parts(piece * (n // len(piece)))
        return time.process_time() - began

    seconds(100_000)
    small, large = max(seconds(1_000_000), 0.02), seconds(10_000_000)
    assert large < 40 * small


def test_only_listed_references_are_read_where_a_list_is_given():
    some = web.listed_references(("&lt;", "<"), ("&amp;", "&"))
    assert web.page_parts("<title>a &amp; &quot;b&amp</title>c &lt;d&amp &eacute;", some, web.listed_references(("&amp;", "&"))) == ("a & &quot;b&amp", "c <d&amp &eacute;", [])
    assert web.page_parts("<title>&quot;&amp</title>&eacute;") == ('"&', "é", [])


def test_a_long_query_takes_linear_time(spark):
    rows = spark.createDataFrame([("a b " * 20_000,), ('"x y" ' * 9,), (None,)], "q string")
    began = time.time()
    found = [r.q for r in rows.select(text.query_normalize(F.col("q")).alias("q")).collect()]
    assert found == [("a b " * 20_000).strip(), '"x y"', None] and time.time() - began < 30


def test_page_content_takes_nulls(spark):
    rows = spark.createDataFrame([("<p>a",), (None,)], "html string").select(web.page_content("html").alias("p")).select("p.*").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([("", "a", []), (None, None, None)], key=str)


def test_embedded_json_text():
    blocks = ['{"name": " A  b ", "price": "9", "Price-Currency": "PLN", "x": "hidden", "list": [{"title": "TT"}, "no key"]}', "{broken", '{"text": "a => b", "label": "A b", "url": "x", "name": "' + "y" * 1001 + '"}']
    assert web.public_text(blocks) == "A b\nPLN\nTT"
    assert web.public_text(['["a"]', '{"name": ["one", "two"]}']) == "one\ntwo"
    assert len(web.public_text(['{"name": ["' + '", "'.join(f"item{i}" for i in range(3000)) + '"]}']).split("\n")) == 500
    assert web.public_text([None]) == ""


def test_embedded_text_of_a_page_is_whole(spark):
    names = [f"item{i}" for i in range(30_000)]
    blocks = [json.dumps({"name": names}), json.dumps([{"x": i, "url": "u" * 3000, "title": f"t{i}"} for i in range(3000)])]
    found = spark.createDataFrame([(blocks,), (None,)], "b array<string>").select(web.embedded_text("b").alias("t")).collect()
    assert [r.t for r in found] == ["\n".join([*names, "u" * 3000, *(f"t{i}" for i in range(3000))]), None]


def test_every_rule_of_typed_values(spark):
    good = {
        "task_id": "t", "target_field": "f", "claim_ids": ["a"], "canonical_text": "5", "unit": None, "notes": "", "value_type": "decimal", "precision": "exact",
        "number_min": "5", "number_max": None, "boolean_value": None, "date_value": None, "currency": None,
    }
    changes = [
        ({}, None), ({"task_id": " "}, "blank_task_id"), ({"target_field": ""}, "invalid_target_field"), ({"claim_ids": []}, "invalid_claim_group_size"), ({"claim_ids": ["a", "a"]}, "duplicate_claim_ids"),
        ({"canonical_text": ""}, "invalid_canonical_text"), ({"unit": "u" * 101}, "invalid_unit"), ({"notes": "n" * 1001}, "invalid_notes"), ({"number_min": "05"}, "invalid_numeric_format"), ({"number_max": "1."}, "invalid_numeric_format"),
        ({"currency": "pln"}, "invalid_currency"), ({"number_min": None}, "invalid_numeric_value"), ({"boolean_value": True}, "invalid_numeric_value"), ({"number_max": "4"}, "descending_numeric_range"),
        ({"value_type": "integer", "number_min": "5.5"}, "non_integral_integer"), ({"value_type": "integer", "number_min": "5.0"}, None), ({"value_type": "money"}, "missing_money_currency"), ({"value_type": "money", "currency": "PLN"}, None), ({"currency": "PLN"}, "unexpected_currency"),
        ({"number_max": "6"}, "invalid_range_precision"), ({"number_max": "6", "precision": "range"}, None), ({"precision": "range"}, "invalid_range_precision"), ({"number_max": "5", "precision": "range"}, "invalid_range_precision"),
        ({"value_type": "boolean", "number_min": None}, "invalid_boolean_value"), ({"value_type": "boolean", "number_min": None, "boolean_value": False}, None), ({"value_type": "boolean", "boolean_value": True}, "invalid_boolean_value"),
        ({"value_type": "date", "number_min": None, "date_value": "2024-02-30"}, "invalid_date_value"), ({"value_type": "date", "number_min": None, "date_value": "2024-02-29"}, None), ({"value_type": "date", "number_min": None}, "invalid_date_value"),
        ({"value_type": "text"}, "unexpected_typed_value"), ({"value_type": "text", "number_min": None}, None), ({"value_type": "url", "number_min": None}, "invalid_url_value"), ({"value_type": "url", "number_min": None, "canonical_text": "https://a.b/c"}, None),
        ({"value_type": "text", "number_min": None, "precision": "range"}, "invalid_range_precision"),
    ]
    ddl = "i int, task_id string, target_field string, claim_ids array<string>, canonical_text string, unit string, notes string, value_type string, precision string, number_min string, number_max string, boolean_value boolean, date_value string, currency string"
    rows = spark.createDataFrame([(i, *(good | c).values()) for i, (c, _) in enumerate(changes)], ddl)
    got = rows.select("i", fields.typed_issue({c: F.col(c) for c in good}).alias("y")).orderBy("i").collect()
    assert [r.y for r in got] == [code for _, code in changes]


def test_typed_columns_or_their_issue(spark):
    rows = [
        ("boolean", "Tak", None), ("boolean", "maybe", None), ("money", "1 234,50", "PLN"), ("money", "5", "EUR"), ("decimal", "x", None), ("integer", "7", None), ("integer", "7,5", None), ("url", "https://a.pl/x", None), ("url", "a.pl", None), ("text", " t ", None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, kind string, x string, c string")
    got = [r.y for r in df.select("i", fields.typed_column(F.col("kind"), F.col("x"), F.col("c")).alias("y")).orderBy("i").collect()]
    assert [g.issue for g in got] == [None, "invalid_boolean_value", None, "unsupported_currency", "invalid_profile_value", None, "non_integral_value", None, "invalid_profile_value", None]
    assert got[0].flag is True and float(got[2].number) == 1234.5 and got[5].whole == 7 and got[7].text == "https://a.pl/x" and got[9].text == "t"


def test_media_by_content_and_declaration(spark):
    rows = [
        ("%PDF-1.7", "text/html", "application/pdf", True), ("  <HTML>", None, "text/html", False), ("x <html>", "application/pdf", "text/html", True), ("hi", "application/pdf", None, True), ("hi", "text/html", "text/html", False),
        ("hi", "text/plain", "text/plain", False), ("hi", "image/png", None, False), ("just a moment", "application/pdf", "text/html", False), ("hi", "application/octet-stream", None, True), ("hi", None, None, False),
    ]
    df = spark.createDataFrame([(i, c, d) for i, (c, d, *_) in enumerate(rows)], "i int, c string, d string")
    got = [r.m for r in df.select("i", web.detected_media(F.col("c"), F.col("d"), F.lit("http://a.b/c.pdf")).alias("m")).orderBy("i").collect()]
    assert [(g.media, g.mismatch) for g in got] == [r[2:] for r in rows]


def test_reasons_against_public_texts(spark):
    rows = [
        ("brand.name", "McX ", None), ("brand.name", "Other", "brand_name_mismatch"), ("brand.name", "M", "invalid_brand_name_length"), ("websites.official", "https://a.b", None), ("websites.official", "a.b", "invalid_public_url"),
        ("x", " \n ", "invalid_public_text"), ("x", None, "invalid_public_text"), ("x", "a\rb c", "invalid_public_text"), ("x", "a | b", "uncompacted_public_text"), ("x", "a\nb\nc\nd\ne", "uncompacted_public_text"),
        ("x", "ab", "invalid_public_text_length"), ("x", "a" * 401, "invalid_public_text_length"), ("offer.unit_formats", "a" * 241, "invalid_public_text_length"), ("x", "One. Two! Three? Four.", "too_many_public_sentences"), ("x", "One. Two! Three?", None),
    ]
    df = spark.createDataFrame([(i, t, v) for i, (t, v, _) in enumerate(rows)], "i int, t string, v string")
    got = df.select("i", fields.public_text_issue(F.col("t"), F.col("v"), F.lit("MCX")).alias("y")).orderBy("i").collect()
    assert [r.y for r in got] == [r[2] for r in rows]


def _addresses():
    rng = random.Random(12)
    yield from ("1.2.3", "1.2.3.4.5", "01.2.3.4", "256.1.1.1", "1.2.3.-4", "", ":", "::", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "12345::", "g::", ":1::", "1::2:", "::1.2.3.4", "::ffff:1.2.3.256", "1.2.3.4::", "::1.2.3.4:5", "::ffff:0:1", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "FE80::A", " 1.2.3.4", "1.2.3.4 ", "::%1")
    for net in (*addresses.RESERVED, *addresses.PUBLIC):
        net = ipaddress.ip_network(net)
        first, last = int(net.network_address), int(net.broadcast_address)
        kind, top = (ipaddress.IPv4Address, 2**32) if net.version == 4 else (ipaddress.IPv6Address, 2**128)
        for n in (first - 1, first, last, last + 1, rng.randint(first, last)):
            if 0 <= n < top:
                yield str(kind(n))
    for _ in range(300):
        yield str(ipaddress.IPv4Address(rng.getrandbits(32)))
        six = ipaddress.IPv6Address(rng.getrandbits(128) & rng.choice([-1, ~(2**80 - 1), 2**64 - 1, 2**16 - 1, ~(0xFFFFFF << 40)]))
        yield rng.choice([str(six), six.exploded, str(six).upper()])
        yield f"::ffff:{ipaddress.IPv4Address(rng.getrandbits(32))}"


def test_addresses_equal_the_library(spark):
    texts = list(_addresses())
    frame = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", addresses.address_key(F.col("t")).alias("k"))
    for r in frame.withColumn("reserved", addresses.is_reserved(F.col("k"))).collect():
        try:
            want = ipaddress.ip_address(r.t) if r.t is not None else None
        except ValueError:
            want = None
        if want is None or "%" in r.t:
            assert r.k is None and r.reserved is None, r
            continue
        real = getattr(want, "ipv4_mapped", None) or want
        assert int(r.k[1:], 16) == int(real) and r.k[0] == str(real.version), r
        assert r.reserved == (not real.is_global), r


def test_url_targets(spark):
    good = ["93.184.216.34"]
    cases = [
        ("https://Example.COM./a?b#c", good, None, "https://example.com/a?b"), ("http://example.com:80", good, None, "http://example.com/"), ("http://example.com:443/", good, None, "http://example.com:443/"),
        ("https://bücher.example/ä", good, None, "https://xn--bcher-kva.example/ä"), ("https://example.com:/", good, None, "https://example.com/"),
        (None, good, "invalid_url", None), ("", good, "invalid_url", None), ("https://a.b/" + "x" * 4000, good, "invalid_url", None), ("https://[::1/", good, "invalid_url", None), ("https://[a]/", good, "invalid_url", None),
        ("https://a.b/x y", good, "unsafe_characters", None), ("https://a.b\\c", good, "unsafe_characters", None), ("https://a.b/ ", good, "unsafe_characters", None), ("https://a.b/\x01", good, "unsafe_characters", None),
        ("file:///etc/passwd", good, "unsupported_scheme", None), ("a.b/c", good, "unsupported_scheme", None), ("https://u:p@a.b/", good, "userinfo", None), ("https:///x", good, "missing_hostname", None), ("https://:443/", good, "missing_hostname", None),
        ("https://a..b/", good, "invalid_host", None), ("https://a.b:x/", good, "invalid_host", None), ("https://a.b:70000/", good, "invalid_host", None), ("https://" + "a" * 64 + ".b/", good, "invalid_host", None), ("https://a.b:8443/", good, "blocked_port", None),
        ("https://localhost/", good, "local_hostname", None), ("https://x.internal/", good, "local_hostname", None), ("http://127.0.0.1/", good, "ip_literal", None), ("http://[::1]/", good, "ip_literal", None), ("http://[fe80::1%25eth0]/", good, "ip_literal", None),
        ("http://2130706433/", good, "numeric_host", None), ("http://127.1/", good, "numeric_host", None), ("https://a.b/", [], "no_address", None), ("https://a.b/", None, "no_address", None),
        ("https://a.b/", [*good, "10.0.0.8"], "non_public_address", None), ("https://a.b/", ["fe80::1%eth0"], "scoped_ip", None), ("https://a.b/", ["x"], "invalid_dns_address", None), ("https://a.b/", ["::ffff:127.0.0.1"], "non_public_address", None),
    ]
    frame = spark.createDataFrame([(i, u, a) for i, (u, a, _, _) in enumerate(cases)], "i int, u string, a array<string>")
    for r in frame.select("i", addresses.url_target(F.col("u"), F.col("a")).alias("t")).collect():
        assert (r.t.code, r.t.url) == cases[r.i][2:], cases[r.i]
