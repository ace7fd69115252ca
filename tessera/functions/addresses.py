"""Internet addresses as fixed-width keys, looked up in a sorted table of reserved ranges; and which URLs may be fetched."""

import ipaddress
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Ranges that are not public, and parts of them that are. Fixed values of the special-purpose address registries.
RESERVED = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "100.64.0.0/10",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "240.0.0.0/4",
    "::/128",
    "::1/128",
    "::ffff:0:0/96",
    "64:ff9b:1::/48",
    "100::/64",
    "2001::/23",
    "2001:db8::/32",
    "2002::/16",
    "fc00::/7",
    "fe80::/10",
)
PUBLIC = (
    "192.0.0.9/32",
    "192.0.0.10/32",
    "2001:1::1/128",
    "2001:1::2/128",
    "2001:3::/32",
    "2001:4:112::/48",
    "2001:20::/28",
    "2001:30::/28",
)
#: Endings of names that only a local network knows. Fixed values.
LOCAL = (
    ".home",
    ".internal",
    ".lan",
    ".local",
    ".localhost",
)
PORTS = (80, 443)


def _key(number: int, version: int) -> str:
    return f"4{number:08x}" if version == 4 else f"6{number:032x}"


def intervals() -> list[tuple[str, str]]:
    """First and last key of each reserved range without its public parts: disjoint and sorted."""
    out = []
    for version in (4, 6):
        nets = lambda texts, v=version: [n for n in map(ipaddress.ip_network, texts) if n.version == v]
        for net in nets(RESERVED):
            start = int(net.network_address)
            for hole in sorted((h for h in nets(PUBLIC) if h.subnet_of(net)), key=lambda h: int(h.network_address)):
                if start < int(hole.network_address):
                    out.append((_key(start, version), _key(int(hole.network_address) - 1, version)))
                start = int(hole.broadcast_address) + 1
            if start <= int(net.broadcast_address):
                out.append((_key(start, version), _key(int(net.broadcast_address), version)))
    return sorted(out)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is written into the expression once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def _ipv4_hex(text: Column) -> Column:
    """Eight hexadecimal digits; null for anything but four numbers up to 255 without leading zeros."""
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    digits = F.array_join(F.transform(F.split(text, r"\."), lambda x: F.lpad(F.hex(x.try_cast("bigint")), 2, "0")), "")
    return F.when(text.rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$"), F.lower(digits))


def _ipv6_hex(text: Column) -> Column:
    """32 hexadecimal digits; null for anything but eight groups, of which one run may be ``::`` and the last two an IPv4 address."""
    groups = bound(_ipv4_hex(F.regexp_extract(text, r":([0-9.]+)$", 1)), lambda tail: F.concat(F.regexp_extract(text, r"^(.*:)[0-9.]+$", 1), F.substring(tail, 1, 4), F.lit(":"), F.substring(tail, 5, 4)))
    parts = lambda half: F.filter(F.split(half, ":"), lambda g: g != "")

    def padded(h: Column) -> Column:
        gap, short = 8 - F.size(h["left"]) - F.size(h["right"]), h["halves"] == 2
        fits = F.when(short, gap >= 1).otherwise((h["halves"] == 1) & (gap == 0))
        zeros = F.when(short, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0)))).otherwise(F.array().cast("array<string>"))
        return F.when(fits, F.lower(F.array_join(F.transform(F.concat(h["left"], zeros, h["right"]), lambda g: F.lpad(g, 4, "0")), "")))

    def read(whole: Column) -> Column:
        # A lone colon at an end, or three in a row, would vanish in the filter of empty groups.
        shape = whole.rlike(r"^[0-9a-fA-F:]+$") & ~whole.rlike(r":::|^:[^:]|[^:]:$|[0-9a-fA-F]{5}")
        halves = bound(F.split(whole, "::"), lambda h: F.struct(F.size(h).alias("halves"), parts(h[0]).alias("left"), parts(F.coalesce(F.get(h, F.lit(1)), F.lit(""))).alias("right")))
        return F.when(shape, bound(halves, padded))

    return bound(F.when(text.contains("."), groups).otherwise(text), read)


def address_key(text: Column) -> Column:
    """An address as ``4`` and 8 or ``6`` and 32 hexadecimal digits, whose order is that of the numbers; null if it is none.

    An IPv4 address that is written as an IPv6 one (``::ffff:a.b.c.d``) is the IPv4 address.
    """
    mapped = lambda six: F.substring(six, 1, 24) == "0" * 20 + "ffff"
    unwrapped = lambda six: F.when(mapped(six), F.concat(F.lit("4"), F.substring(six, 25, 8))).otherwise(F.concat(F.lit("6"), six))
    four = F.concat(F.lit("4"), _ipv4_hex(text))
    return F.coalesce(four, F.when(text.contains(":"), bound(_ipv6_hex(text), unwrapped)))


def is_reserved(key: Column) -> Column:
    """Whether an address lies in a reserved range: the last range that starts at or before it is looked at. Null for null."""
    table = intervals()
    starts, ends = (F.array(*[F.lit(x[i]) for x in table]) for i in (0, 1))
    last = lambda before: (before > 0) & F.coalesce(F.get(ends, before - 1) >= key, F.lit(False))
    return F.when(key.isNotNull(), bound(F.size(F.filter(starts, lambda s: s <= key)), last))


@F.pandas_udf(StringType())
def idna(names: pd.Series) -> pd.Series:
    """Host names in ASCII; null for those that have no such form."""

    def ascii_(name: str | None) -> str | None:
        try:
            return name if name is None or name.isascii() else name.encode("idna").decode("ascii").lower()
        except UnicodeError:
            return None

    return names.map(ascii_)


def url_target(url: Column, addresses: Column) -> Column:
    """``code`` (null: may be fetched), ``url`` in canonical form, ``host``, ``port`` and the distinct ``addresses``.

    ``addresses`` are those that the name resolves to. What is asked first decides: length, characters, scheme,
    credentials, name, port, local and numeric hosts, and each address in turn.
    """
    at = lambda i: F.regexp_extract(url, r"^(?s)(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$", i)
    scheme, net, path, query = F.lower(at(1)), at(2), at(3), at(4)
    place = F.regexp_replace(net, r"^.*@", "")
    boxed = place.startswith("[")
    name = F.lower(F.when(boxed, F.regexp_extract(place, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(place, r"^([^:]*)", 1)))
    port_text = F.when(boxed, F.regexp_extract(place, r"^\[[^\]]*\](.*)$", 1)).otherwise(F.regexp_extract(place, r"^[^:]*(.*)$", 1))
    bare = F.regexp_replace(name, r"\.+$", "")
    # The function in Python stands outside of what follows, which is built of its result.
    read = F.struct(scheme.alias("scheme"), net.alias("net"), path.alias("path"), query.alias("query"), place.alias("place"), name.alias("name"), port_text.alias("port_text"), idna(bare).alias("host"))
    return bound(read, lambda p: _judged(url, addresses, p))


def _address_problem(address: Column) -> Column:
    """Why a resolved address may not be used; null if it may."""
    known = lambda key: F.when(key.isNull(), "invalid_dns_address").when(is_reserved(key), "non_public_address")
    return F.when(address.contains("%"), "scoped_ip").otherwise(bound(address_key(address), known))


def _judged(url: Column, addresses: Column, p: Column) -> Column:
    host, boxed = p["host"], p["place"].startswith("[")
    given = F.nullif(F.regexp_replace(p["port_text"], ":", ""), F.lit("")).try_cast("int")
    default = F.when(p["scheme"] == "https", 443).otherwise(80)
    port = F.when(given > 0, given).otherwise(default)
    broken = (boxed != p["place"].contains("]")) | (boxed & _ipv6_hex(F.regexp_replace(p["name"], "%.*$", "")).isNull())
    labels = F.exists(F.split(host, r"\."), lambda x: (x == "") | (F.length(x) > 63))
    bad_host = host.isNull() | (~boxed & labels) | ~p["port_text"].rlike(r"^(:\d{0,9})?$") | (given > 65535)
    wrong = F.filter(F.transform(addresses, _address_problem), lambda c: c.isNotNull())
    code = (
        F.when(url.isNull() | (url == "") | (F.length(url) > 4000), "invalid_url")
        .when(url.rlike(r"[\\\x00-\x20\x7f-\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"), "unsafe_characters")
        .when(broken, "invalid_url")
        .when(~p["scheme"].isin("http", "https"), "unsupported_scheme")
        .when(p["net"].contains("@"), "userinfo")
        .when(p["name"] == "", "missing_hostname")
        .when(bad_host, "invalid_host")
        .when(~port.isin(*PORTS), "blocked_port")
        .when((host == "localhost") | host.rlike("(" + "|".join(x.replace(".", r"\.") for x in LOCAL) + ")$"), "local_hostname")
        .when(p["name"].contains("%") | address_key(host).isNotNull(), "ip_literal")
        .when(host.rlike(r"^[0-9.]+$"), "numeric_host")
        .when(F.coalesce(F.size(addresses), F.lit(0)) == 0, "no_address")
        .otherwise(F.get(wrong, F.lit(0)))
    )
    own_port = F.when(port == default, "").otherwise(F.concat(F.lit(":"), port.cast("string")))
    canonical = F.concat(p["scheme"], F.lit("://"), host, own_port, F.when(p["path"] == "", "/").otherwise(p["path"]), F.when(p["query"] == "", "").otherwise(F.concat(F.lit("?"), p["query"])))

    def told(code: Column) -> Column:
        fine = code.isNull()
        return F.struct(code.alias("code"), F.when(fine, canonical).alias("url"), F.when(fine, host).alias("host"), F.when(fine, port).alias("port"), F.when(fine, F.array_distinct(addresses)).alias("addresses"))

    return bound(code, told)
