"""URLs, pages and media."""

import contextlib
import itertools
import json
import re
from collections.abc import Callable, Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

#: Query parameters that only track, beside all that begin with utm_. Fixed values.
TRACKING = (
    "fbclid",
    "gclid",
    "mc_cid",
    "mc_eid",
    "ref_src",
    "trk",
)
#: Suffixes of two labels under which names are registered. Fixed values.
TWO_LABELS = (
    "ac.uk",
    "co.jp",
    "co.nz",
    "co.uk",
    "com.au",
    "com.br",
    "com.mx",
    "com.pl",
    "com.tr",
    "edu.pl",
    "gov.au",
    "gov.pl",
    "gov.uk",
    "net.au",
    "net.pl",
    "org.au",
    "org.pl",
    "org.uk",
)
#: Marks of pages that turn robots away. Fixed values.
ANTI_BOT = (
    "access denied",
    "are you a robot",
    "attention required",
    "bot verification",
    "captcha",
    "cf-chl-",
    "cf-turnstile",
    "checking your browser",
    "cloudflare ray id",
    "enable javascript and cookies",
    "g-recaptcha",
    "hcaptcha",
    "human verification",
    "incapsula incident id",
    "just a moment",
    "security verification",
    "verify you are human",
)
#: Hosts that no other machine can reach: names, endings, and the IPv4 ranges of private, local and reserved use.
_PRIVATE = (
    r"^(localhost|[^.]*|.*\.(local|home|internal|lan|localhost)"
    r"|(0|10|127)\..*|169\.254\..*|192\.168\..*|192\.0\.[02]\..*|198\.1[89]\..*|198\.51\.100\..*|203\.0\.113\..*"
    r"|172\.(1[6-9]|2\d|3[01])\..*|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\..*|(22[4-9]|2[345]\d)\.\d+\.\d+\.\d+)$"
)
_PARTS = r"^(?i)([a-z][a-z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#:]*)(?::(\d+))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, group: int) -> Column:
    """1 scheme, 2 credentials, 3 host, 4 port, 5 path, 6 query; empty where missing."""
    return F.regexp_extract(F.btrim(url), _PARTS, group)


def host(url: Column) -> Column:
    return F.lower(part(url, 3))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case; default port, fragment and tracking parameters dropped.

    Quotes around it and sentence marks after it are no part of a URL. Null for other schemes, credentials and private hosts.
    """
    url = F.btrim(F.btrim(url), F.lit("\"'<>«»"))
    url = F.regexp_replace(url, r"[.,;:!?]+$", "")
    for opening, closing in ((r"\(", r"\)"), (r"\[", r"\]"), (r"\{", r"\}")):
        # A bracket at the end that none opens is the sentence's, like the marks around it.
        url = F.regexp_replace(url, rf"^([^{opening}]*?)[{closing}.,;:!?]*$", "$1")
    scheme, name, port = F.lower(part(url, 1)), F.rtrim(host(url), F.lit(".")), part(url, 4)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    tracks = lambda k: k.startswith("utm_") | k.isin(*TRACKING)
    params = F.filter(F.split(part(url, 6), "&"), lambda p: (p != "") & ~tracks(F.lower(F.element_at(F.split(p, "="), 1))))
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    path = F.when(part(url, 5) == "", "/").otherwise(part(url, 5))
    bad = ~scheme.isin("http", "https") | (part(url, 2) != "") | name.rlike(_PRIVATE)
    return F.when(~bad, F.concat(scheme, F.lit("://"), name, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), path, query))


def registrable(name: Column) -> Column:
    """The last two labels of a host (www. aside), three under a suffix of two."""
    labels = F.split(F.regexp_replace(F.rtrim(name, F.lit(".")), r"^www\.", ""), r"\.")
    last2 = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    last3 = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")
    return F.when(last2.isin(*TWO_LABELS), last3).otherwise(last2)


def publisher(url: Column, otherwise: Column) -> Column:
    """Host without www; the given key where there is none."""
    name = F.regexp_replace(host(url), r"^www\.", "")
    return F.when(F.coalesce(name, F.lit("")) == "", otherwise).otherwise(name)


def url_problem(url: Column) -> Column:
    """Why a URL may not be fetched; null where it may."""
    name = host(url)
    return (
        F.when(url.isNull() | (F.btrim(url) == ""), "empty")
        .when(F.length(url) > 4000, "too_long")
        .when(~F.lower(part(url, 1)).isin("http", "https"), "scheme")
        .when(part(url, 2) != "", "credentials")
        .when(name == "", "host")
        .when((name == "localhost") | name.endswith(".local") | ~name.contains("."), "local_host")
        .when(name.rlike(r"^[0-9.]+$"), "numeric_host")
        .when((part(url, 4) != "") & ~part(url, 4).isin("80", "443"), "port")
    )


def visible_text(html: Column) -> Column:
    """Text of a page by patterns: scripts and styles out, tags to spaces, common entities decoded, white space squeezed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg)[^>]*>.*?</(script|style|noscript|svg)>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.btrim(F.regexp_replace(bare, r"\s+", " "))


def anti_bot(html: Column) -> Column:
    """Marks of an anti-bot page in its title, or in the first 16,384 characters of a page whose visible text is short."""
    title = F.lower(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    early = F.when(F.length(visible_text(html)) < 20_000, F.lower(F.substring(html, 1, 16_384))).otherwise("")
    marks = "|".join(ANTI_BOT)
    return F.coalesce(title.rlike(marks) | early.rlike(marks), F.lit(False))


_HTML, _PDF, _PLAIN = ("text/html", "application/xhtml+xml"), ("application/pdf", "application/x-pdf"), ("text/plain", "text/markdown")


def detected_media(content: Column, declared: Column, url: Column) -> Column:
    """Struct of ``media`` by a document's first characters, else as declared (null: not supported), and whether the two disagree."""
    head = F.lower(F.regexp_replace(F.substring(content, 1, 4096), r"^[\x{FEFF}\x00\s]+", ""))
    pdf = F.lower(F.substring(content, 1, 1024)).contains("%pdf-")
    robot = F.lower(F.substring(content, 1, 16_384)).rlike("|".join(ANTI_BOT))
    html = head.rlike("^<(!doctype html|html|head|body)") | head.contains("<html") | robot
    is_a = lambda kinds: F.coalesce(declared.isin(*kinds), F.lit(False))
    named_pdf = (F.coalesce(declared, F.lit("")) == "application/octet-stream") & F.lower(part(url, 5)).endswith(".pdf")
    media = F.when(pdf, "application/pdf").when(html, "text/html").when(is_a(_PDF), None).when(is_a(_HTML), "text/html").when(is_a(_PLAIN), "text/plain")
    apart = F.when(pdf, is_a(_HTML + _PLAIN)).when(html, is_a(_PDF) & ~robot).otherwise(is_a(_PDF) | named_pdf)
    return F.struct(media.alias("media"), apart.alias("mismatch"))


#: Keys of embedded JSON whose texts are public. Fixed values.
PUBLIC_KEYS = frozenset(
    (
        "address",
        "addresscountry",
        "addresslocality",
        "addressregion",
        "alternatename",
        "articlebody",
        "caption",
        "category",
        "contactpoint",
        "content",
        "description",
        "email",
        "headline",
        "label",
        "name",
        "opis",
        "postalcode",
        "price",
        "pricecurrency",
        "streetaddress",
        "telephone",
        "text",
        "title",
        "tytul",
        "url",
        "value",
    )
)
#: Nodes of a page's JSON that ``public_text`` looks at, and children of one list, if it is not told otherwise. Fixed values.
_NODES, _CHILDREN = 2000, 500
_CODE = re.compile(r"function\s*\(|=>|webpack|__next", re.IGNORECASE)


def _parsed(blocks) -> Iterator:
    """The JSON blocks that can be read."""
    for block in blocks:
        with contextlib.suppress(TypeError, ValueError, RecursionError):
            yield json.loads(block)


def _nodes(document, children: int | None = None) -> Iterator[tuple]:
    """Key and value of every node in the document's order, of a list's items the first ``children`` or all; items of a list have its key."""
    open_ = [iter([("", document)])]
    while open_:
        if (node := next(open_[-1], None)) is None:
            open_.pop()
            continue
        yield node
        key, value = node
        if isinstance(value, dict):
            open_.append(iter([(re.sub("[^a-z]", "", k.casefold()), v) for k, v in value.items()]))
        elif isinstance(value, list):
            open_.append(zip(itertools.repeat(key), value[:children]))


def public_text(blocks, most: int | None = 100_000, nodes: int | None = _NODES, children: int | None = _CHILDREN, longest: int | None = 1000) -> str:
    """Lines of text of JSON blocks: 2 to ``longest`` characters, no code, each once, ``most`` characters in all. A limit that is None is none."""
    nodes = itertools.islice(itertools.chain.from_iterable(_nodes(x, children) for x in _parsed(blocks)), nodes)
    texts = (" ".join(value.split()) for key, value in nodes if key in PUBLIC_KEYS and isinstance(value, str))
    lines = list(dict.fromkeys(t for t in texts if len(t) >= 2 and (longest is None or len(t) <= longest) and not _CODE.search(t)))
    before = itertools.accumulate(map(len, lines), initial=0)
    return "\n".join(t for t, n in zip(lines, before, strict=False) if most is None or n < most)[:most].strip()


@F.pandas_udf(StringType())
def embedded_text(blocks: pd.Series) -> pd.Series:
    """``public_text`` of each array of JSON blocks, whole: none of its limits holds; null for null."""
    return blocks.map(lambda b: None if b is None else public_text(b, most=None, nodes=None, children=None, longest=None))


#: Elements whose content is not shown, and elements that end a line. Fixed values.
HIDDEN = frozenset(("canvas", "noscript", "script", "style", "svg", "template"))
BLOCKS = frozenset(
    (
        "address",
        "article",
        "aside",
        "blockquote",
        "br",
        "dd",
        "div",
        "dl",
        "dt",
        "figcaption",
        "footer",
        "h1",
        "h2",
        "h3",
        "h4",
        "h5",
        "h6",
        "header",
        "hr",
        "li",
        "main",
        "nav",
        "ol",
        "p",
        "pre",
        "section",
        "table",
        "tbody",
        "td",
        "tfoot",
        "th",
        "thead",
        "tr",
        "ul",
    )
)
#: Elements that hold text alone: nothing but their own end tag ends them.
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in ("script", "style", "title")}
#: What follows a name up to the end of its tag; a mark of its end in quotes ends nothing. Never gives back what it has read.
_REST = re.compile(r"""(?>[^"'>]++|"[^"]*+"|'[^']*+')*+>""")
_NAME = re.compile(r"/?+([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
_DATA = ("application/ld+json", "application/json")


def _is_data(attributes: str) -> bool:
    """Whether a script tag says that it holds JSON."""
    found = {k.lower(): (a or b or c).lower() for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    return found.get("type") in _DATA or found.get("id") == "__next_data__"


def markup(html: str) -> Iterator[tuple[str, str, str]]:
    """Tokens of a page in one pass: ``text``; ``open``, ``close`` with name and attributes; ``raw`` content of an element by name.

    Comments and declarations give nothing. What follows a tag or comment that never ends is text. Each character is
    searched by a bounded number of scans, so time grows with the page alone.
    """
    at = start = 0
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4) + 3
        elif html.startswith(("<!", "<?"), at):
            end = html.find(">", at) + 1
        elif name := _NAME.match(html, at + 1):
            rest = _REST.match(html, name.end())
            end = rest.end() if rest else 0
        else:  # a mere sign
            at += 1
            continue
        if end < at + 1 or end == 2:
            break
        if at > start:
            yield "text", html[start:at], ""
        if html[at + 1] not in "!?":
            tag, closes = name[1].lower(), html[at + 1] == "/"
            attributes = html[name.end() : end - 1]
            yield "close" if closes else "open", tag, attributes
            if not closes and tag in _RAW and not attributes.endswith("/"):
                stop = _RAW[tag].search(html, end)
                inner = html[end : stop.start()] if stop else html[end:]
                yield "raw", inner, tag
                end += len(inner)
        at = start = end
    if start < len(html):
        yield "text", html[start:], ""


def listed_references(*names: tuple[str, str]) -> Callable[[str], str]:
    """Decodes the given character references alone, one after another; all others stay as they are."""

    def decode(text: str) -> str:
        for name, sign in names:
            text = text.replace(name, sign)
        return text

    return decode


def page_parts(html: str, decode: Callable[[str], str] = unescape, title_decode: Callable[[str], str] = unescape) -> tuple[str, str, list[str]]:
    """A page's title, its visible text in lines, and the contents of its JSON scripts.

    ``decode`` and ``title_decode``: which character references of the text and of the title are read, by default all of HTML's.

    Nothing inside a hidden element shows, however it is nested; one that is never closed hides the rest. A block tag ends a line,
    also one that stands alone; lines are squeezed, and of several empty ones in a row one stays.
    """
    shown, title, data = [], [], []
    hidden, json_next = 0, False
    for kind, value, more in markup(html):
        if kind == "text":
            if not hidden:
                shown.append(decode(value))
        elif kind == "raw":
            if value and json_next:
                data.append(value)
            elif more == "title" and not hidden:
                title.append(title_decode(value))
        else:
            alone = kind == "open" and more.endswith("/")
            json_next = kind == "open" and value == "script" and _is_data(more)
            if value in HIDDEN and not alone:
                hidden = max(0, hidden + (1 if kind == "open" else -1))
            if value in BLOCKS and not hidden:
                shown.append("\n")
    lines = [re.sub(r"[ \t\f\v]+", " ", x).strip() for x in re.split(r"\r\n?|\n", "".join(shown))]
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()
    return " ".join("".join(title).split()), text, data


def page_reader(*decodes: Callable[[str], str]):
    """A function of columns: ``page_parts`` of each page, with its ways to decode; null for null."""

    @F.pandas_udf(StructType().add("title", "string").add("text", "string").add("data", ArrayType(StringType())))
    def page_content(pages: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if p is None else page_parts(p, *decodes) for p in pages]
        return pd.DataFrame(rows, columns=["title", "text", "data"])

    return page_content


#: Pages with all of HTML's character references.
page_content = page_reader()
