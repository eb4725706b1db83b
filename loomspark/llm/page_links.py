"""Links by which a page names its other addresses: canonical links and page refreshes. DataFrame functions only."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of HTML, as a part of a character class.
W = r" \t\n\f\r"
# Comments and elements whose content is text only. One that is not closed goes on to the end of the page.
_TEXT_ONLY = rf"(?is)<!--(?:>|->|.*?(?:--!?>|\z))|<(script|style|title|textarea|xmp|iframe|noembed|noframes)(?=[{W}/>]).*?(?:</\1(?=[{W}/>])|\z)"
_VALUE = rf"\"[^\"]*+\"|'[^']*+'|[^{W}>\"'][^{W}>]*+"
ATTRIBUTE = rf"([^{W}/>][^{W}/>=]*+)(?:[{W}]*+=[{W}]*+({_VALUE})?+)?+"
_UNNAMED = rf"[^{W}/>][^{W}/>=]*+(?:[{W}]*+=[{W}]*+(?:{_VALUE})?+)?+"
# A tag is read attribute by attribute, so a > within quotes does not end it. Possessive throughout: linear time.
TAG = rf"(?i)(<(?:link|meta|base)(?:[{W}/](?:[{W}/]++|{_UNNAMED})*+)?+(?:>|\z))"
_PIECES = r"(&#[xX][0-9A-Fa-f]++;?+|&#[0-9]++;?+|&[A-Za-z][A-Za-z0-9]*+[;=]?+|&|[^&]++)"
REFRESH = rf"(?is)^[{W}]*(?:[0-9.]*[;,{W}]*url[{W}]*=|[0-9.]+[{W}]*[;,{W}][{W}]*)[{W}]*(?:\"([^\"]*).*|'([^']*).*|(.*))$"


def _windows_1252(byte: int) -> str:
    try:
        return bytes([byte]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(byte)


#: References to the code points 128 to 159 stand for characters of Windows-1252.
C1, FOR_C1 = "".join(map(chr, range(128, 160))), "".join(map(_windows_1252, range(128, 160)))


def _character(digits: Column, base: int) -> Column:
    """The character of a numeric reference; U+FFFD for zero, surrogates and numbers beyond Unicode."""
    short = F.regexp_replace(digits, "^0+", "")
    # At most seven digits are converted: more are beyond Unicode in either base.
    n = F.conv(F.when(F.length(short) <= 7, short).otherwise("0"), base, 10).cast("long")
    known = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    code = F.lpad(F.hex(F.when(known, n).otherwise(0xFFFD)), 8, "0")
    return F.translate(F.decode(F.unhex(code), "UTF-32"), C1, FOR_C1)


def decode_references(value: Column) -> Column:
    """An attribute's value with its character references decoded, as HTML reads them there: a named one without ; that
    = or a letter or digit follows stays as written."""
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")

    def piece(p: Column) -> Column:
        return (
            F.when(p.rlike("^&#[xX]"), _character(F.regexp_extract(p, "^&#[xX]([0-9A-Fa-f]+)", 1), 16))
            .when(p.startswith("&#") & (F.length(p) > 2), _character(F.regexp_extract(p, "^&#([0-9]+)", 1), 10))
            .when(p.startswith("&"), F.coalesce(F.try_element_at(names, F.substring(p, 2, 64)), p))
            .otherwise(p)
        )

    return F.when(value.contains("&"), F.array_join(F.transform(F.regexp_extract_all(value, F.lit(_PIECES), F.lit(1)), piece), "")).otherwise(value)


def _tags(html: Column) -> Column:
    """The link, meta and base tags that are neither in comments nor in text: (name, rel, href, equiv, content) each."""
    tags = F.regexp_extract_all(F.regexp_replace(html, _TEXT_ONLY, " "), F.lit(TAG), F.lit(1))

    def read(tag: Column) -> Column:
        keys = F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(1)), F.lower)
        values = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(2))

        def value(key: str) -> Column:
            v = F.get(values, (F.array_position(keys, key) - 1).cast("int"))  # the first of that name counts
            return decode_references(F.when(v.rlike("^[\"']"), v.substr(F.lit(2), F.length(v) - 2)).otherwise(v))

        return F.struct(F.get(keys, F.lit(0)).alias("name"), value("rel").alias("rel"), value("href").alias("href"), value("http-equiv").alias("equiv"), value("content").alias("content"))

    return F.transform(F.filter(tags, lambda t: t.endswith(">")), read)


def _trimmed(link: Column) -> Column:
    """A link as browsers take it: without tabs and line ends, and without spaces at its ends."""
    return F.trim(F.translate(link, "\t\n\r\f", ""))


def page_links(html: Column) -> Column:
    """(base, targets): the href of the page's first base tag that has one (else null), and the targets of all its
    canonical links and of all its refreshes, none empty. Null pages, and pages that hold neither word (written out, not
    in references), have none and are not read."""
    tags = _tags(html)
    href = F.filter(tags, lambda t: (t["name"] == "<base") & t["href"].isNotNull())
    canonical = F.filter(tags, lambda t: (t["name"] == "<link") & F.array_contains(F.split(F.lower(t["rel"]), f"[{W}]+"), "canonical") & t["href"].isNotNull())
    refresh = F.filter(tags, lambda t: (t["name"] == "<meta") & (F.lower(F.trim(t["equiv"])) == "refresh") & t["content"].isNotNull())
    aims = F.transform(refresh, lambda t: F.concat(*(F.regexp_extract(t["content"], REFRESH, i) for i in (1, 2, 3))))
    targets = F.filter(F.transform(F.concat(F.transform(canonical, lambda t: t["href"]), aims), _trimmed), lambda x: x != "")
    found = F.struct(_trimmed(F.get(href, F.lit(0))["href"]).alias("base"), targets.alias("targets"))
    return F.when(html.rlike("(?i)canonical|refresh"), found)


def _without_dots(path: Column) -> Column:
    """A path that begins with / with its . and .. segments resolved; .. at the root stays there."""
    parts = F.split(F.substring(path, 2, 2**31 - 1), "/", -1)

    def step(done: Column, x: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(x == ".", done).when(x == "..", up).otherwise(F.concat(done, F.array(x)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    ends = F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(ends, "/").otherwise(""))


def absolute(link: Column, url: Column) -> Column:
    """A link as a URL, against the URL `url`; null for other schemes (mailto:) and for links against a URL without ://."""
    scheme = F.regexp_extract(url, r"^(.*?)://", 1)
    host, path = (F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i) for i in (1, 2))
    site = F.concat(scheme, F.lit("://"), host)
    rest = F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    own = F.regexp_extract(link, r"(?s)^([^?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, r"(?s)^(.*/)", 1), F.lit("")), F.lit("/"))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (F.instr(url, "://") == 0), None)
        .when((link == "") | link.startswith("#"), url)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("?"), F.concat(site, path, link))
        .when(link.startswith("/"), F.concat(site, _without_dots(own), rest))
        .otherwise(F.concat(site, _without_dots(F.concat(folder, own)), rest))
    )
