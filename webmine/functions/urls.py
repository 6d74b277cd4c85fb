"""URL column expressions (JVM-side, codegen friendly). Every function maps Column -> Column.

Parsing follows the RFC 3986 appendix-B split, which never fails; the few inputs a strict parser rejects (a bad
percent escape in path or fragment) give NULL where a canonical form is asked for.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import (
    BAD_ESCAPE,
    DOMAIN_NAME_JAVA,
    HAS_SCHEME,
    MEDIA_EXTENSIONS,
    MIME_PREFIXES,
    UNPRINTABLE,
    URL_SPLIT,
)

_SPLIT = "(?s)" + URL_SPLIT


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _g(c: Column, i: int) -> Column:
    return F.regexp_extract(c, _SPLIT, i)


def url_scheme(c) -> Column:
    return F.lower(_g(_col(c), 2))


def url_authority(c) -> Column:
    return _g(_col(c), 4)


def url_hostport(c) -> Column:
    """Host with port, without user info (Go's ``URL.Host``)."""
    return F.regexp_replace(url_authority(c), r"^.*@", "")


def url_hostname(c) -> Column:
    """Host without port (Go's ``URL.Hostname()``)."""
    return F.regexp_replace(url_hostport(c), r":[0-9]*$", "")


def url_port(c) -> Column:
    return F.regexp_extract(url_hostport(c), r":([0-9]*)$", 1)


def url_path(c) -> Column:
    return _g(_col(c), 5)


def url_query(c) -> Column:
    return _g(_col(c), 7)


def url_fragment(c) -> Column:
    return _g(_col(c), 9)


def url_parts(c) -> Column:
    """struct(scheme, authority, host, port, path, query, fragment)."""
    c = _col(c)
    return F.struct(
        url_scheme(c).alias("scheme"),
        url_authority(c).alias("authority"),
        F.lower(url_hostname(c)).alias("host"),
        url_port(c).alias("port"),
        url_path(c).alias("path"),
        url_query(c).alias("query"),
        url_fragment(c).alias("fragment"),
    )


def strip_query(c) -> Column:
    """URL without its query string (fragment kept), as the crawler's alias check builds it."""
    c = _col(c)
    return F.regexp_replace(c, r"(?s)^([^?#]*)\?[^#]*", "$1")


def has_scheme(c) -> Column:
    return _col(c).rlike(HAS_SCHEME)


def has_param(c) -> Column:
    return _col(c).rlike(r"(?s)\?.*=")


def is_domain_name(c) -> Column:
    return _col(c).rlike(DOMAIN_NAME_JAVA)


def is_unprintable(c) -> Column:
    return _col(c).rlike(UNPRINTABLE)


def is_mime_like(c) -> Column:
    c = _col(c)
    cond = F.lit(False)
    for p in MIME_PREFIXES:
        cond = cond | c.startswith(p)
    return cond


def has_extension(c) -> Column:
    """Cut at the first ? or #, drop one trailing /, then the last segment has a dot."""
    c = _col(c)
    s = F.regexp_replace(F.regexp_replace(c, r"(?s)[?#].*$", ""), r"/\z", "")
    return s.rlike(r"\.[^/]*\z")


def extension_of(c) -> Column:
    """Lower-cased extension of the last path segment ('' when none)."""
    c = _col(c)
    s = F.regexp_replace(F.regexp_replace(c, r"(?s)[?#].*$", ""), r"/$", "")
    return F.lower(F.regexp_extract(s, r"\.([^./]*)$", 1))


def is_media_url(c) -> Column:
    """URL path ends in an image, audio, video or font extension."""
    c = _col(c)
    path = F.regexp_replace(c, r"(?s)[?#].*$", "")
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)).isin(MEDIA_EXTENSIONS)


def is_trapped(path) -> Column:
    """U8: >= 10 parts; sum of non-overlapping counts of each non-empty part (after the first) / parts >= 3."""
    p = _col(path)
    parts = F.split(p, "/")
    tot = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.lit(0).cast("bigint"),
        lambda acc, x: acc
        + F.when(x == "", F.lit(0).cast("bigint")).otherwise(
            F.floor((F.length(p) - F.length(F.replace(p, x, F.lit("")))) / F.length(x)).cast("bigint")
        ),
    )
    return (F.size(parts) >= 10) & (F.floor(tot / F.size(parts)) >= 3)


def clean_url(c) -> Column:
    """U3 (queue form): default http://, collapse duplicate slashes in the path, ensure a trailing slash.

    A protocol-relative ``//host/x`` gets ``http:``. The slash is added only when there is no query or fragment and the
    last path segment has no extension. One split regex keeps the expression small (it is inlined into pushed-down
    filters).
    """
    c = _col(c)
    u = F.concat(F.when(c.startswith("//"), F.lit("http:")).when(~c.contains("://"), F.lit("http://")).otherwise(F.lit("")), c)
    m = r"(?s)^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)(.*)$"
    path = F.regexp_replace(F.regexp_extract(u, m, 2), r"/{2,}", "/")
    tail = F.regexp_extract(u, m, 3)
    add_slash = (tail == "") & ~path.rlike(r"(/|\.[^/]*)\z")
    return F.concat(F.regexp_extract(u, m, 1), path, F.when(add_slash, F.lit("/")).otherwise(F.lit("")), tail)


# --- canonical form (U2) -------------------------------------------------------------------------------------------

# Characters a path may carry unescaped besides A-Z a-z 0-9 - . _ ~ (all RFC 3986 reserved except ? and #).
_PATH_KEEP = [":", "/", "[", "]", "@", "!", "$", "&", "'", "(", ")", "+", ",", ";", "="]
_FRAGMENT_KEEP = _PATH_KEEP + ["?", "#"]


def _unescape_keep(encoded: Column, keep: list[str]) -> Column:
    # Java's form encoder writes space as "+" (a literal "+" is %2B) and leaves "*" bare; turn it into RFC form.
    out = F.replace(encoded, F.lit("+"), F.lit("%20"))
    out = F.replace(out, F.lit("%7E"), F.lit("~"))
    for ch in keep:
        out = F.replace(out, F.lit("%%%02X" % ord(ch)), F.lit(ch))
    return out


_PATH_SAFE = r"^[A-Za-z0-9\-._~:/\[\]@!$&'()*+,;=]*\z"
_FRAGMENT_SAFE = r"^[A-Za-z0-9\-._~:/\[\]@!$&'()*+,;=?#]*\z"


_TOKENS = r"%[0-9A-Fa-f]{2}|[^%]+|%"
_UNRESERVED = string.ascii_letters + string.digits + "-._~"


def _escapes(c: Column, literal: str, text: Callable[[Column], Column], space: str = "%20") -> Column:
    """Normal escapes without decoding, so bytes that are no UTF-8 stay as they are: an escape of a character in
    ``literal`` becomes that character, any other gets upper-case hex (``space`` for a space), and ``text`` escapes
    what isn't an escape yet."""
    plain = F.create_map(*[F.lit(x) for ch in literal for x in ("%%%02X" % ord(ch), ch)], F.lit("%20"), F.lit(space))

    def token(t):
        up = F.upper(t)
        return F.when(t.startswith("%"), F.coalesce(F.try_element_at(plain, up), up)).otherwise(text(t))

    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_TOKENS), 0), token), "")


def _path_normal(c: Column, keep: list[str], safe: str) -> Column:
    literal = _UNRESERVED + "*" + "".join(keep)
    # fast path: nothing to escape
    return F.when(c.rlike(safe), c).otherwise(_escapes(c, literal, lambda t: _unescape_keep(F.url_encode(t), keep)))


def _query_normal(c: Column) -> Column:
    def text(t):
        out = F.replace(F.replace(F.url_encode(t), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
        return F.replace(out, F.lit("%2B"), F.lit("+"))  # a raw "+" is a space and stays one

    return F.when(c.rlike(r"^[A-Za-z0-9\-._~+]*\z"), c).otherwise(_escapes(c, _UNRESERVED, text, "+"))


def _no_utf8(decoded: Column, raw: Column) -> Column:
    return decoded.contains("\ufffd") & ~F.upper(raw).contains("%EF%BF%BD") & ~raw.contains("\ufffd")


def _sort_query(q: Column) -> Column:
    pairs = F.filter(F.split(q, "&"), lambda p: (p != "") & ~p.contains(";"))

    def parsed(p):
        k = F.substring_index(p, "=", 1)
        v = F.when(p.contains("="), F.regexp_extract(p, r"(?s)^[^=]*=(.*)\z", 1)).otherwise(F.lit(""))
        dk = F.try_url_decode(k)
        # order by decoded name and value; a name that is no UTF-8 keeps its escapes
        return F.struct(
            dk.alias("k"), F.try_url_decode(v).alias("v"),
            F.when(_no_utf8(dk, k), _query_normal(k)).otherwise(dk).alias("name"), _query_normal(v).alias("value"),
        )

    good = F.array_sort(F.filter(F.transform(pairs, parsed), lambda x: x["k"].isNotNull() & x["v"].isNotNull()))
    rendered = F.array_join(F.transform(good, lambda x: F.concat(x["name"], F.lit("="), x["value"])), "&")
    return F.when(F.size(good) > 0, rendered).otherwise(q)


def _quad(v: Column) -> Column:
    return F.concat_ws(
        ".",
        F.shiftright(v, 24).cast("string"),
        F.shiftright(v, 16).bitwiseAND(255).cast("string"),
        F.shiftright(v, 8).bitwiseAND(255).cast("string"),
        v.bitwiseAND(255).cast("string"),
    )


def _decode_ip_host_stages(d: DataFrame, src: str, out: str) -> DataFrame:
    """DWORD, octal and hex IPv4 hosts become dotted quads (trailing dots / port kept)."""
    h = F.col(src)
    dword_re = r"^(\d+)((?:\.+)?(?::\d*)?)$"
    d = d.withColumn("_dw", F.regexp_extract(h, dword_re, 1))
    whole = F.when(F.col("_dw") != "", F.col("_dw")).try_cast("decimal(38,0)")
    dv = F.when(whole <= F.lit(2**32 - 1), whole.cast("bigint"))
    d = d.withColumn("_dv", dv)
    d = d.withColumn("_ha1", F.when(F.col("_dv").isNotNull(), F.concat(_quad(F.col("_dv")), F.regexp_extract(h, dword_re, 2))).otherwise(h))
    h1 = F.col("_ha1")
    octal_re = r"^(0\d*)\.(0\d*)\.(0\d*)\.(0\d*)((?:\.+)?(?::\d*)?)$"
    ok = h1.rlike(r"^(0[0-7]*)\.(0[0-7]*)\.(0[0-7]*)\.(0[0-7]*)((?:\.+)?(?::\d*)?)$")
    d = d.withColumn(
        "_ha2",
        F.when(
            ok,
            F.concat(F.concat_ws(".", *[F.conv(F.regexp_extract(h1, octal_re, i), 8, 10) for i in range(1, 5)]),
                     F.regexp_extract(h1, octal_re, 5)),
        ).otherwise(h1),
    )
    h2 = F.col("_ha2")
    hex_re = r"^0x([0-9A-Fa-f]+)((?:\.+)?(?::\d*)?)$"
    d = d.withColumn("_hx", F.regexp_extract(h2, hex_re, 1))
    digits = F.regexp_replace("_hx", "^0+(?=.)", "")  # eight digits are 2^32 - 1 at most
    d = d.withColumn("_hv", F.when((F.col("_hx") != "") & (F.length(digits) <= 8), F.conv(digits, 16, 10).cast("bigint")))
    return d.withColumn(
        out, F.when(F.col("_hv").isNotNull(), F.concat(_quad(F.col("_hv")), F.regexp_extract(h2, hex_re, 2))).otherwise(h2)
    )


def with_canonical(df: DataFrame, src, out: str = "canonical_url") -> DataFrame:
    """Adds ``out``, the canonical form of URL column ``src`` (NULL when a strict parser would reject it).

    Lower-case scheme and host; drop the default port; remove dot segments and duplicate slashes; sort the query
    (pairs with ';' or a bad escape are dropped, values re-escaped); decode DWORD/octal/hex IPv4 hosts; trim stray dots
    around the host; drop an empty port; drop one trailing slash; decode escapes that are not needed and add the ones
    that are, with upper-case hex. A backslash is escaped as %5C first.

    Built as a chain of projections (one per step) so every intermediate is computed once per row.
    """
    keep = df.columns
    col = F.col
    d = df.withColumn("_cu", F.replace(_col(src), F.lit("\\"), F.lit("%5C")))
    u = col("_cu")
    d = d.select(
        "*",
        F.lower(_g(u, 2)).alias("_sch"),
        (_g(u, 3) != "").alias("_ha"),
        _g(u, 4).alias("_au"),
        _g(u, 5).alias("_rp"),
        (_g(u, 6) != "").alias("_hq"),
        _g(u, 7).alias("_q"),
        _g(u, 9).alias("_fr"),
    )
    d = d.select(
        "*",
        F.regexp_extract("_au", r"^(.*@)", 1).alias("_ui"),
        F.lower(F.regexp_replace("_au", r"^.*@", "")).alias("_h0"),
        ((col("_sch") != "") & ~col("_ha") & (col("_rp") != "") & ~col("_rp").startswith("/")).alias("_op"),
    )
    d = d.withColumn("_bad", col("_rp").rlike(BAD_ESCAPE) | col("_fr").rlike(BAD_ESCAPE) | col("_h0").rlike(BAD_ESCAPE))
    h0, sch = col("_h0"), col("_sch")
    d = d.withColumn(
        "_h1",
        F.when((sch == "http") & h0.endswith(":80"), F.regexp_replace(h0, r":80$", ""))
        .when((sch == "https") & h0.endswith(":443"), F.regexp_replace(h0, r":443$", ""))
        .otherwise(h0),
    )
    d = _decode_ip_host_stages(d, "_h1", "_h2")
    d = d.withColumn(
        "_h3",
        F.concat(
            F.regexp_replace(F.regexp_extract("_h2", r"^(.+?)(:\d+)?$", 1), r"^\.+|\.+$", ""),
            F.regexp_extract("_h2", r"^(.+?)(:\d+)?$", 2),
        ),
    )
    d = d.withColumn("_h", F.regexp_replace("_h3", r":+$", ""))
    d = d.withColumn("_pd", F.when(~col("_bad"), _path_normal(col("_rp"), _PATH_KEEP, _PATH_SAFE)))
    d = d.withColumn("_pseg", F.split("_pd", "/"))
    d = d.withColumn(
        "_pf",
        F.aggregate(
            col("_pseg"),
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s))),
        ),
    )
    d = d.withColumn("_pj", F.array_join("_pf", "/"))
    d = d.withColumn(
        "_pj2", F.when((col("_h") != "") & ~col("_pj").startswith("/"), F.concat(F.lit("/"), "_pj")).otherwise(col("_pj"))
    )
    d = d.withColumn(
        "_pdot",
        F.when(col("_pd") == "", col("_pd"))
        .when(F.element_at("_pseg", -1).isin(".", "..") & ~col("_pj2").endswith("/"), F.concat("_pj2", F.lit("/")))
        .otherwise(col("_pj2")),
    )
    d = d.withColumn("_po", F.regexp_replace(F.regexp_replace("_pdot", r"/{2,}", "/"), r"/\z", ""))
    d = d.withColumn("_qo", F.when(col("_hq"), _sort_query(col("_q"))).otherwise(F.lit("")))
    d = d.withColumn("_fo", F.when((col("_fr") != "") & ~col("_bad"), _path_normal(col("_fr"), _FRAGMENT_KEEP, _FRAGMENT_SAFE)))
    host = col("_h")
    authority_part = F.when((sch != "") | (host != "") | (col("_ui") != ""), F.concat(F.lit("//"), "_ui", "_h")).otherwise(
        F.lit("")
    )
    po = col("_po")
    sep = F.when((po != "") & ~po.startswith("/") & (host != ""), F.lit("/")).otherwise(F.lit(""))
    body = F.when(col("_op"), col("_rp")).otherwise(F.concat(authority_part, sep, po))
    res = F.concat(
        F.when(sch != "", F.concat(sch, F.lit(":"))).otherwise(F.lit("")),
        body,
        F.when(col("_qo") != "", F.concat(F.lit("?"), "_qo")).otherwise(F.lit("")),
        F.when(col("_fo").isNotNull() & (col("_fo") != ""), F.concat(F.lit("#"), "_fo")).otherwise(F.lit("")),
    )
    res = F.when(col("_bad") | col("_pd").isNull(), F.lit(None).cast("string")).otherwise(res)
    # A one-element explode (Generate) stops predicate pushdown from inlining the whole stage chain into a filter or
    # join condition on ``out`` (that inlining grows exponentially with the number of stages).
    return d.select(*[c for c in keep if c != out], F.explode(F.array(res)).alias(out))
