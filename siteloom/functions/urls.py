"""URL functions as native column expressions.

A URL is cut by one regular expression (RFC 3986, appendix B, with the scheme held to its legal
letters), so a malformed URL still gives a row. No function here leaves the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteloom.functions.columns import let
from siteloom.functions.text import blank_to_null, title_case
from siteloom.session import per_session

# scheme, //, netloc, path, ?, query, #, fragment
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"
_GROUPS = {"scheme": 1, "netloc": 3, "path": 4, "query": 6, "fragment": 8}

# Schemes whose links are resolved against a base, and prefixes no crawler follows.
RELATIVE_SCHEMES = [
    "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
    "prospero", "rtsp", "rtsps", "sftp", "svn", "svn+ssh", "ws", "wss",
]
PARAM_SCHEMES = [
    "", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "sip", "sips", "mms", "sftp", "tel",
]
DEAD_PREFIXES = ("#", "javascript:", "mailto:", "tel:")
DEAD_PREFIXES_IN_ITEM = ("#", "javascript:", "mailto:")


def _clean(url: Column) -> Column:
    controls = "".join(chr(c) for c in range(0x21))
    return F.regexp_replace(F.ltrim(url, F.lit(controls)), r"[\t\r\n]", "")


def parts(url: Column) -> Column:
    """A URL as a struct: scheme (small), netloc, path, query, fragment."""
    piece = lambda u, name: F.regexp_extract(u, _PARTS, _GROUPS[name]).alias(name)
    return let(
        _clean(url),
        lambda u: F.struct(
            F.lower(piece(u, "scheme")).alias("scheme"), *[piece(u, n) for n in ("netloc", "path", "query", "fragment")]
        ),
    )


def part(url: Column, name: str) -> Column:
    piece = F.regexp_extract(_clean(url), _PARTS, _GROUPS[name])
    return F.lower(piece) if name == "scheme" else piece


def starts_with_any(value: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [value.startswith(p) for p in prefixes])


def rstrip_slashes(value: Column) -> Column:
    return F.rtrim(value, F.lit("/"))


def _unsplit(scheme: Column, netloc: Column, path: Column, query: Column, fragment: Column) -> Column:
    slash = F.when((netloc != "") & (path != "") & ~path.startswith("/"), "/").otherwise("")
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(netloc != "", F.concat(F.lit("//"), netloc)).otherwise(""),
        slash,
        path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )


def _decode(value: Column) -> Column:
    # a percent sign without two hex digits stands for itself
    return F.url_decode(F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(value: Column) -> Column:
    return F.replace(F.replace(F.url_encode(value), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def normalize_url(url: Column) -> Column:
    """One spelling per page: https, small host, no closing slash, no fragment, sorted query.

    Pairs without a value are dropped, as are ``;params`` of the last path segment.
    """
    pair = lambda p: F.struct(
        _decode(F.regexp_extract(p, "(?s)^([^=]*)=(.*)$", 1)).alias("k"),
        _decode(F.regexp_extract(p, "(?s)^([^=]*)=(.*)$", 2)).alias("v"),
    )
    encoded = lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))

    def spelled(u: Column) -> Column:
        path = F.when(u["scheme"].isin(PARAM_SCHEMES), F.regexp_replace(u["path"], ";[^/]*$", "")).otherwise(u["path"])
        pairs = F.filter(F.split(u["query"], "&"), lambda p: p.rlike("(?s)^[^=]*=."))
        query = F.array_join(F.transform(F.array_sort(F.transform(pairs, pair)), encoded), "&")
        return _unsplit(
            F.when(u["scheme"] == "http", F.lit("https")).otherwise(u["scheme"]),
            F.lower(u["netloc"]),
            F.coalesce(blank_to_null(rstrip_slashes(path)), F.lit("/")),
            F.when(u["query"] != "", query).otherwise(""),
            F.lit(""),
        )

    return F.when(url.isNotNull(), let(parts(url), spelled))


@per_session
def normalized(name: str = "url") -> Column:
    """``normalize_url`` of a named column."""
    return normalize_url(F.col(name))


def url_hash(url: Column) -> Column:
    """Short key: the first 12 hex digits of the MD5 of the (normalized) URL."""
    return F.substring(F.md5(url.cast("binary")), 1, 12)


def _merge_paths(base_path: Column, path: Column) -> Column:
    """Path of a relative link below the folder of the base, with dot segments resolved."""
    folder = F.regexp_replace(base_path, "[^/]*$", "")
    below = F.regexp_replace(F.concat(F.lit("/"), folder, path), "/{2,}", "/")
    # below a folder empty segments in the middle vanish, in a rooted link they stay
    joined = F.when(path.startswith("/"), path).otherwise(below)
    parent = lambda done: F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done)
    step = lambda done, seg: F.when(seg == "..", parent(done)).when(seg == ".", done).otherwise(F.array_append(done, seg))

    def resolved(whole: Column) -> Column:
        kept = F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step)
        closing = F.when(whole.rlike(r"(^|/)\.{1,2}$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.concat(kept, closing), "/")

    plain = ~joined.rlike(r"(^|/)\.{1,2}(/|$)")
    return F.coalesce(blank_to_null(F.when(plain, joined).otherwise(let(joined, resolved))), F.lit("/"))


def resolve_url(base: Column, link: Column) -> Column:
    """Absolute form of ``link`` found on page ``base`` (RFC 3986 reference resolution)."""

    def joined(x: Column) -> Column:
        b, u = x["b"], x["u"]
        scheme = F.when(u["scheme"] == "", b["scheme"]).otherwise(u["scheme"])
        bare = u["path"] == ""
        path = F.when(bare, b["path"]).otherwise(_merge_paths(b["path"], u["path"]))
        query = F.when(bare & (u["query"] == ""), b["query"]).otherwise(u["query"])
        own = u["netloc"] != ""
        whole = _unsplit(
            scheme,
            F.when(own, u["netloc"]).otherwise(b["netloc"]),
            F.when(own, u["path"]).otherwise(path),
            F.when(own, u["query"]).otherwise(query),
            u["fragment"],
        )
        foreign = (scheme != b["scheme"]) | ~(scheme.isin(RELATIVE_SCHEMES) | (scheme == ""))
        return F.when(foreign, x["link"]).otherwise(whole)

    both = F.struct(parts(base).alias("b"), parts(link).alias("u"), link.alias("link"))
    return (
        F.when(link.isNull() | base.isNull(), None)
        .when(link == "", base)
        .when(base == "", link)
        .otherwise(let(both, joined))
    )


@per_session
def resolved(base: str, link: str) -> Column:
    """``resolve_url`` of two named columns."""
    return resolve_url(F.col(base), F.col(link))


def is_same_domain(a: Column, b: Column) -> Column:
    """Same host, port and user part; a sub-domain is another domain."""
    return F.lower(part(a, "netloc")) == F.lower(part(b, "netloc"))


def score_drill_link(root: Column, candidate: Column) -> Column:
    """1.0 below the path of ``root``, 0.3 elsewhere on its host, 0.0 on another host."""
    below = rstrip_slashes(part(candidate, "path")).startswith(F.concat(rstrip_slashes(part(root, "path")), F.lit("/")))
    return F.when(root.isNull() | candidate.isNull(), None).when(~is_same_domain(root, candidate), 0.0).when(below, 1.0).otherwise(0.3)


def _page_of(url: Column) -> Column:
    # closing slashes go first and only then fragment and query, so "/a/#x" keeps its slash
    return F.regexp_replace(rstrip_slashes(url), "(?s)[#?].*$", "")


def is_valid_drill_link(link: Column, base: Column, resolved: Column | None = None) -> Column:
    """Whether following ``link`` leads to another page of the same host."""
    leads = lambda target: (_page_of(base) != _page_of(target)) & is_same_domain(base, target)
    valid = leads(resolved) if resolved is not None else let(resolve_url(base, link), leads)
    return F.coalesce((link != "") & ~starts_with_any(link, DEAD_PREFIXES) & valid, F.lit(False))


def url_label(url: Column) -> Column:
    """Readable label from the last path segment."""
    path = rstrip_slashes(F.regexp_replace(part(url, "path"), ";[^/]*$", ""))
    slug = F.regexp_extract(path, "([^/]*)$", 1)
    return title_case(F.translate(slug, "-_", "  "))


def plan_id(url: Column, stamp: Column) -> Column:
    """Readable plan id: safe start of the URL, then a hash of URL and creation time."""
    safe = F.trim(F.substring(F.regexp_replace(url, r"(?U)[^\w\-]", "_"), 1, 30), F.lit("_"))
    return F.concat_ws("_", safe, F.substring(F.md5(F.concat_ws(":", url, stamp).cast("binary")), 1, 12))
