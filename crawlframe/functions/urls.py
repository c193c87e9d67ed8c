"""URL parsing, validation and reference resolution as column expressions.

A URL is split once by the generic pattern of RFC 3986, appendix B, into a
struct; everything else works on that struct. ``parse_url`` is not used: it
raises on characters that real pages contain, and drops the port.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .binding import let

# RFC 3986 appendix B, and the characters a path or fragment may hold unescaped.
GENERIC_URL = r"(?s)^(?:([^:/?#]+):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?"
PATH_NEEDS_ESCAPE = r"[^A-Za-z0-9_.~$&+,/:;=@!'()*%\[\]-]"
FRAGMENT_NEEDS_ESCAPE = r"[^A-Za-z0-9_.~$&+,/:;=@!'()*%\[\]?-]"
PATH_LITERALS = (("%7E", "~"), ("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%2C", ","),
                 ("%2F", "/"), ("%3A", ":"), ("%3B", ";"), ("%3D", "="), ("%40", "@"))
FRAGMENT_LITERALS = PATH_LITERALS + (("%3F", "?"), ("%21", "!"), ("%28", "("), ("%29", ")"),
                                     ("%2A", "*"))

# Plain forms that need no parsing: nothing to escape, no dot segment, no user info.
_SEGMENTS = r"(?:/(?![./])[A-Za-z0-9_.~$&+,:;=@!'()*-]*+)"
_PLAIN_QUERY = r"(?:\?[A-Za-z0-9_.~$&+,:;=@!'()*/?-]*+)?"
PLAIN_ABSOLUTE = rf"^https?://[A-Za-z0-9._-]++(?::[0-9]++)?{_SEGMENTS}*+{_PLAIN_QUERY}\z"
PLAIN_ROOTED = rf"^{_SEGMENTS}++{_PLAIN_QUERY}\z"

_SEP = "\u0001"
_CONTROL = r"[\x00-\x1f\x7f]"
_BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"
_BAD_HOST = r"[\x00-\x20\x7f\\^`{|}/?#@]|%(?![89A-Fa-f][0-9A-Fa-f])"
_BAD_PORT = r":[^:\]]*[^0-9:\]][^:\]]*$"
_BAD_USERINFO = r"[^A-Za-z0-9._~!$&'()*+,;=%@:-]"
_DOT_SEGMENT = r"(^|/)\.{1,2}(/|$)"


def _fields(url: Column) -> Column:
    """Scheme, authority ('//…'), path, query ('?…') and fragment ('#…') as an array.

    One regex pass rewrites the URL into its parts, separated by a control
    character that no valid URL holds.
    """
    marked = F.regexp_replace(url, GENERIC_URL, _SEP.join(f"${i}" for i in range(1, 6)))
    return F.split(marked, _SEP, -1)


def _refine(parts: Column, url: Column) -> Column:
    scheme, authority, path = parts[0], parts[1], parts[2]
    query, fragment = parts[3], parts[4]
    # '///x' without a scheme is a path, not an empty host.
    slashes_only = (scheme == "") & (authority == "//") & F.startswith(path, F.lit("/"))
    user_host = F.when(slashes_only, "").otherwise(F.substring(authority, 3, 1 << 30))
    host = F.regexp_extract(user_host, r"(?s)([^@]*)$", 1)
    userinfo = F.substring(user_host, F.lit(1), F.length(user_host) - F.length(host))
    before_fragment = F.substring(url, F.lit(1), F.length(url) - F.length(fragment))
    bad = (
        ((scheme != "") & ~F.rlike(scheme, F.lit("^[A-Za-z][A-Za-z0-9+.-]*$")))
        | ((scheme == "") & (authority == "") & F.rlike(path, F.lit("^[^/]*:")))
        | F.rlike(before_fragment, F.lit(_CONTROL))
        | F.rlike(path, F.lit(_BAD_ESCAPE)) | F.rlike(fragment, F.lit(_BAD_ESCAPE))
        | F.rlike(host, F.lit(_BAD_HOST)) | F.rlike(host, F.lit(_BAD_PORT))
        | F.rlike(userinfo, F.lit(_BAD_USERINFO)) | F.rlike(userinfo, F.lit(_BAD_ESCAPE))
    )
    opaque = (scheme != "") & (authority == "") & ~F.startswith(path, F.lit("/"))
    return F.when(~bad, F.struct(
        F.lower(scheme).alias("scheme"),
        userinfo.alias("userinfo"),
        host.alias("host"),
        F.when(slashes_only, F.concat(F.lit("//"), path)).otherwise(path).alias("path"),
        query.alias("query"),
        fragment.alias("fragment"),
        opaque.alias("opaque"),
    ))


def parse(url: Column) -> Column:
    """Struct of URL parts, NULL when the URL cannot be parsed."""
    return let(_fields(url), lambda parts: _refine(parts, url))


def url_host(url: Column) -> Column:
    """Host with port but without user info; '' for a URL that does not parse."""
    return F.when(F.rlike(url, F.lit(PLAIN_ABSOLUTE)), F.regexp_extract(url, "^https?://([^/?]*)", 1)) \
            .otherwise(F.coalesce(parse(url)["host"], F.lit("")))


def url_path(url: Column) -> Column:
    """Decoded path of a URL, as robots rules see it; NULL if the URL does not parse."""
    return F.try_url_decode(F.replace(parse(url)["path"], F.lit("+"), F.lit("%2B")))


def report_domain(url: Column) -> Column:
    """Domain as the reports name it: scheme stripped literally, cut at the first slash."""
    return F.regexp_extract(url, "^(?:https?://)?([^/]*)", 1)


def is_valid_url(url: Column) -> Column:
    """True for http and https URLs (the crawl's rule)."""
    return F.rlike(url, F.lit(PLAIN_ABSOLUTE)) | F.coalesce(
        parse(url)["scheme"].isin("http", "https"), F.lit(False))


def is_submittable_url(url: Column) -> Column:
    """True for URLs with any scheme and a host (the rule for submitted URLs)."""
    return F.coalesce(let(parse(url), lambda p: (p["scheme"] != "") & (p["host"] != "")),
                      F.lit(False))


def _escape(text: Column, literals: tuple[tuple[str, str], ...]) -> Column:
    decoded = F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    out = F.replace(F.url_encode(decoded), F.lit("+"), F.lit("%20"))
    out = F.replace(out, F.lit("*"), F.lit("%2A"))
    for code, char in literals:
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def escape_path(path: Column) -> Column:
    """Percent-encode a path, but only if it holds a character that needs it."""
    return F.when(F.rlike(path, F.lit(PATH_NEEDS_ESCAPE)), _escape(path, PATH_LITERALS)) \
            .otherwise(path)


def _escape_fragment(fragment: Column) -> Column:
    return F.when(F.rlike(fragment, F.lit(FRAGMENT_NEEDS_ESCAPE)),
                  F.concat(F.lit("#"), _escape(F.substring(fragment, 2, 1 << 30),
                                               FRAGMENT_LITERALS))) \
            .otherwise(fragment)


def _escape_host(host: Column) -> Column:
    return F.when(F.rlike(host, F.lit(r"[^\x00-\x7f]")),
                  F.array_join(F.transform(
                      F.regexp_extract_all(host, F.lit(r"[\x00-\x7f]+|[^\x00-\x7f]+"), F.lit(0)),
                      lambda run: F.when(F.rlike(run, F.lit(r"^[\x00-\x7f]")), run)
                                   .otherwise(F.url_encode(run))), "")) \
            .otherwise(host)


def remove_dot_segments(path: Column) -> Column:
    """Resolve '.' and '..' and make a non-empty path start with a slash."""
    segments = F.split(path, "/", -1)
    kept = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
                        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
                        .otherwise(F.concat(acc, F.array(s))))
    tail = F.when(F.rlike(path, F.lit(r"(^|/)\.{1,2}$")), "/").otherwise("")
    walked = F.concat(F.lit("/"), F.array_join(kept, "/"), tail)
    full = F.when(F.rlike(path, F.lit(_DOT_SEGMENT)),
                  F.when(F.startswith(walked, F.lit("//")), F.substring(walked, 2, 1 << 30))
                   .otherwise(walked)) \
            .when(F.startswith(path, F.lit("/")), path) \
            .otherwise(F.concat(F.lit("/"), path))
    return F.when(path == "", "").otherwise(full)


def _target(base: Column, ref: Column) -> Column:
    """Merge a parsed reference with its parsed base; paths are not yet normalised."""
    absolute = ref["scheme"] != ""
    network = absolute | (ref["host"] != "") | (ref["userinfo"] != "")
    same_document = ~network & (ref["path"] == "") & (ref["query"] == "")
    merged = F.when(network, ref["path"]) \
              .when(ref["path"] == "", base["path"]) \
              .when(F.startswith(ref["path"], F.lit("/")), ref["path"]) \
              .otherwise(F.concat(F.regexp_extract(base["path"], "(?s)^(.*/)", 1), ref["path"]))
    return F.struct(
        F.when(absolute, ref["scheme"]).otherwise(base["scheme"]).alias("scheme"),
        F.when(network, ref["userinfo"]).otherwise(base["userinfo"]).alias("userinfo"),
        F.when(network, ref["host"]).otherwise(base["host"]).alias("host"),
        F.when(ref["opaque"], ref["path"]).otherwise(remove_dot_segments(merged)).alias("path"),
        F.when(same_document, base["query"]).otherwise(ref["query"]).alias("query"),
        F.when(same_document & (ref["fragment"] == ""), base["fragment"])
         .otherwise(ref["fragment"]).alias("fragment"),
        ref["opaque"].alias("opaque"),
    )


def _render(url: Column) -> Column:
    slashes = F.when((url["host"] != "") | (url["path"] != "") | (url["userinfo"] != ""), "//") \
               .otherwise("")
    hierarchical = F.concat(slashes, url["userinfo"], _escape_host(url["host"]),
                            escape_path(url["path"]))
    # A lone '#' is an empty fragment and is not written.
    fragment = F.when(url["fragment"] == "#", "").otherwise(_escape_fragment(url["fragment"]))
    return F.concat(url["scheme"], F.lit(":"),
                    F.when(url["opaque"], url["path"]).otherwise(hierarchical),
                    url["query"], fragment)


def resolve_all(base: Column, refs: Column) -> Column:
    """Resolve an array of references against one base URL.

    The result holds the http and https targets, distinct, in order of first
    appearance; references that do not parse are dropped, and a base that does
    not parse gives an empty array. Plain references, most of a page, are
    recognised by one pattern; only the others are parsed.
    """
    def resolved(base_parts: Column) -> Column:
        origin = F.concat(base_parts["scheme"], F.lit("://"), base_parts["userinfo"],
                          _escape_host(base_parts["host"]))

        def one(origin: Column, ref: Column) -> Column:
            parsed = let(parse(ref), lambda r: F.when(r.isNotNull(), let(
                _target(base_parts, r),
                lambda t: F.when(t["scheme"].isin("http", "https"), _render(t)))))
            rooted = F.rlike(ref, F.lit(PLAIN_ROOTED)) & base_parts["scheme"].isin("http", "https")
            return F.when(rooted, F.concat(origin, ref)) \
                    .when(F.rlike(ref, F.lit(PLAIN_ABSOLUTE)), ref).otherwise(parsed)

        return let(origin, lambda o: F.transform(F.array_distinct(refs), lambda r: one(o, r)))

    found = let(parse(base), lambda b: F.when(b.isNotNull(), resolved(b)))
    return F.coalesce(F.array_distinct(F.filter(found, lambda u: u.isNotNull())),
                      F.array().cast("array<string>"))


def resolve_url(base: Column, ref: Column) -> Column:
    """Absolute form of ``ref`` seen from ``base`` (any scheme), NULL if either does not parse."""
    return let(parse(base), lambda b: let(parse(ref), lambda r: F.when(
        b.isNotNull() & r.isNotNull(), let(_target(b, r), _render))))
