"""URL identity and allow-lists."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from tidewire.functions.sql import captures, case, each, fold, fresh, keep, let, lit, sql_function
from tidewire.functions.text import group1, matches, replaced, strip, strip_chars, unescape

# Query parameters that only track a visitor.  Any name that
# starts with "utm_" is one as well.
TRACKING_PARAMETERS = (
    "_ga", "_gl", "_hsenc", "_hsmi", "dclid", "fbclid", "gclid",
    "mc_cid", "mc_eid", "mkt_tok", "msclkid", "vero_conv", "vero_id",
)

# Messages of rejected links.
NOT_AN_ARTICLE = "link is not an article HTTP(S) URL"
NOT_VALID = "link is not a valid HTTP(S) URL"
HOST_NOT_ALLOWED = "link host is not allowed: "

# The generic URI grammar of RFC 3986, appendix B.
_URI = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_PORT = r"^(?:\[[^\]]*\]|[^:\[\]]*):(.*)$"
_BRACKETED = r"^\[(?:[0-9A-Fa-f]*:[0-9A-Fa-f:.]*(?:%[^\]]*)?|v[0-9A-Fa-f]+\.[^\]]+)\](?::.*)?$"
_CONTROL = "".join(chr(c) for c in range(0x21))
_BAD_ESCAPE = "%(?![0-9A-Fa-f]{2})"


class Url:
    """Names of the parts of a parsed URL; absent parts are ``''``."""

    def __init__(self, p: str) -> None:
        self.scheme = f"{p}.scheme"
        self.authority = f"{p}.authority"  # with the leading slashes
        self.path = f"{p}.path"
        self.query = f"{p}.query"
        self.fragment = f"{p}.fragment"
        self.place = f"{p}.place"  # host[:port]
        self.host = f"{p}.host"
        self.port_text = f"{p}.port_text"
        self.has_userinfo = f"contains({self.authority}, '@')"
        #: NULL when there is no port or it is no number.
        self.port = f"(CASE WHEN {matches(self.port_text, '^[0-9]+$')} THEN try_cast({self.port_text} AS BIGINT) END)"
        self.port_ok = f"({self.port_text} = '' OR coalesce({self.port} <= 65535, false))"
        #: An IPv6 literal is either absent or alone in its brackets.
        self.brackets_ok = f"(NOT {matches(self.authority, r'[\[\]]')} OR {matches(self.place, _BRACKETED)})"


def url_parts(c: str) -> str:
    """The parts of a URL text as a struct for :class:`Url`."""
    broken = " OR ".join(f"contains({c}, {lit(line)})" for line in "\t\r\n")
    clean = f"ltrim({lit(_CONTROL)}, if({broken}, translate({c}, {lit(chr(9) + chr(13) + chr(10))}, ''), {c}))"

    def placed(p: str) -> str:
        def hosted(place: str) -> str:
            host = case(
                (f"startswith({place}, '[')", group1(place, r"^\[([^\]]*)")),
                default=f"substring_index({place}, ':', 1)",
            )
            port = f"if(contains({place}, ':'), {group1(place, _PORT)}, '')"
            return (
                f"named_struct('scheme', lower({p}[0]), 'authority', {p}[1], 'path', {p}[2],"
                f" 'query', {p}[3], 'fragment', {p}[4], 'place', {place},"
                f" 'host', lower({host}), 'port_text', {port})"
            )

        return let(f"substring_index(substr({p}[1], 3), '@', -1)", hosted)

    return let(captures(clean, _URI, 5), placed)


def with_url(c: str, body: Callable[[Url], str]) -> str:
    """Parse a URL text once and compute ``body`` from its parts."""
    return let(url_parts(c), lambda p: body(Url(p)))


def before_fragment(c: str) -> str:
    return f"substring_index({c}, '#', 1)"


# --------------------------------------------------------------------------
# Canonical form
# --------------------------------------------------------------------------


def _decoded(c: str) -> str:
    """Percent-decoding where a malformed escape stays as it is."""
    return f"url_decode({replaced(c, _BAD_ESCAPE, '%25')})"


def _encoded(c: str) -> str:
    """Form encoding with the unreserved set of RFC 3986 (Java keeps ``*``, not ``~``)."""
    return f"replace(replace(url_encode({c}), '*', '%2A'), '%7E', '~')"


def canonical_query(query: str) -> str:
    """Parameters without trackers, sorted by (name, value) and re-encoded."""
    pairs = each(
        keep(f"split({query}, '&')", lambda p: f"{p} <> ''"),
        lambda p: "named_struct('name', {0}, 'value', {1})".format(
            _decoded(f"substring_index({p}, '=', 1)"),
            case((f"contains({p}, '=')", _decoded(group1(p, r"(?s)^[^=]*=(.*)$"))), default="''"),
        ),
    )
    trackers = ", ".join(lit(n) for n in TRACKING_PARAMETERS)
    kept = keep(
        pairs, lambda p: f"NOT (startswith(lower({p}.name), 'utm_') OR lower({p}.name) IN ({trackers}))"
    )
    encoded = each(
        f"array_sort({kept})", lambda p: f"concat({_encoded(p + '.name')}, '=', {_encoded(p + '.value')})"
    )
    return f"array_join({encoded}, '&')"


@sql_function
def canonical_url(c: str) -> str:
    """The form of a URL by which the same article is recognised everywhere.

    Lower-case scheme and host, no user info, default port, tracking parameter
    or fragment, sorted query.  Path and percent-escapes in it are kept.  Text
    that is no absolute URL is only cut at the fragment.
    """

    def absolute(u: Url) -> str:
        host = let(
            f"rtrim('.', {u.host})",
            lambda h: case((f"contains({h}, ':')", f"concat('[', {h}, ']')"), default=h),
        )
        default_port = (
            f"({u.scheme} = 'http' AND {u.port} = 80) OR ({u.scheme} = 'https' AND {u.port} = 443)"
        )
        port = case(
            (f"{u.port} IS NULL OR {default_port}", "''"), default=f"concat(':', string({u.port}))"
        )
        query = let(
            canonical_query(u.query), lambda q: case((f"{q} = ''", "''"), default=f"concat('?', {q})")
        )
        return case(
            (
                f"{u.scheme} <> '' AND {u.host} <> '' AND {u.brackets_ok} AND {u.port_ok}",
                f"concat({u.scheme}, '://', {host}, {port}, if({u.path} = '', '/', {u.path}),"
                f" if({u.query} = '', '', {query}))",
            )
        )

    return let(strip(c), lambda t: f"coalesce({with_url(t, absolute)}, {before_fragment(t)})")


@sql_function
def host_of(c: str) -> str:
    return with_url(strip(c), lambda u: f"rtrim('.', {u.host})")


# --------------------------------------------------------------------------
# Resolving
# --------------------------------------------------------------------------


def _merged_path(base_path: str, path: str) -> str:
    """Relative path against a base path, dot segments folded."""
    base_dir = replaced(base_path, "[^/]+$", "")
    whole = f"if(startswith({path}, '/'), {path}, concat({base_dir}, {path}))"

    def folded(segments: str) -> str:
        s, i = fresh(), fresh("i")
        inner = (
            f"filter({segments}, ({s}, {i}) -> {s} <> '' OR {i} = 0 OR {i} = size({segments}) - 1)"
        )
        kept = fold(
            inner,
            "cast(array() AS array<string>)",
            lambda acc, s: case(
                (f"{s} = '..'", f"slice({acc}, 1, greatest(size({acc}) - 1, 0))"),
                (f"{s} = '.'", acc),
                default=f"concat({acc}, array({s}))",
            ),
        )
        ending = f"if(element_at({segments}, -1) IN ('.', '..'), '/', '')"
        return f"concat(array_join({kept}, '/'), {ending})"

    return let(
        whole,
        # Nothing to fold in the usual case.
        lambda full: case(
            (f"NOT {matches(full, r'(?:^|/)\.{1,2}(?:/|$)|//|^[^/]')}", full),
            default=let(
                let(f"split({full}, '/')", folded),
                lambda p: f"if(startswith({p}, '/'), {p}, concat('/', {p}))",
            ),
        ),
    )


@sql_function
def resolve(base: str, target: str) -> str:
    """Join a link target with the page URL; NULL when either has broken brackets."""
    return with_url(base, lambda b: resolve_from(base, b, target))


def resolve_from(base: str, parts: Url, target: str) -> str:
    """The same with the page URL parsed before."""

    def tail(query: str, fragment: str) -> str:
        return (
            f"concat(if({query} = '', '', concat('?', {query})),"
            f" if({fragment} = '', '', concat('#', {fragment})))"
        )

    def joined(t: str, b: Url, u: Url) -> str:
        own = f"concat({u.authority}, {u.path}, {tail(u.query, u.fragment)})"
        same_page = (
            f"concat({b.authority}, {b.path},"
            f" {tail(f'if({u.query} = {lit('')}, {b.query}, {u.query})', u.fragment)})"
        )
        below = f"concat({b.authority}, {_merged_path(b.path, u.path)}, {tail(u.query, u.fragment)})"
        rest = case((f"{u.authority} NOT IN ('', '//')", own), (f"{u.path} = ''", same_page), default=below)
        return case(
            (f"NOT ({b.brackets_ok} AND {u.brackets_ok})", "NULL"),
            (f"{t} = ''", base),
            (f"{u.scheme} <> '' AND {u.scheme} <> {b.scheme}", t),
            default=f"concat({b.scheme}, ':', {rest})",
        )

    return let(target, lambda t: with_url(t, lambda u: joined(t, parts, u)))


@sql_function
def issue_url(base: str, target: str) -> str:
    """Where a bad entry pointed to; unresolvable text is kept whole, so that two of them stay apart."""
    return f"coalesce({resolve(base, target)}, {target})"


# --------------------------------------------------------------------------
# Allow-lists
# --------------------------------------------------------------------------


@sql_function
def host_allowed(host: str, allowed: str) -> str:
    """The host itself or a subdomain of an allowed one."""
    a = fresh()
    return f"exists({allowed}, {a} -> {host} = {a} OR endswith({host}, concat('.', {a})))"


def link_value(target: str) -> str:
    """A link target as it is resolved: references replaced, without blanks and angle brackets around it."""
    return strip_chars(unescape(strip(target)), "<>")


def checked_link(value: str, url: str, allowed: str) -> str:
    """Check a :func:`link_value` that was resolved to ``url``: ``struct<url, error>`` with one of them NULL."""

    def checked(value: str, url: str, u: Url) -> str:
        def error(host: str) -> str:
            valid = (
                f"{url} IS NOT NULL AND {u.port_ok} AND {u.scheme} IN ('http', 'https') AND {host} <> ''"
                f" AND NOT {u.has_userinfo} AND ({u.port_text} = '' OR {u.port} >= 1)"
            )
            return case(
                (f"{value} = '' OR startswith({value}, '#')", lit(NOT_AN_ARTICLE)),
                (f"NOT coalesce({valid}, false)", lit(NOT_VALID)),
                (f"NOT {host_allowed(host, allowed)}", f"concat({lit(HOST_NOT_ALLOWED)}, {host})"),
            )

        return let(
            let(f"rtrim('.', {u.host})", error),
            lambda e: f"named_struct('url', if({e} IS NULL, {url}, NULL), 'error', {e})",
        )

    return with_url(url, lambda u: checked(value, url, u))


@sql_function
def item_link(target: str, base: str, allowed: str) -> str:
    """Check a link of a list page: ``struct<url, error>`` with one of them NULL."""
    return let(
        link_value(target),
        lambda value: let(resolve(base, value), lambda url: checked_link(value, url, allowed)),
    )


@sql_function
def article_link(c: str, allowed: str) -> str:
    """Stricter check for fetching an article: HTTPS on an allowed host, no user info.

    Returns the URL without its fragment, NULL when it may not be fetched.
    """
    return with_url(
        c,
        lambda u: case(
            (
                f"{u.brackets_ok} AND {u.port_ok} AND {u.scheme} = 'https' AND NOT {u.has_userinfo}"
                f" AND {host_allowed(u.host, allowed)}",
                before_fragment(c),
            )
        ),
    )


def checked_hosts(hosts: Iterable[str]) -> list[str]:
    """Validate an allow-list given by a user: plain host names, at least one."""
    if isinstance(hosts, str) or not hosts:
        raise ValueError("allowed hosts must be a non-empty collection of host names")
    label = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
    result = []
    for host in hosts:
        name = host.strip().lower() if isinstance(host, str) else ""
        if len(name) > 253 or not re.fullmatch(rf"{label}(?:\.{label})*", name):
            raise ValueError(f"not a host name: {host!r}")
        result.append(name)
    return result
