"""URL expressions. A rejected URL is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HUB_HOST = "medium.com"  # the one host whose first path segment names the author

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scheme(url) -> Column:
    return F.lower(F.regexp_extract(_c(url), _PARTS, 1))


def netloc(url) -> Column:
    return F.regexp_extract(_c(url), _PARTS, 2)


def path(url) -> Column:
    return F.regexp_extract(_c(url), _PARTS, 3)


def last_segment(url) -> Column:
    return F.regexp_extract(F.rtrim(path(url), F.lit("/")), r"([^/]*)$", 1)


def _percent_decoded(c: Column) -> Column:
    """Percent-decoding that leaves '+' alone and keeps the text when it is not valid encoding."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def _capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))


def slug_title(url) -> Column:
    """Index title: decoded slug without its hex id, first letter upper, the rest kept."""
    last = _percent_decoded(last_segment(url))
    text = F.trim(F.replace(F.regexp_replace(last, r"-?[0-9a-f]{8,12}$", ""), F.lit("-"), F.lit(" ")))
    return F.concat(F.upper(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))


def guess_title(url) -> Column:
    """Library title: slug without "-hexid", capitalised; the URL itself when empty."""
    text = F.trim(F.replace(F.regexp_replace(last_segment(url), r"-[0-9a-f]{8,14}$", ""), F.lit("-"), F.lit(" ")))
    return F.when(text == "", _c(url)).otherwise(_capital(text))


def title_from_url(url) -> Column:
    """Bulk-import title: decoded slug without a hex id in any case, white space squeezed, capitalised."""
    last = F.regexp_replace(_percent_decoded(last_segment(url)), r"(?i)-?[0-9a-f]{8,14}$", "")
    return _capital(F.trim(F.regexp_replace(F.replace(last, F.lit("-"), F.lit(" ")), r"\s+", " ")))


def author_of(url, hub_host: str = HUB_HOST) -> Column:
    first = _percent_decoded(F.regexp_extract(F.trim(path(url), F.lit("/")), r"^([^/]*)", 1))
    return F.when(netloc(url) != hub_host, F.regexp_extract(netloc(url), r"^([^.]*)", 1)).otherwise(
        F.when(first == "p", F.lit("")).otherwise(first)
    )


def normalize_url(url) -> Column:
    """https by default; no credentials, query, fragment or trailing slash; other schemes and odd hosts are null."""
    raw = F.trim(_c(url))
    has_http = raw.rlike(r"(?i)^https?://")
    other_scheme = raw.rlike(r"(?i)^[a-z][a-z0-9+.-]*:")
    full = F.when(has_http, raw).when(~other_scheme, F.concat(F.lit("https://"), raw))
    hostport = F.regexp_extract(netloc(full), r"([^@]*)$", 1)
    host = F.regexp_replace(hostport, r":[^:]*$", "")
    ok = host.contains(".") & host.rlike(r"(?i)^[a-z0-9.-]+$")
    return F.when(ok, F.concat(scheme(full), F.lit("://"), F.lower(hostport), F.rtrim(path(full), F.lit("/"))))


def canonical(url) -> Column:
    """Lowercase scheme and host, no query, fragment or trailing slash; not http(s) or dotless host is null."""
    ok = scheme(url).isin("http", "https") & netloc(url).contains(".")
    return F.when(ok, F.concat(scheme(url), F.lit("://"), F.lower(netloc(url)), F.rtrim(path(url), F.lit("/"))))


def article_id(url) -> Column:
    return F.substring(F.sha1(_c(url)), 1, 12)


def paper_id(doi) -> Column:
    return F.substring(F.sha2(F.lower(_c(doi)), 256), 1, 16)


def normalize_doi(text) -> Column:
    found = F.regexp_extract(F.trim(F.coalesce(_c(text), F.lit(""))), r"(?i)(10\.\d{4,9}/[^\s\"'<>]+)", 1)
    return F.when(found != "", F.lower(F.rtrim(found, F.lit(".,;)]}>"))))


def source_of(url, hub_host: str = HUB_HOST) -> Column:
    """Display host; for the hub host, host plus first path segment; '' when there is no URL."""
    host = F.lower(F.regexp_extract(netloc(url), r"([^@:]*)(?::\d+)?$", 1))
    first = F.regexp_extract(path(url), r"^/([^/]*)", 1)
    return F.when(host == hub_host, F.concat(F.lit(hub_host + "/"), first)).otherwise(host)


def is_external(url) -> Column:
    """A link to a publisher rather than to the redirecting service or its asset hosts."""
    host = F.lower(F.regexp_extract(_c(url), r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return (host != "") & ~host.rlike(r"(google\.com|gstatic\.com|ggpht\.com)$")


def decode_redirect(url) -> Column:
    """First external link inside the base64 path segment of a redirect URL, else null."""
    seg = F.translate(F.regexp_extract(path(url), r"/(?:articles|read)/([A-Za-z0-9_\-]+)", 1), "-_", "+/")
    body = seg.substr(F.lit(1), F.length(seg) - F.when(F.length(seg) % 4 == 1, 1).otherwise(0))
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))
    blob = F.decode(F.try_to_binary(padded, F.lit("base64")), "ISO-8859-1")
    found = F.regexp_extract_all(blob, F.lit("https?://[^\\x00-\\x20\"'\\\\]+"), F.lit(0))
    return F.get(F.filter(found, is_external), F.lit(0))


def resolve_redirect(url, redirect_host: str = "news.google.com") -> Column:
    """The publisher URL behind a redirect when it can be decoded offline, else the URL unchanged."""
    host = F.lower(F.regexp_extract(netloc(url), r"([^@:]*)(?::\d+)?$", 1))
    return F.when(host.endswith(redirect_host), F.coalesce(decode_redirect(url), _c(url))).otherwise(_c(url))
