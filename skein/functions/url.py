"""URLs as native Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that name a campaign and no document.
TRACKING = (
    "utm_source utm_medium utm_campaign utm_term utm_content utm_id fbclid gclid dclid msclkid mc_cid mc_eid igshid ref ref_src spm yclid _ga s_kwcid"
).split()

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:@]+)(?::([0-9]*))?([^?#]*)(?:[?]([^#]*))?(?:#.*)?$"


def part(url: Column, index: int) -> Column:
    """Scheme (1), host (2), port (3), path (4) or query (5) of an absolute URL, empty if absent."""
    return F.regexp_extract(F.trim(url), _PARTS, index)


def valid_url(url: Column) -> Column:
    """Whether a URL is absolute http or https with a host."""
    return F.lower(part(url, 1)).isin("http", "https") & (part(url, 2) != "")


def _decode(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, port, user, leading ``www.``, trailing slashes, fragment and tracking parameters.

    Other parameters are sorted and written again form-urlencoded; null unless http or https.
    """
    host = F.regexp_replace(F.lower(part(url, 2)), r"^(?:www\.)+", "")
    path = F.regexp_replace(part(url, 4), "/+$", "")
    pairs = F.transform(
        F.filter(F.split(part(url, 5), "&"), lambda p: p != ""),
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("k"),
            _decode(F.when(F.instr(p, "=") > 0, F.substr(p, F.instr(p, "=") + 1)).otherwise(F.lit(""))).alias("v"),
        ),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~p["k"].isin(*TRACKING)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")
    return F.when(valid_url(url), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def origin(url: Column) -> Column:
    """Scheme, host and port, as robots files are scoped."""
    port = part(url, 3)
    return F.when(valid_url(url), F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), F.when(port != "", F.concat(F.lit(":"), port)).otherwise("")))


def slug_words(url: Column) -> Column:
    """The words of a URL's path and query: over one byte long and not only digits."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"^[^/]*/?", "")
    return F.array_join(F.filter(F.split(rest, "[/_.?&=-]"), lambda w: (F.octet_length(w) > 1) & ~w.rlike("^[0-9]+$")), " ")


def mask_proxy(url: Column) -> Column:
    """User and password of a URL as asterisks."""
    return F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", "$1***@")


def unwrap_redirect(href: Column) -> Column:
    """The target of a result page's redirect link; protocol-relative links become https, others must be http."""
    target = F.regexp_extract(href, r"[?&]uddg=([^&#]*)", 1)
    plain = F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.rlike("^https?://"), href)
    return F.when(target != "", F.try_url_decode(F.replace(target, F.lit("+"), F.lit("%2B")))).otherwise(plain)


def wiki_language(lang: Column) -> Column:
    """A language code fit for a host name: at most twelve of a-z, 0-9 and hyphen; ``en`` if nothing stays."""
    clean = F.substring(F.regexp_replace(F.lower(lang), "[^a-z0-9-]", ""), 1, 12)
    return F.when(F.coalesce(clean, F.lit("")) == "", F.lit("en")).otherwise(clean)


def wiki_url(lang: Column, title: Column) -> Column:
    """The address of an encyclopedia article."""
    path = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for code, char in (("*", "%2A"), ("%2F", "/"), ("%3A", ":")):
        path = F.replace(path, F.lit(code), F.lit(char))
    return F.concat(F.lit("https://"), wiki_language(lang), F.lit(".wikipedia.org/wiki/"), path)


def internal_host(url: Column) -> Column:
    """Whether a URL's host is local, private or reserved (names, IPv4 and the common IPv6 forms)."""
    bracketed = F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#@]*@)?\[([0-9A-Fa-f:.]+)\]", 1)
    host = F.regexp_replace(F.lower(F.when(bracketed != "", bracketed).otherwise(part(url, 2))), r"\.$", "")
    names = host.rlike(r"^localhost$|\.localhost$|\.internal$|^internal$")
    v4 = F.regexp_replace(host, "^::ffff:", "")
    four = v4.rlike(
        r"^(?:127\.|10\.|192\.168\.|169\.254\.|0\.0\.0\.0$|255\.255\.255\.255$|192\.0\.2\.|198\.51\.100\.|203\.0\.113\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)"
    ) & v4.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")
    six = (bracketed != "") & host.rlike(r"^(?:::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)$")
    return names | four | six
