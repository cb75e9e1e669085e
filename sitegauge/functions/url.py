"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def normalize(url: Column) -> Column:
    """Stripped of white space, with https:// in front unless it has http:// or https:// (in lower case)."""
    u = strip(url)
    return F.when(u.startswith("http://") | u.startswith("https://"), u).otherwise(F.concat(F.lit("https://"), u))


def decoded(url: Column) -> Column:
    """A percent-encoded URL from a path, decoded and normalised; a plus sign stays one."""
    return normalize(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))))


def base(url: Column) -> Column:
    """Scheme, user, host and port."""
    return F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)


def well_known(url: Column, path: str) -> Column:
    return F.concat(base(url), F.lit(path))


def with_slash(url: Column) -> Column:
    return F.when(url.endswith("/"), url).otherwise(F.concat(url, F.lit("/")))


def canonical(url: Column) -> Column:
    """For comparing canonical links: slashes at the end go, lower case, and all from the first question mark goes."""
    return F.substring_index(F.lower(F.rtrim(url, F.lit("/"))), "?", 1)


def fetchable(url: Column) -> Column:
    return url.rlike(r"^https?://")


def unquoted(x: Column) -> Column:
    """Percent escapes decoded; what isn't an escape stays as it is."""
    valid = F.regexp_replace(F.replace(x, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(x.contains("%"), F.try_url_decode(valid)).otherwise(x)


def quoted(x: Column) -> Column:
    """Percent escapes for all but letters, digits, slashes and _.-~, so that two spellings of a path compare."""
    out = F.url_encode(x)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def path_of(url: Column) -> Column:
    """What a rule of robots.txt is compared with: all after the host, quoted anew; / if that is empty."""
    path = rule_path(F.regexp_replace(unquoted(url), r"^https?://[^/?#]*", ""))
    return F.when(path == "", "/").otherwise(path)


def rule_path(value: Column) -> Column:
    """A path as rules and URLs are compared: quoted anew, without an empty query at the end."""
    return quoted(F.regexp_replace(value, r"^([^?#]*)[?#]$", "$1"))
