"""Web addresses: identity, canonical form, site names."""

from __future__ import annotations

from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Query parameters that never tell two pages apart.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid")
_PORTS = {"http": 80, "https": 443}


def identity(address: str | None) -> str | None:
    """The form by which addresses are compared; None if there is none (blank, or a port that is no number)."""
    if address is None or not address.strip():
        return None
    try:
        split = urlsplit(address.strip())
        port = split.port
    except ValueError:
        return None
    scheme = split.scheme.lower()
    host = (split.hostname or "").lower()
    if port and port != _PORTS.get(scheme):
        host += f":{port}"
    pairs = [p for p in parse_qsl(split.query) if p[0].lower() not in TRACKING]
    return urlunsplit((scheme, host, split.path.rstrip("/") or "/", urlencode(pairs), ""))


@F.pandas_udf(StringType())
def normalize_url(address: pd.Series) -> pd.Series:
    """Exact parsing and re-encoding of queries has no built-in; null where an address is invalid."""
    return address.map(identity, na_action=None)


def http_only(normalized: Column) -> Column:
    """A normalized address if it is http(s) with a host, else null."""
    return F.when(normalized.rlike("^https?://[^/]"), normalized)


def canonical_url(address: Column) -> Column:
    """Without query, fragment and closing slashes."""
    return F.regexp_replace(F.regexp_replace(F.trim(address), "[?#].*$", ""), "/+$", "")


def site_name(address: Column, fallback: Column | None = None) -> Column:
    """Host (with port) in lower case; else ``fallback`` or the address itself."""
    host = F.lower(F.regexp_extract(address, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.coalesce(F.nullif(host, F.lit("")), fallback if fallback is not None else address)


def redirected_to_error(address: Column, final: Column) -> Column:
    """The final address differs and has a filled ``error`` parameter."""
    return F.coalesce((address != final) & final.rlike("[?&]error=[^&#]"), F.lit(False))


def authority(address: Column) -> Column:
    """Host with user and port as it is written; null where an address names none."""
    return F.nullif(F.regexp_extract(address, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit(""))


def source_of_followup(address: Column) -> Column:
    """What stands between the second and the third slash of an address with a scheme, else the address."""
    return F.when(address.contains("://"), F.get(F.split(address, "/"), F.lit(2))).otherwise(address)


def source_of_page(address: Column, final: Column, title: Column) -> Column:
    """Host of the final address (else the address), else the title, else the address."""
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(authority(F.coalesce(filled(final), address)), filled(title), address)


def source_of_file(address: Column, final: Column, title: Column) -> Column:
    """As :func:`source_of_page`, but a file is called by its name without its ending, and any other address without a host by its scheme."""
    filled = lambda c: F.nullif(c, F.lit(""))
    end = F.coalesce(filled(final), address)
    scheme, path = filled(F.lower(F.regexp_extract(end, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))), F.regexp_extract(end, "^[A-Za-z][A-Za-z0-9+.-]*:([^?#]*)", 1)
    name = F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)
    # A percent sign that begins no code stays as it is.
    stem = F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name), "(?<=.)\\.[^.]*$", "")
    return F.coalesce(authority(end), F.when((scheme == "file") & (path != ""), stem), scheme, filled(title), address)
