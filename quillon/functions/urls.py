"""URLs: canonical form, safety of a target, hosts and paths."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parameters that only track, and names that are never public.
TRACKING = ("gclid", "fbclid", "mc_cid", "mc_eid", "msclkid", "igshid", "_ga", "yclid", "dclid")
TRACKING_PREFIX = "utm_"
PRIVATE_NAMES = ("localhost", "metadata", "metadata.google.internal")
PRIVATE_SUFFIXES = (".localhost", ".local", ".internal", ".lan", ".home.arpa", ".corp")

_PARTS = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def part(url: Column, k: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query; empty where there is none."""
    return F.regexp_extract(url, _PARTS, k)


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), "^.*@", ""), r":\d*$", ""))


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, without default port, fragment and tracking parameters; the rest as it is. Null without scheme or host, or with credentials."""
    scheme, authority = F.lower(part(url, 1)), F.lower(part(url, 2))
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    name = F.regexp_replace(authority, r":\d*$", "")
    keys = lambda s: F.lower(F.substring_index(s, "=", 1))
    query = F.array_join(F.filter(F.split(part(url, 4), "&"), lambda s: (s != "") & ~keys(s).isin(*TRACKING) & ~keys(s).startswith(TRACKING_PREFIX)), "&")
    path = F.when(part(url, 3) == "", "/").otherwise(part(url, 3))
    made = F.concat(scheme, F.lit("://"), name, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when((name != "") & ~F.contains(authority, F.lit("@")), made)


def secure(url: Column) -> Column:
    return F.regexp_replace(url, "(?i)^http:", "https:")


@F.pandas_udf(T.BooleanType())
def _public_ip(s: pd.Series) -> pd.Series:
    def one(name):
        try:
            return ipaddress.ip_address(name.strip("[]")).is_global
        except ValueError:
            return None

    return s.map(one, na_action="ignore").astype("object")


def within(url: Column, domains: Column, prefixes: Column) -> Column:
    """Whether a URL's host is one of the domains (``*.`` before one for its subdomains) and its path begins with one of the prefixes; false if either list is null."""
    name, path = host(url), F.when(part(url, 3) == "", "/").otherwise(part(url, 3))
    hosted = F.exists(domains, lambda d: (name == F.lower(d)) | (d.startswith("*.") & name.endswith(F.lower(F.substring(d, 2, 2**30)))))
    return F.coalesce(hosted & F.exists(prefixes, lambda p: path.startswith(p)), F.lit(False))


def refusal(url: Column, allowed: list[tuple[str, str]] | None = None) -> Column:
    """Why a URL may not be fetched: scheme, credentials, host, port, private, not_allowed; null if it may. allowed: (domain, path prefix), ``*.`` before a domain for its subdomains."""
    name, authority = host(url), part(url, 2)
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    path = F.when(part(url, 3) == "", "/").otherwise(part(url, 3))
    private = name.isin(*PRIVATE_NAMES)
    for suffix in PRIVATE_SUFFIXES:
        private |= name.endswith(suffix)
    looks_ip = name.rlike(r"^\[|^\d{1,3}(\.\d{1,3}){3}$")
    inside = F.lit(allowed is None)
    for domain, prefix in allowed or []:
        inside |= (name.endswith(domain[1:].lower()) if domain.startswith("*.") else name == domain.lower()) & path.startswith(prefix)
    return (
        F.when(~F.lower(part(url, 1)).isin("http", "https") | url.isNull(), "scheme")
        .when(F.contains(authority, F.lit("@")), "credentials")
        .when(name == "", "host")
        .when((port != "") & ~port.isin("80", "443"), "port")
        .when(private | (~F.contains(name, F.lit(".")) & ~looks_ip) | (looks_ip & ~F.coalesce(_public_ip(F.when(looks_ip, name)), F.lit(False))), "private")
        .when(~inside, "not_allowed")
    )
