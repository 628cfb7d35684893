"""URL expressions: normal form, origin, host rules and policy; Python only where a host isn't ASCII."""

from __future__ import annotations

import ipaddress
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import strip

#: Hosts of official documentation.
OFFICIAL_DOMAINS = ("developer.apple.com", "developer.mozilla.org", "docs.anthropic.com", "docs.github.com", "docs.python.org", "modelcontextprotocol.io", "swift.org", "typescriptlang.org")
LOCAL_NAMES = ("localhost", "localhost.localdomain")

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
#: What may be an address: only digits and dots, or a colon.
_ADDRESS = r"^[0-9.]+$|:"
_HOST = r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)(?::([0-9]*))?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(strip(url), _URL, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    return _part(url, 2)


def host(url: Column) -> Column:
    """Host in lower case without brackets and the dot at its end; empty if there is none."""
    raw = F.lower(F.regexp_extract(authority(url), _HOST, 1))
    return F.regexp_replace(F.regexp_replace(raw, r"^\[|\]$", ""), r"\.+$", "")


def port(url: Column) -> Column:
    """Port, the scheme's default where none is stated."""
    stated = F.try_to_number(F.regexp_extract(authority(url), _HOST, 2), F.lit("99999")).cast("int")
    return F.coalesce(stated, F.when(scheme(url) == "https", 443).when(scheme(url) == "http", 80))


def problem(url: Column) -> Column:
    """Why a URL can't be normalized: the first rule it breaks, or null."""
    return (
        F.when(url.isNull() | ~scheme(url).isin("http", "https"), "only http and https URLs are supported")
        .when(host(url) == "", "URL host is required")
        .when(F.contains(authority(url), F.lit("@")), "credentials embedded in URLs are not allowed")
    )


def normalize(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, path `/` if empty; null if it can't be. ASCII hosts."""
    name = F.when(F.contains(host(url), F.lit(":")), F.concat(F.lit("["), host(url), F.lit("]"))).otherwise(host(url))
    usual = F.when(scheme(url) == "https", 443).otherwise(80)
    at = F.when(port(url) == usual, name).otherwise(F.concat(name, F.lit(":"), port(url).cast("string")))
    path = F.when(_part(url, 3) == "", "/").otherwise(_part(url, 3))
    query = F.when(_part(url, 4) == "?", "").otherwise(_part(url, 4))
    return F.when(problem(url).isNull(), F.concat(scheme(url), F.lit("://"), at, path, query))


@F.pandas_udf(T.StringType())
def canonical_host(hosts: pd.Series) -> pd.Series:
    """Hosts of any script in their ASCII form, lower case, without the dot at the end; null if there is none."""

    def one(name):
        try:
            return None if name is None else name.rstrip(".").encode("idna").decode("ascii").lower()
        except UnicodeError:
            return None

    return hosts.map(one)


def ascii_url(url: Column) -> Column:
    """The URL with its host in ASCII form; only hosts of other scripts pass through Python. Null if the host has none."""
    name = F.regexp_extract(authority(url), _HOST, 1)
    foreign = name.rlike(r"[^\x00-\x7F]")
    own = canonical_host(F.when(foreign, name))
    return F.when(F.coalesce(foreign, F.lit(False)), F.replace(strip(url), name, own)).otherwise(url)


@F.pandas_udf(T.BooleanType())
def is_public_ip(values: pd.Series) -> pd.Series:
    """Whether an address is global; IPv4 inside IPv6 counts as IPv4. Null for what is no address."""

    def one(value):
        try:
            address = ipaddress.ip_address(value)
        except ValueError:
            return None
        mapped = getattr(address, "ipv4_mapped", None)
        return (mapped or address).is_global

    return values.map(one)


@F.pandas_udf(T.StringType())
def join_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """A reference resolved against its base."""

    def one(b, h):
        try:
            return None if h is None else urljoin(b or "", h)
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)], dtype="object")


def matches_domain(name: Column, domain: Column | str, subdomains: bool = True) -> Column:
    domain = F.lit(domain) if isinstance(domain, str) else domain
    same = name == domain
    return same | F.endswith(name, F.concat(F.lit("."), domain)) if subdomains else same


def _in(name: Column, domains: tuple[str, ...] | list[str], subdomains: bool) -> Column:
    out = F.lit(False)
    for d in domains:
        out = out | matches_domain(name, d, subdomains)
    return out


def source_class(locator: Column, official: tuple[str, ...] = OFFICIAL_DOMAINS) -> Column:
    name = host(locator)
    return F.when(_in(name, official, True), "official-candidate").when(_in(name, ("github.com",), True), "open-source-candidate").otherwise("web-candidate")


def same_origin(a: Column, b: Column) -> Column:
    return (scheme(a) == scheme(b)) & (host(a) == host(b)) & port(a).eqNullSafe(port(b))


def block_reason(url: Column, *, denied=(), allowed=(), subdomains: bool = True, require_https: bool = False, deny_private: bool = True) -> Column:
    """The first rule of the policy that blocks a URL, in the order in which they are tried; null if none does. Hosts that
    are addresses are judged here, other hosts' addresses by `validated`."""
    name = host(url)
    reason = F.when(problem(url).isNotNull(), problem(url))
    if require_https:
        reason = reason.when(scheme(url) != "https", "HTTPS is required")
    reason = reason.when(_in(name, denied, subdomains), "host is not allowed")
    if allowed:
        reason = reason.when(~_in(name, allowed, subdomains), "host is not allowed")
    reason = reason.when(name.isin(*LOCAL_NAMES) | F.endswith(name, F.lit(".local")), "local hostnames are blocked")
    return reason.when(~is_public_ip(F.when(name.rlike(_ADDRESS), name)), "non-public IP targets are blocked") if deny_private else reason


def validated(urls: DataFrame, dns: DataFrame, *, deny_private: bool = True, **policy) -> DataFrame:
    """urls (column url, and any others) with normalized_url, host, block_reason (the first rule that blocks, or null),
    error_code and retryable. dns: host, address (a boundary table).

    The rules are tried in order: form of the URL, HTTPS, domain lists, local names, addresses as hosts, and last the
    addresses of the host: none blocks, and may be tried again; any that isn't public blocks.
    """
    url = F.col("_url")
    rows = urls.withColumn("_url", ascii_url(F.col("url"))).withColumn("_unfit", F.col("url").isNotNull() & url.isNull())
    rows = rows.withColumn("normalized_url", normalize(url)).withColumn("host", F.when(F.col("normalized_url").isNotNull(), host(url)))
    rows = rows.withColumn("_problem", F.when(F.col("_unfit"), "invalid internationalized hostname").otherwise(problem(url)))
    rows = rows.withColumn("_rule", F.when(F.col("_unfit"), F.col("_problem")).otherwise(block_reason(url, deny_private=deny_private, **policy)))
    rows = rows.withColumn("_none", F.lit(False)).withColumn("_private", F.lit(False))
    if deny_private:
        found = dns.groupBy(F.lower("host").alias("host")).agg(F.bool_and(F.coalesce(is_public_ip("address"), F.lit(False))).alias("_public"))
        named = F.col("_rule").isNull() & ~F.col("host").rlike(_ADDRESS)
        rows = rows.drop("_none", "_private").join(found, "host", "left")
        rows = rows.withColumn("_none", named & F.col("_public").isNull()).withColumn("_private", named & ~F.coalesce("_public", F.lit(True)))
    reason = F.coalesce("_rule", F.when(F.col("_none"), "host could not be resolved").when(F.col("_private"), "host resolves to a private address"))
    form = F.col("_problem").isNotNull() & (F.col("_problem") != "credentials embedded in URLs are not allowed")
    code = F.when(form, "invalid_input").when(reason.isNotNull(), "policy_blocked")
    return rows.select(*urls.columns, "normalized_url", "host", reason.alias("block_reason"), code.alias("error_code"), F.coalesce("_none", F.lit(False)).alias("retryable"))


def resolved_reason(urls, dns):
    """block_reason of hosts by their addresses. urls: url, host; dns: host, address (a boundary table).

    A host without an address is blocked and may be tried again; one with any address that isn't public is blocked.
    """
    found = dns.groupBy("host").agg(F.count("address").alias("n"), F.bool_and(F.coalesce(is_public_ip("address"), F.lit(False))).alias("public"))
    rows = urls.join(found, "host", "left")
    none = F.coalesce(F.col("n"), F.lit(0)) == 0
    return rows.select(*urls.columns, F.when(none, "host could not be resolved").when(~F.col("public"), "host resolves to a private address").alias("block_reason"), none.alias("retryable"))


def normalize_any(url: str) -> str | None:
    """Normal form of one URL with a host of any script, for the driver's own arguments."""
    try:
        parts = urlsplit(url.strip())
        number = parts.port
        name = (parts.hostname or "").rstrip(".").encode("idna").decode("ascii").lower() if ":" not in (parts.hostname or "") else parts.hostname
    except (UnicodeError, ValueError):
        return None
    if parts.scheme not in ("http", "https") or not name or "@" in parts.netloc:
        return None
    at = f"[{name}]" if ":" in name else name
    if number not in (None, 443 if parts.scheme == "https" else 80):
        at = f"{at}:{number}"
    return f"{parts.scheme}://{at}{parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def normalize_domains(domains: list[str]) -> list[str]:
    """Domain lists of a policy: lower case, no dots at the ends, each once, sorted."""
    out = {d.strip().lower().strip(".") for d in domains}
    for d in out:
        if not d or "/" in d or ":" in d:
            raise ValueError(f"not a domain: {d!r}")
    return sorted(out)
