"""Predicates on indicators: hashes, domains, addresses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of digests (hexadecimal of the usual lengths, TLSH, TELFHASH, SSDEEP) and of domain names.
HASH = r"^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|T[12][0-9A-Fa-f]{70}|[a-z0-9]{70}|\d+:[A-Za-z0-9+/=]+:[A-Za-z0-9+/=]+)$"
DOMAIN = r"^(?:[A-Za-z0-9_](?:[A-Za-z0-9_-]{0,61}[A-Za-z0-9_])?\.)+[A-Za-z]{2,63}$"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
# IPv4 ranges that are not global, as first address and prefix length; and the exceptions within.
NOT_GLOBAL = (("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4))
GLOBAL_WITHIN = ("192.0.0.9", "192.0.0.10")


def is_hash(x: Column) -> Column:
    return x.rlike(HASH)


def is_domain(x: Column) -> Column:
    return (F.length(x) <= 253) & ~x.contains("\n") & x.rlike(DOMAIN)


def _number(ip: str) -> int:
    a, b, c, d = map(int, ip.split("."))
    return a << 24 | b << 16 | c << 8 | d


def ipv4_number(x: Column) -> Column:
    """The address as a number, or null."""
    parts = F.split(F.when(x.rlike(IPV4), x), r"\.")
    return sum((F.get(parts, k).cast("long") * (1 << 8 * (3 - k)) for k in range(4)), F.lit(0))


def is_external_ipv4(x: Column) -> Column:
    """Whether it is an IPv4 address of the global internet (multicast counts)."""
    n = ipv4_number(x)
    local = F.lit(False)
    for first, bits in NOT_GLOBAL:
        a = _number(first)
        local = local | n.between(a, a + (1 << 32 - bits) - 1)
    return F.coalesce(n.isNotNull() & (~local | x.isin(*GLOBAL_WITHIN)), F.lit(False))


def is_external_ip(x: Column) -> Column:
    """The same with IPv6, by the standard library on Arrow batches; for columns that may hold either."""
    @F.pandas_udf("boolean")
    def outside(values: pd.Series) -> pd.Series:
        import ipaddress

        def one(v):
            try:
                return ipaddress.ip_address(v).is_global
            except ValueError:
                return False

        return values.map(one)

    return F.when(x.contains(":"), outside(x)).otherwise(is_external_ipv4(x))


def clean_ip(x: Column) -> Column:
    """Null for the placeholders that stand for no address."""
    t = F.trim(x)
    return F.when(~t.isin("", "-", "LOCAL", "::"), t)
