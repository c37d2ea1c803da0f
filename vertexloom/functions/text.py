"""Cleaning of names, addresses and paths as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values that stand for nothing.
JUNK = ("", "-", "na", "n/a", "null", "none", "unknown", "::1", "127.0.0.1", "localhost")
#: Formats in which log times are written, tried in order; ``XXX`` takes Z and offsets, and a weekday before the month is dropped first.
TIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd't'HH:mm:ss", "MMM dd HH:mm:ss zzz yyyy",
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "MM/dd/yyyy HH:mm:ss", "dd/MMM/yyyy:HH:mm:ss Z", "yyyy-MM-dd",
)
#: Fixed order of the properties that name a vertex.
NATURAL_KEYS = ("hostname", "ip", "emailSubject", "userName", "URL", "fileName")
_QUAD = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_QUAD}(\.{_QUAD}){{3}}$"
IPV6 = r"^(?=.*:.*:)(?!.*::.*::)(?!.*:::)(:|[0-9A-Fa-f]{1,4})?(:[0-9A-Fa-f]{0,4}){1,7}$"


def clean(value: Column) -> Column:
    """Without dollar signs, quotes, backslashes and anything beyond printable ASCII."""
    return F.regexp_replace(F.translate(value, "$'\"\\", ""), r"[^\x20-\x7E\t\n\r]", "")


def is_junk(value: Column, junk: Sequence[str] = JUNK) -> Column:
    return value.isNull() | F.lower(F.trim(value)).isin(*junk)


def ip_kind(value: Column) -> Column:
    """``ipv4``, ``ipv6`` or ``NA``."""
    return F.when(value.rlike(IPV4), "ipv4").when(value.rlike(IPV6), "ipv6").otherwise("NA")


def recipients(value: Column) -> Column:
    """Semicolon-separated names as an array."""
    return F.split(F.coalesce(value, F.lit("")), ";")


def windows_user(value: Column, domain: str = "ACME") -> Column:
    """Names without dollar signs and their domain, lower-cased, as an array."""
    return F.split(F.lower(F.regexp_replace(F.translate(F.coalesce(value, F.lit("")), "$", ""), rf"(?i){domain}\\", "")), ";")


def sysmon_user(value: Column, domain: str = "ACME") -> Column:
    """As :func:`windows_user`, without percent signs."""
    return windows_user(F.translate(value, "%", ""), domain)


def normal_user(value: Column, domain: str = "acme") -> Column:
    """A user without dollar signs and the domain before or behind the name, lower-cased."""
    return F.regexp_replace(F.lower(F.translate(value, "$", "")), rf"^{domain}\\|@{domain}\.com$", "")


def base_names(value: Column, separator: str = "/") -> Column:
    """Last parts of comma-separated paths, lower-cased, as an array."""
    return F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda p: F.lower(F.element_at(F.split(p, f"\\Q{separator}\\E"), -1)))


def file_names(value: Column) -> Column:
    """As :func:`base_names`, both kinds of slashes parting a path."""
    return F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda p: F.lower(F.regexp_extract(p, r"([^/\\\\]*)$", 1)))


def dir_name(value: Column) -> Column:
    """A path without its last part; empty if there is no slash."""
    return F.when(value.contains("/"), F.regexp_replace(value, "/[^/]*$", "")).otherwise("")


def first_token(value: Column) -> Column:
    return F.split(value, " ")[0]


def without_domain(value: Column) -> Column:
    r"""``DOMAIN\user`` as ``user``."""
    return F.element_at(F.split(F.coalesce(value, F.lit("")), r"\\"), -1)


def log_time(value: Column, formats: Sequence[str] = TIME_FORMATS) -> Column:
    """A time in the first of the formats that fits; null if none does."""
    plain = F.regexp_replace(value, "^[A-Z][a-z]{2} (?=[A-Z][a-z]{2} )", "")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in formats])


#: Functions that mappings may name; each takes columns and gives a string or an array of strings.
REGISTRY: dict[str, Callable[..., Column]] = {
    "recipients": recipients,
    "windows_user": windows_user,
    "sysmon_user": sysmon_user,
    "base_names": base_names,
    "file_names": file_names,
    "dir_name": dir_name,
    "first_token": first_token,
    "without_domain": without_domain,
    "clean": clean,
}


def register(name: str, function: Callable[..., Column]) -> None:
    """Make a column function known to mappings."""
    REGISTRY[name] = function
