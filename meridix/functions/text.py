"""Column functions for text, URLs and identifiers; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal suffixes that a company name is compared without, and two-label public suffixes.
LEGAL_SUFFIXES = ("inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "plc")
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "com.br", "com.mx", "co.in", "co.jp", "com.sg", "com.hk")


def collapse(c: Column) -> Column:
    """White space runs (Unicode) to one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def host(url: Column) -> Column:
    """Lower-case host of a URL with a scheme; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _authority(url: Column) -> Column:
    """The host of a URL, or of a text without a scheme, as it is spelled."""
    return F.regexp_extract(F.when(url.contains("://"), url).otherwise(F.concat(F.lit("//"), url)), r"^(?:[^:/?#]+:)?//(?:[^/?#]*@)?([^/?#:]*)", 1)


def domain(value: Column) -> Column:
    """Lower-case host without a final dot; www stays."""
    return F.regexp_replace(_authority(F.lower(collapse(value))), r"\.+$", "")


def bare_host(value: Column) -> Column:
    """Lower-case host without a final dot and without www."""
    return F.regexp_replace(F.regexp_replace(_authority(F.lower(F.trim(value))), r"\.+$", ""), r"^www\.", "")


def plausible_host(value: Column) -> Column:
    """What a syntax check of a domain looks at: no scheme, path, port or final dot."""
    bare = F.regexp_replace(F.lower(F.trim(value)), "^[^:]*://", "")
    return F.regexp_replace(F.substring_index(F.substring_index(bare, "/", 1), ":", 1), r"\.+$", "")


def registrable_domain(h: Column) -> Column:
    """The last two labels of a host, or three below a two-label public suffix."""
    return F.when(F.substring_index(h, ".", -2).isin(*TWO_LABEL_SUFFIXES), F.substring_index(h, ".", -3)).otherwise(F.substring_index(h, ".", -2))


def email(value: Column) -> Column:
    """White space collapsed, and what follows the last @ in lower case."""
    flat = collapse(value)
    return F.when(flat.contains("@"), F.concat(F.regexp_extract(flat, "^(.*)@[^@]*$", 1), F.lit("@"), F.lower(F.substring_index(flat, "@", -1)))).otherwise(flat)


def phone(value: Column) -> Column:
    """Digits only, after a leading plus."""
    compact = F.regexp_replace(collapse(value), r"[\s().-]+", "")
    return F.concat(F.when(compact.startswith("+"), "+").otherwise(""), F.regexp_replace(compact, "[^0-9]", ""))


def canonical_url(value: Column) -> Column:
    """Scheme and host in lower case, user and query kept, no default port, no fragment, no trailing slash but the root's."""
    flat = collapse(value)
    part = lambda pattern: F.regexp_extract(flat, pattern, 1)
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*://"
    head = F.concat(F.lower(part(f"({scheme})")), part(scheme + "([^/?#]*@)"), F.lower(part(scheme + "(?:[^/?#]*@)?([^/?#]*)")))
    head = F.regexp_replace(F.regexp_replace(head, "^(http://.*):80$", "$1"), "^(https://.*):443$", "$1")
    path = part(scheme + "[^/?#]*([^?#]*)")
    whole = F.concat(head, F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", "")), part(r"^[^?#]*(\?[^#]*)"))
    return F.when(flat.rlike(scheme), whole).otherwise(F.regexp_replace(flat, "/+$", ""))


def profile_url(value: Column) -> Column:
    """The canonical address of a public profile, null for other pages; of the query only the locale stays."""
    raw = F.trim(value)
    raw = F.when(raw.startswith("http://") | raw.startswith("https://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    locale = F.regexp_extract(raw, "[?&]locale=([^&#]+)", 1)
    made = F.concat(F.lit("https://www.linkedin.com/in/"), F.regexp_extract(raw, "/in/([^/?#]+)", 1), F.when(locale != "", F.concat(F.lit("?locale="), locale)).otherwise(""))
    return F.when(raw.rlike(r"^https?://(?i:www\.)?(?i:linkedin\.com)/in/[^/?#]+/?(?:[?#]|$)"), made)


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no default port, no trailing slash but the root's."""
    bare = F.regexp_replace(url, r"#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    head = F.regexp_replace(head, r"^(http://[^/]*):80$|^(https://[^/]*):443$", "$1$2")
    return F.concat(head, F.regexp_replace(F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", ""), r"(.)/+$", "$1"))


def name_tokens(name: Column) -> Column:
    """Distinct lower-case alphanumeric tokens of a name without legal suffixes, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda t: (t != "") & ~t.isin(*LEGAL_SUFFIXES)))


def normalized_name(name: Column) -> Column:
    """Lower-case alphanumeric tokens of a name without legal suffixes, joined by spaces."""
    return F.array_join(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda t: (t != "") & ~t.isin(*LEGAL_SUFFIXES)), " ")


def prefixed_id(prefix: str, *parts: Column, length: int = 40) -> Column:
    """A deterministic id: the prefix and the first hex digits of a SHA-256 over the parts, joined by bars."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length))


def stable_bucket(key: Column, buckets: int = 10_000) -> Column:
    """The first 64 bits of the key's SHA-256, modulo the number of buckets."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)") % buckets).cast("int")


def decimal(c: Column, digits: int) -> Column:
    """Rounded half up, as an exact decimal."""
    return F.round(c, digits).cast(f"decimal(18,{digits})")


def emails(text: Column) -> Column:
    """The e-mail addresses of a text in lower case, distinct and sorted."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))
