"""Scalar rules of an object store as Column builders."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def common_prefix(key: Column, prefix: str, delimiter: str) -> Column:
    """The key up to and with the delimiter that ends its segment below the prefix; null for a direct child."""
    depth = prefix.count(delimiter) + 1
    cut = F.split(key, re.escape(delimiter), -1)
    return F.when(F.size(cut) > depth, F.concat(F.array_join(F.slice(cut, 1, depth), delimiter), F.lit(delimiter)))


def max_keys(asked: Column) -> Column:
    """Page size: what cannot be read, is not positive or is over 1000 becomes 1000."""
    n = asked.try_cast("int")
    return F.when(n.between(1, 1000), n).otherwise(1000)


def storage_class(value: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("STANDARD"))


def version_order(version_id: Column) -> Column:
    """Sort key of version ids: the null version sorts as the empty string."""
    return F.coalesce(F.nullif(version_id, F.lit("null")), F.lit(""))


def next_midnight(created: Column, days: Column) -> Column:
    """First midnight strictly after created + days."""
    return F.date_trunc("DAY", created + F.make_dt_interval(days)).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")


def valid_bucket_name(name: Column) -> Column:
    label = r"[a-z0-9]([a-z0-9-]*[a-z0-9])?"
    return (
        F.length(name).between(3, 63)
        & name.rlike(rf"^{label}(\.{label})*$")
        & ~name.rlike(r"^\d+\.\d+\.\d+\.\d+$")
        & ~name.rlike(r"^(xn--|sthree-)|(-s3alias|--ol-s3)$|--")
    )


def valid_object_key(key: Column) -> Column:
    return F.octet_length(key).between(1, 1024)


def valid_tags(tags: Column) -> Column:
    """At most ten tags, keys of 1 to 128 and values of up to 256 characters."""
    return (
        (F.size(tags) <= 10)
        & F.forall(F.map_keys(tags), lambda k: F.length(k).between(1, 128))
        & F.forall(F.map_values(tags), lambda v: F.length(v) <= 256)
    )


def parse_tagging(header: Column) -> Column:
    """URL query string to a map; null where a key repeats."""
    pairs = F.filter(F.split(header, "&"), lambda p: p != "")
    decode = lambda s: F.try_url_decode(s)
    entries = F.transform(pairs, lambda p: F.struct(decode(F.substring_index(p, "=", 1)).alias("k"), F.when(p.contains("="), decode(F.substr(p, F.instr(p, "=") + 1))).otherwise("").alias("v")))
    keys = F.transform(entries, lambda e: e["k"])
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_entries(entries))


def wildcard_match(pattern: Column, value: Column) -> Column:
    """One * in the pattern stands for any run; the parts around it must not overlap."""
    head, tail = F.substring_index(pattern, "*", 1), F.substring_index(pattern, "*", -1)
    return F.when(pattern.contains("*"), F.startswith(value, head) & F.endswith(value, tail) & (F.length(value) >= F.length(head) + F.length(tail))).otherwise(pattern == value)


def event_matches(pattern: Column, name: Column) -> Column:
    """A trailing :* stands for any event of the family."""
    return F.when(pattern.endswith(":*"), F.startswith(name, F.substr(pattern, F.lit(1), F.length(pattern) - 1))).otherwise(pattern == name)


def backoff_seconds(attempts: Column, least: int = 1, most: int = 300) -> Column:
    return F.least(F.lit(least) * F.pow(F.lit(2.0), attempts - 1), F.lit(float(most))).cast("long")


def byte_range(header: Column, size: Column) -> Column:
    """struct(start, end exclusive) of a Range header within an object; null where it cannot be satisfied."""
    first = F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 1).try_cast("long")
    last = F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 2).try_cast("long")
    start = F.when(first.isNull(), F.greatest(size - last, F.lit(0))).otherwise(first)
    end = F.when(first.isNull() | last.isNull(), size).otherwise(F.least(last + 1, size))
    return F.when(header.rlike(r"^bytes=(\d+-\d*|-\d+)$") & (start < end), F.struct(start.alias("start"), end.alias("end")))


def if_match(etag: Column, condition: Column) -> Column:
    """If-Match holds: no condition, *, or the same ETag."""
    return condition.isNull() | (condition == "*") & etag.isNotNull() | F.coalesce(condition == etag, F.lit(False))


def if_none_match(etag: Column, condition: Column) -> Column:
    """If-None-Match holds: no condition, * and no object, or another ETag."""
    return condition.isNull() | F.when(condition == "*", etag.isNull()).otherwise(F.coalesce(condition != etag, F.lit(True)))


def byte_ranges(header: Column, size: Column) -> Column:
    """The satisfiable ranges of a Range header with several ones, in the order asked; null where the header is no such list."""
    each = F.transform(F.split(F.regexp_extract(header, r"^bytes=(.*)$", 1), ","), lambda r: byte_range(F.concat(F.lit("bytes="), F.trim(r)), size))
    return F.when(header.rlike(r"^bytes=\s*(\d+-\d*|-\d+)\s*(,\s*(\d+-\d*|-\d+)\s*)*$"), F.filter(each, lambda r: r.isNotNull()))


def http_date(at: Column) -> Column:
    return F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def rfc3339(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def forwarded_client(remote: Column, forwarded: Column, trusted: list[str]) -> Column:
    """The client's address: the last X-Forwarded-For entry that is no trusted proxy, where the peer is one; else the peer's."""
    is_trusted = lambda ip: F.coalesce(functools.reduce(lambda a, b: a | b, [in_cidr(ip, F.lit(c)) for c in trusted], F.lit(False)), F.lit(False))
    hops = F.transform(F.filter(F.split(F.coalesce(forwarded, F.lit("")), ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x))
    foreign = F.filter(hops, lambda ip: ~is_trusted(ip))
    return F.when(is_trusted(remote), F.coalesce(F.try_element_at(foreign, F.lit(-1)), F.get(hops, F.lit(0)), remote)).otherwise(remote)


def copy_allowed(etag: Column, modified: Column, match: Column, none_match: Column, modified_since: Column, unmodified_since: Column) -> Column:
    """Copy-source conditions; times count in whole seconds, and a matching ETag settles If-Unmodified-Since."""
    at = F.date_trunc("SECOND", modified)
    return (
        F.coalesce(F.when(match.isNotNull(), match == etag), F.lit(True))
        & F.coalesce(F.when(none_match.isNotNull(), none_match != etag), F.lit(True))
        & (modified_since.isNull() | (at > modified_since))
        & (match.isNotNull() | unmodified_since.isNull() | (at <= unmodified_since))
    )


def in_cidr(ip: Column, cidr: Column) -> Column:
    """Is the IPv4 address in the network; integer masks, no user function."""

    def number(x: Column) -> Column:
        octets = F.split(x, r"\.")
        return sum((F.get(octets, F.lit(i)).cast("long") * (1 << 8 * (3 - i)) for i in range(4)), F.lit(0).cast("long"))

    bits = F.substring_index(cidr, "/", -1).cast("int")
    hosts = F.pow(F.lit(2.0), 32 - bits)
    return F.floor(number(ip) / hosts) == F.floor(number(F.substring_index(cidr, "/", 1)) / hosts)


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """{name} placeholders replaced by values."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def read_only(operation: Column, writes: Iterable[str] = ("Put", "Delete", "Create", "Complete", "Abort", "Upload", "Copy", "Append", "Transition")) -> Column:
    """Does the operation only read."""
    return ~operation.rlike("^(" + "|".join(writes) + ")")


def ulid_time_ms(ulid: Column) -> Column:
    """Milliseconds since the epoch from the first ten characters of a ULID."""
    alphabet = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
    digits = [F.position(F.substring(F.upper(ulid), i, 1), F.lit(alphabet)) - 1 for i in range(1, 11)]
    return sum((d.cast("long") * (1 << 5 * (10 - i)) for i, d in enumerate(digits, 1)), F.lit(0).cast("long"))
