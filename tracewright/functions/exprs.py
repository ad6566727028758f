"""Column expressions shared by operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

M, A, C = 2_147_483_648, 1_103_515_245, 12_345


def _multiplier(stream: int) -> int:
    """Another full-period multiplier for each stream, so that streams of one key differ by
    more than a shift."""
    return (A + stream * 276_276_276) % M


def lcg(key: Column, stream: int = 0) -> Column:
    """A repeatable number in [0, 1) from an id: two steps of a linear congruential
    generator, so that neighbouring ids aren't visibly related. Ids beyond the generator's period
    begin elsewhere in it, by how often they have passed it. A null id gives null."""
    k = key.cast("long")
    start = F.pmod(k, F.lit(M)) + F.pmod(F.call_function("div", k - F.pmod(k, F.lit(M)), F.lit(M).cast("long")) * 48_271, F.lit(M))
    one = ((start % M) * _multiplier(stream) + F.lit(stream * C + C)) % M
    return ((one * A + F.lit(C)) % M) / F.lit(float(M))


def lcg_sql(key: str, stream: int = 0) -> str:
    """The same in SQL, for ids from 0."""
    start = f"((({key}) % {M} + ((({key}) // {M}) * 48271) % {M}) % {M})"
    return f"((({start} * {_multiplier(stream)} + {stream * C + C}) % {M} * {A} + {C}) % {M} / {float(M)})"


def hash_partition(key: Column, n: int) -> Column:
    return key % F.lit(n)


def range_partition(key: Column, bounds: list) -> Column:
    """Number of the half-open range that holds key; the last one is open above."""
    out = F.lit(len(bounds))
    for k in range(len(bounds) - 1, -1, -1):
        out = F.when(key < bounds[k], k).otherwise(out)
    return F.when(key.isNotNull(), out)


def list_partition(key: Column, lists: list[list]) -> Column:
    """Number of the list that has key; null if none has."""
    out = F.lit(None).cast("int")
    for k in range(len(lists) - 1, -1, -1):
        out = F.when(key.isin(lists[k]), k).otherwise(out)
    return out


def java_string_hash(s: Column) -> Column:
    """hashCode of an ASCII string: s[0] 31^(n-1) + ... + s[n-1] in 32-bit arithmetic."""
    codes = F.transform(F.split(s, ""), lambda c: F.ascii(c).cast("long"))
    full = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % F.lit(1 << 32))
    return F.when(full >= (1 << 31), full - (1 << 32)).otherwise(full)


def logical_type(native: Column) -> Column:
    """Logical type of a native type's name; null if it has none."""
    n = F.lower(native)
    return (
        F.when(n.rlike("bool"), "boolean").when(n.rlike("char|text|string"), "varchar").when(n.rlike("timestamp|datetime|date"), "datetime")
        .when(n.rlike("numeric|decimal"), "decimal").when(n.rlike("float|double|real"), "real").when(n.rlike("int|long"), "integer")
    )


def null_default(value: Column, kind: str) -> Column:
    """What stands for null in mining, by logical type."""
    zero = {"varchar": "", "boolean": False}.get(kind, 0)
    return F.coalesce(value, F.lit(zero))
