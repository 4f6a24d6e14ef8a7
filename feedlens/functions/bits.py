"""Command flags, access categories and key-spec flags as bit masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlens.functions.rows import let

# A name's bit is its place in its list.
FLAGS = """
admin allow_busy asking blocking denyoom fast loading module movablekeys no_async_loading no_auth no_mandatory_keys no_multi noscript
pubsub readonly skip_monitor skip_slowlog stale write
""".split()
FLAG_ALIASES = {"ro": "readonly", "wo": "write"}
CATEGORIES = """
@admin @bitmap @blocking @connection @dangerous @fast @geo @hash @hyperloglog @keyspace @list @pubsub @read @scripting @set @slow
@sortedset @stream @string @transaction @write
""".split()
KEY_SPEC_FLAGS = "rw ro ow rm access insert update delete incomplete not_key variable_flags".split()


def bits_of(names: list[str], aliases: dict[str, str] | None = None) -> dict[str, int]:
    """Name to bit; aliases share the bit of their name."""
    own = {n: 1 << i for i, n in enumerate(names)}
    return own | {a: own[n] for a, n in (aliases or {}).items()}


FLAG_BITS = bits_of(FLAGS, FLAG_ALIASES)
CATEGORY_BITS = bits_of(CATEGORIES)
KEY_SPEC_BITS = bits_of(KEY_SPEC_FLAGS)


def lower_ascii(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def fold(names: Column, bits: dict[str, int]) -> Column:
    """OR of the bits of an array of names; case and surrounding blanks do not matter, unknown names count nothing."""
    table = F.create_map(*[F.lit(x) for pair in bits.items() for x in pair])
    known = F.transform(names, lambda n: F.coalesce(table[F.lower(F.trim(n))], F.lit(0)))
    return F.aggregate(F.coalesce(known, F.array().cast("array<int>")), F.lit(0), lambda a, b: a.bitwiseOR(b))


def mask(names: list[str], bits: dict[str, int]) -> int:
    """As fold(), of a list."""
    return reduce(lambda a, n: a | bits.get(n.strip().lower(), 0), names, 0)


def names_of(mask: Column, bits: dict[str, int]) -> Column:
    """Sorted names of the bits of a mask, aliases too.

    The mask is computed once a row: the optimizer would copy its expression into the test, which runs once a name.
    """
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(b).alias("bit")) for n, b in sorted(bits.items())])
    return let(mask, lambda m: F.transform(F.filter(table, lambda x: m.bitwiseAND(x["bit"]) != 0), lambda x: x["name"]))


def parse_masks(values: list[str]) -> tuple[int, int]:
    """(flags, categories) that option values name: comma lists, `@` marks a category; unknown names are dropped."""
    tokens = [t.strip().lower() for v in values for t in v.split(",")]
    take = lambda bits: reduce(lambda a, t: a | bits.get(t, 0), tokens, 0)
    return take(FLAG_BITS), take(CATEGORY_BITS)


def holds(flags: Column, categories: Column, masks: tuple[int, int]) -> Column:
    """Whether all bits of both masks are set; a mask without bits asks nothing."""
    tests = [(c.bitwiseAND(F.lit(m)) == m) for c, m in zip((flags, categories), masks, strict=True) if m]
    return reduce(lambda a, b: a & b, tests, F.lit(True))
