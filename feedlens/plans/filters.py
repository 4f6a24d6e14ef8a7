"""Command filters: patterns by name, flags and categories, as one boolean expression."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlens.functions import bits
from feedlens.functions import lines as L

#: What the two regex dialects do not share: look-around, back-references, possessive and atomic groups.
_UNSHARED = re.compile(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k<|[*+?}]\+")


@dataclass(frozen=True)
class Pattern:
    text: str
    regex: bool
    exclude: bool

    @classmethod
    def parse(cls, value: str) -> Pattern:
        """A leading ! excludes; /.../ is a regular expression, anything else a literal."""
        exclude = value.startswith("!")
        body = value[1:] if exclude else value
        regex = len(body) >= 2 and body[0] == body[-1] == "/"
        text = body[1:-1] if regex else body
        if regex:
            if _UNSHARED.search(text):
                raise ValueError(f"unsupported regular expression: {text}")
            java(text)
        return cls(text, regex, exclude)


def java(pattern: str) -> str:
    """A linear-time regular expression in Java's spelling: named groups and POSIX classes."""
    pattern = re.sub(r"\(\?P<", "(?<", pattern)
    pattern = re.sub(r"\[:(\^?)(alpha|digit|alnum|upper|lower|punct|space|xdigit|cntrl|graph|print|blank):\]", lambda m: ("\\P{" if m[1] else "\\p{") + {"xdigit": "XDigit"}.get(m[2], m[2].capitalize()) + "}", pattern)
    try:
        re.compile(re.sub(r"\\[pP]\{\w+\}", "x", pattern).replace("(?<", "(?P<"))
    except re.error as e:
        raise ValueError(f"invalid regular expression: {e}") from e
    return pattern


#: Literals up to which they are simply listed.
FEW = 8
#: Forks of a prefix tree that may stand within each other; what would go deeper is listed.
FORKS = 60


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_])", r"\\\1", text)


def _minimal(words: set[str]) -> list[str]:
    """Words that hold no other one: who has one of these has one of all. Each word's own parts are looked up."""
    sizes = sorted({len(w) for w in words})
    holds = lambda w: any(w[i : i + n] in words for n in sizes if n <= len(w) for i in range(len(w) - n + 1) if n < len(w))
    return sorted(w for w in words if not holds(w))


def _tree(words: list[str], at: int = 0, forks: int = 0) -> str:
    """A regular expression of sorted words none of which begins another: shared beginnings are looked at once."""
    if len(words) == 1:
        return _quoted(words[0][at:])
    if forks >= FORKS:
        return "(?:" + "|".join(_quoted(w[at:]) for w in words) + ")"
    first, last, end = words[0], words[-1], at
    while first[end] == last[end]:
        end += 1
    groups = [list(g) for _, g in itertools.groupby(words, key=lambda w: w[end])]
    ends = [g[0][end] for g in groups if len(g) == 1 and len(g[0]) == end + 1]
    parts = [_tree(g, end, forks + 1) for g in groups if len(g) > 1 or len(g[0]) > end + 1]
    return _quoted(first[at:end]) + "(?:" + "|".join(([f"[{''.join(map(_quoted, ends))}]"] if ends else []) + parts) + ")"


def literals(texts: list[str]) -> str:
    """A regular expression for any of the texts, in any ASCII case, in names whose characters are bytes.

    Thousands of them cost little more than one: they become a prefix tree, which a name walks from each of its
    places, and those that hold another one are left out.
    """
    words = {bits.lower_ascii(t).encode().decode("latin-1") for t in texts}
    if "" in words:
        return ""
    return "(?i)" + ("(?:" + "|".join(map(_quoted, sorted(words))) + ")" if len(words) <= FEW else _tree(_minimal(words)))


def _any(patterns: list[Pattern], name: Column) -> Column | None:
    """Whether a name matches any pattern: literals anywhere and in any ASCII case, expressions anywhere as they are."""
    texts = [p.text for p in patterns if not p.regex]
    tests = [name.rlike(literals(texts))] if texts else []
    tests += [name.rlike(java(p.text)) for p in patterns if p.regex]
    return reduce(lambda a, b: a | b, tests) if tests else None


@dataclass(frozen=True)
class LineFilter:
    """What a line must meet; patterns with one text count once on each side, the first one stays."""

    include: tuple[Pattern, ...] = ()
    exclude: tuple[Pattern, ...] = ()
    masks: tuple[int, int] = (0, 0)
    db: int | None = None

    @classmethod
    def of(cls, patterns: list[str] = (), flags: list[str] = (), db: int | None = None) -> LineFilter:
        sides: dict[bool, dict[str, Pattern]] = {False: {}, True: {}}
        for p in map(Pattern.parse, patterns):
            sides[p.exclude].setdefault(p.text, p)
        return cls(tuple(sides[False].values()), tuple(sides[True].values()), bits.parse_masks(list(flags)), db)

    @property
    def needs_metadata(self) -> bool:
        return self.masks != (0, 0)

    @property
    def empty(self) -> bool:
        return not (self.include or self.exclude or self.needs_metadata or self.db is not None)

    def names(self, name: Column) -> Column:
        """Excluded names fail; without includes others pass, else one include must match."""
        out, inc, exc = F.lit(True), _any(list(self.include), name), _any(list(self.exclude), name)
        if inc is not None:
            out = inc
        return out & ~exc if exc is not None else out

    def column(self, metadata: bool = False) -> Column:
        """The test of a line. Lines without a command pass; so do unknown commands, as far as flags go."""
        if self.empty:
            return F.lit(True)
        test = self.names(L.command(F.col("line"))) if self.include or self.exclude else F.lit(True)
        if metadata and self.needs_metadata:
            test = test & F.coalesce(bits.holds(F.col("cmd_flags"), F.col("cmd_categories"), self.masks), F.lit(True))
        test = F.coalesce(test, F.lit(True))
        if self.db is not None:
            own = F.regexp_extract(L.chars(F.col("line")), r"\A[0-9]+\.[0-9]+[ \t]*\[0*([0-9]+)", 1)
            test = test & ((own == str(self.db)) | (own == ""))
        return test


def matches(name: str | None, patterns: list[str]) -> bool:
    """The name test on one string, for messages and tests."""
    f = LineFilter.of(patterns)
    if name is None:
        return True
    hit = lambda p: bool(re.search(p.text, name)) if p.regex else bits.lower_ascii(p.text) in bits.lower_ascii(name)
    return not any(map(hit, f.exclude)) and (not f.include or any(map(hit, f.include)))
