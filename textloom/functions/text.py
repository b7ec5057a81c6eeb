"""Text column functions with Python's notion of white space."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that Python's str.split and str.strip take as white space.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same characters one by one.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: First and last code point of each script's block.
SCRIPTS = {
    "si": (r"\u0D80", r"\u0DFF"),
    "ta": (r"\u0B80", r"\u0BFF"),
    "devanagari": (r"\u0900", r"\u097F"),
    "bengali": (r"\u0980", r"\u09FF"),
    "gurmukhi": (r"\u0A00", r"\u0A7F"),
    "gujarati": (r"\u0A80", r"\u0AFF"),
    "oriya": (r"\u0B00", r"\u0B7F"),
    "telugu": (r"\u0C00", r"\u0C7F"),
    "kannada": (r"\u0C80", r"\u0CFF"),
    "malayalam": (r"\u0D00", r"\u0D7F"),
}
#: The numerals that are read.
ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV", "XVI", "XVII", "XVIII", "XIX", "XX"]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once, also where ``use`` has it in functions of array elements."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(f: Callable[..., Column]) -> Callable[..., Column]:
    """f with its first argument computed once: chains of functions that use their text several times don't multiply."""

    @wraps(f)
    def bound(text: Column, *args, **kwargs) -> Column:
        return let(text, lambda t: f(t, *args, **kwargs))

    return bound


@once
def rounded(number: Column, digits: int = 6) -> Column:
    """number rounded in doubles as SQL engines on doubles do it: scaled, halves away from zero, the sign kept where zero is left."""
    return let(F.abs(number) * 10.0**digits, lambda a: let(F.rint(a), lambda r: F.signum(number) * (r + (a - r == 0.5).cast("int")) / 10.0**digits))


def strip(c: Column | str) -> Column:
    return F.btrim(c, F.lit(SPACES))


def words(c: Column | str) -> Column:
    """The words of str.split(); none for an empty text."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def collapse(c: Column | str) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.array_join(words(c), " ")


def script_class(names: list[str]) -> str:
    return "[" + "".join(f"{a}-{b}" for a, b in (SCRIPTS[n] for n in names)) + "]"


def has_script(c: Column | str, name: str) -> Column:
    return F.col(c).rlike(script_class([name])) if isinstance(c, str) else c.rlike(script_class([name]))


def class_ratio(c: Column | str, char_class: str) -> Column:
    """Share of a text's characters in a regex class; 0 for an empty text."""
    n = F.length(c)
    return (n - F.length(F.regexp_replace(c, char_class, ""))) / F.greatest(n, F.lit(1))


def contains_any(c: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts], F.lit(False))


def matches_any(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns], F.lit(False))


def first_of(*cols: Column) -> Column:
    """First value that is neither null nor empty (as a chain of Python's ``or``)."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements in order; later ones see what earlier ones wrote."""
    return reduce(lambda a, p: F.replace(a, F.lit(p[0]), F.lit(p[1])), pairs, c)


def safe_name(c: Column | str) -> Column:
    return F.regexp_replace(c, r"(?U)[^\w]", "_")


def roman_value(c: Column) -> Column:
    """1 to 20 of a Roman numeral; null otherwise."""
    table = F.create_map(*[F.lit(x) for i, r in enumerate(ROMAN, 1) for x in (r, i)])
    return F.try_element_at(table, F.upper(c))


def prefix_key(c: Column | str, n: int = 200) -> Column:
    return F.substring(c, 1, n)


def prefix_digest(c: Column | str) -> Column:
    """64 characters in place of a prefix: equal where prefixes are."""
    return F.sha2(prefix_key(c).cast("binary"), 256)
