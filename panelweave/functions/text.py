"""Text as column expressions: clean, cut, match. All of them stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    """White space of any script at both ends goes."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def literals(values: Iterable[str]) -> Column:
    """An array literal; an empty one keeps its type."""
    values = list(values)
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def any_of(patterns: Sequence[str]) -> str:
    """One pattern for many: a text is scanned once."""
    return "|".join(f"(?:{p})" for p in patterns) or r"(?!)"


def any_literal(terms: Sequence[str]) -> str:
    return any_of([re.escape(t) for t in terms])


def unescape(c: Column) -> Column:
    for name, plain in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(plain))
    return c


def lines(c: Column) -> Column:
    """Stripped lines that aren't empty."""
    return F.filter(F.transform(F.split(c, LINE_BREAK), strip), lambda x: x != "")


def markup_to_text(c: Column) -> Column:
    """Scripts, styles, comments and tags go, tags become line breaks, blank lines go."""
    for p in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->"):
        c = F.regexp_replace(c, p, "")
    return F.array_join(lines(unescape(F.regexp_replace(c, r"<[^>]+>", "\n"))), "\n")


def paragraphs(c: Column, least: int = 30, most: int = 2000) -> Column:
    """Stripped lines of `least` characters or more; longer ones than `most` are cut into pieces of it."""
    kept = F.filter(F.transform(F.split(c, LINE_BREAK), strip), lambda x: F.length(x) >= least)
    pieces = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / most).cast("int")), lambda k: strip(F.substring(x, k * most + 1, F.lit(most))))
    return F.filter(F.flatten(F.transform(kept, pieces)), lambda x: F.length(x) >= least)


KOREAN_SENTENCE_END = r"(?<=[다요임음함됨])\.\s+(?=[가-힣A-Za-z(①②③])"


def sentences(c: Column, pattern: str = KOREAN_SENTENCE_END, least: int = 15) -> Column:
    """Sentences, where a piece of fewer than `least` characters joins the one before it; never empty."""
    pieces = F.filter(F.transform(F.split(c, pattern), strip), lambda x: x != "")
    join = lambda out, x: F.when((F.size(out) > 0) & (F.length(x) < least), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat_ws(" ", F.element_at(out, -1), x)))).otherwise(F.concat(out, F.array(x)))
    # the last of the list is only read where there is one
    got = F.aggregate(pieces, F.array().cast("array<string>"), join)
    return F.when(F.size(got) > 0, got).otherwise(F.array(c))


def strict_sentences(c: Column, least: int = 15, pattern: str = r"(?<=다\.)\s+") -> Column:
    """Sentences of `least` characters or more; shorter ones go."""
    return F.filter(F.transform(F.split(c, pattern), strip), lambda x: F.length(x) >= least)


def matched(c: Column, terms: Sequence[str]) -> Column:
    """Terms that occur in the text, in list order."""
    return F.filter(literals(terms), lambda t: F.contains(c, t))


def has_any(c: Column, terms: Sequence[str]) -> Column:
    return F.exists(literals(terms), lambda t: F.contains(c, t))


def boilerplate_ratio(c: Column, terms: Sequence[str]) -> Column:
    """Share of the words that contain a term; 0 without words."""
    words = F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    hits = F.size(F.filter(words, lambda w: has_any(w, terms)))
    return F.coalesce(F.try_divide(hits.cast("double"), F.size(words).cast("double")), F.lit(0.0))


def number_mode(c: Column, mode: str, units: Sequence[str]) -> Column:
    """remove_all: numbers become a space. keep_quantity: numbers before a unit become [NUM] first. Else nothing."""
    if mode == "keep_quantity":
        c = F.regexp_replace(c, rf"(?U)\d+(?:\.\d+)?\s*({any_literal(units)})", "[NUM]$1")
    return F.regexp_replace(c, r"(?U)\d+", " ") if mode in ("remove_all", "keep_quantity") else c


def name_variants(name: str, legacy: bool = False) -> list[str]:
    """A company's name with and without its legal form; the longest first, or the bare name first as older results have it."""
    forms = [name, f"(주){name}", f"{name}(주)", f"㈜{name}", f"주식회사 {name}"]
    return forms if legacy else sorted(forms, key=len, reverse=True)


def remove_names(c: Column, names: Sequence[str], legacy: bool = False) -> Column:
    for name in names:
        for form in name_variants(name, legacy):
            c = F.replace(c, F.lit(form), F.lit(""))
    return c


def drop_lines(c: Column, patterns: Sequence[str]) -> Column:
    """Lines that match none of the patterns; blank lines stay."""
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~x.rlike(any_of(patterns))), "\n")


def dropped_lines(c: Column, patterns: Sequence[str]) -> Column:
    return F.filter(F.split(c, "\n"), lambda x: x.rlike(any_of(patterns)))


def zfill(c: Column, width: int) -> Column:
    """Zeros on the left; longer values stay whole."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def words(c: Column, least: int = 2) -> Column:
    """Lower-case runs of at least `least` letters: the tokenizer that needs no dictionary.

    Split at what is no letter: several times as fast as extracting match by match.
    """
    return F.filter(F.split(F.lower(c), r"\P{L}+"), lambda t: F.length(t) >= least)


def words_and_compounds(c: Column, compounds: Sequence[str], pattern: str = r"\p{L}{2,}") -> Column:
    """words(), but a listed compound stays one token; the longest wins."""
    listed = sorted((x.lower() for x in compounds), key=lambda x: (-len(x), x))
    # what a token is gets a mark behind it, all else becomes marks
    marked = F.regexp_replace(F.lower(F.replace(c, F.lit("\x00"), F.lit(" "))), "(?s)(" + "|".join([*map(re.escape, listed), pattern]) + ")|.", "$1\x00")
    return F.filter(F.split(marked, "\x00"), lambda t: t != "")
