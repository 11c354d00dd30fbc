"""Text columns: normal forms, phrases, margin keys, citation marks, windows, spans, CSV cells, slugs, shortened excerpts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def squeezed(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(c, "[ \\t\\n\\r]+", " "))




@cache
def _decomposed(apart: bool) -> tuple[str, str, dict[str, str]]:
    """From the compatibility decompositions of all characters beyond ASCII: those that leave one ASCII character, these
    characters, and what the others leave that leave several. What isn't ASCII vanishes; where it parts words, all but marks
    is a space, and marks are characters that leave nothing (at the end of the first text)."""
    one, to, several, marks = [], [], {}, []
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x20000))):
        left = "".join(x if x.isascii() else " " if apart and not unicodedata.combining(x) else "" for x in unicodedata.normalize("NFKD", c))
        if len(left) == 1 and not (apart and left == " "):
            one.append(c)
            to.append(left)
        elif left.strip():
            several[c] = left
        elif apart and not left:
            marks.append(c)
    return "".join(one + marks), "".join(to), several


def _ranges(chars: Iterable[str]) -> str:
    """A character class of these characters."""
    out: list[list[int]] = []
    for x in sorted(map(ord, chars)):
        if out and x == out[-1][1] + 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


def to_ascii(c: Column | str, apart: bool = False) -> Column:
    """Compatibility decompositions without marks, in ASCII; what isn't ASCII then vanishes, or parts words as a space."""
    c = F.col(c) if isinstance(c, str) else c
    one, to, several = _decomposed(apart)
    # Characters that leave several are looked up one by one, in texts that have such only.
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    spelled = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(table[x], x)), "")
    whole = F.when(c.rlike(_ranges(several)), spelled).otherwise(c)
    return F.when(c.rlike("[^\\x00-\\x7f]"), F.regexp_replace(F.translate(whole, one, to), "[^\\x00-\\x7f]", " " if apart else "")).otherwise(c)


#: Fixed value: a page number at either end of a line.
PAGE_NUMBER = "[-–—|·•\\s]*(?:page|p\\.)?\\s*\\d+(?:\\s*(?:/|sur|of|de)\\s*\\d+)?[-–—|·•\\s]*"


def normalised(c: Column | str) -> Column:
    """Lower case without marks, runs of other characters than a-z and 0-9 as one space; letters that don't decompose vanish."""
    return F.trim(F.regexp_replace(F.lower(to_ascii(c)), "[^a-z0-9]+", " "))


def _folded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).replace("\u00ad", "").casefold().split()))


def folded(c: Column | str) -> Column:
    """Compatibility forms composed, soft hyphens removed, case folded, white space as one space: as quotes are compared. Full case folding has no
    column function, so that texts go through Arrow batches."""
    return F.pandas_udf(_folded, "string")(c)


def contains_phrase(text: Column, phrase: str) -> Column:
    """Whether a normalised text has a normalised phrase as whole words."""
    return F.concat(F.lit(" "), text, F.lit(" ")).contains(f" {phrase} ") if phrase else F.lit(False)


def count_phrase(text: Column, phrase: str) -> Column:
    """How often, without overlap (two phrases don't share a space)."""
    padded, p = F.concat(F.lit(" "), text, F.lit(" ")), f" {phrase} "
    return ((F.length(padded) - F.length(F.replace(padded, F.lit(p), F.lit("")))) / len(p)).cast("int") if phrase else F.lit(0)


def mentions(text: Column, norm: Column, term: str) -> Column:
    """2 to 6 capitals or digits are an acronym, sought as written between other characters; other terms are phrases."""
    if re.fullmatch("[A-Z0-9]{2,6}", term):
        return text.rlike(f"(?<![A-Za-z0-9]){term}(?![A-Za-z0-9])")
    return contains_phrase(norm, term.lower())


def margin_key(line: Column | str) -> Column:
    """A line as running headers and footers are compared: lower case, page number at either end removed, '#' if nothing is left."""
    value = F.trim(F.lower(F.regexp_replace(line, "\\s+", " ")))
    value = F.regexp_replace(value, f"(?<=\\D){PAGE_NUMBER}$|^{PAGE_NUMBER}$", "")
    value = F.trim(F.regexp_replace(value, f"^{PAGE_NUMBER}(?=\\D|$)", ""))
    return F.when(value == "", "#").otherwise(value)


def plain(c: Column | str) -> Column:
    """A text without its source markers."""
    return F.regexp_replace(c, "⟦\\d+(,\\d+)*⟧", "")


def references(c: Column | str) -> Column:
    """The references of a text in order: 'E1.2', 'E3' of '[E1.2, E3]'."""
    inside = F.regexp_extract_all(c, F.lit("\\[(E\\d+(?:\\.\\d+)?(?:\\s*[,;]\\s*E\\d+(?:\\.\\d+)?)*)\\]"), 1)
    return F.flatten(F.transform(inside, lambda x: F.transform(F.split(x, "[,;]"), lambda y: F.trim(y))))


def token_set(c: Column | str) -> Column:
    """Distinct words of letters and digits of more than two characters, without marks; letters that don't decompose part words."""
    words = F.split(F.regexp_replace(F.lower(to_ascii(c, apart=True)), "[^a-z0-9]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda x: F.length(x) > 2))


def windows(c: Column | str, size: int) -> Column:
    """Runs of so many words, one after another; an empty text has one empty window."""
    words = F.filter(F.split(c, "\\s+"), lambda x: x != "")
    n = F.greatest(F.lit(1), F.ceil(F.size(words) / size).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(words, i * size + 1, size), " "))


def parsed_spans(c: Column | str, most: int = 20) -> Column:
    """'0-154,155-300' as spans; NULL if a part isn't two numbers in order, or there are more than most."""
    parts = F.split(c, ",")
    good = F.forall(parts, lambda x: x.rlike("^\\d+-\\d+$")) & (F.size(parts) <= most)
    spans = F.transform(parts, lambda x: F.struct(F.split(x, "-")[0].cast("int").alias("start"), F.split(x, "-")[1].cast("int").alias("end")))
    return F.when(good, F.when(F.forall(spans, lambda x: x["start"] < x["end"]), spans))


def client_key(ip: Column) -> Column:
    """An IPv4 address as it is, the /64 network of an IPv6 address in its shortest form, 'unknown' for anything else."""
    quad = "((25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)\\.){3}(25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)"
    # A quad at the end of an IPv6 address is its last two groups.
    v6 = F.lower(F.regexp_replace(ip, f"(?<=:){quad}$", "0:0"))
    part = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    left, right = part(F.substring_index(v6, "::", 1)), F.when(v6.contains("::"), part(F.substring_index(v6, "::", -1))).otherwise(F.array().cast("array<string>"))
    gap = F.lit(8) - F.size(left) - F.size(right)
    groups = F.concat(left, F.array_repeat(F.lit("0"), gap), right)
    group = "[0-9a-f]{1,4}"
    good = v6.rlike(f"^({group}(:{group})*)?::({group}(:{group})*)?$") & (gap >= 1) | v6.rlike(f"^({group}:){{7}}{group}$")
    network = F.array_join(F.transform(F.slice(groups, 1, 4), lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")
    return F.when(good, F.concat(F.regexp_replace(network, "(^|:)0(:0)*$", ""), F.lit("::/64"))).when(ip.rlike(f"^{quad}$"), ip).otherwise("unknown")


def csv_cell(c: Column | str) -> Column:
    """A cell that a spreadsheet would take for a formula gets an apostrophe in front."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def slug(c: Column | str, most: int = 40) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def shortened(c: Column | str, limit: int) -> Column:
    """Squeezed, and cut at the last space before the limit if that is beyond half of it, with an ellipsis."""
    text = squeezed(c)
    head = F.substring(text, 1, limit - 1)
    back = F.locate(" ", F.reverse(head))
    kept = F.when((back > 0) & (limit - 1 - back > limit / 2), F.substring(head, F.lit(1), limit - 1 - back)).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(kept), F.lit("…")))


def paragraphs(c: Column | str) -> Column:
    """The parts of a text between blank lines, trimmed; empty ones go."""
    return F.filter(F.transform(F.split(c, "\\n\\s*\\n"), lambda x: F.regexp_replace(x, "^\\s+|\\s+$", "")), lambda x: x != "")


def fingerprint(kind: Column, country: Column, financiers: Column, years: Column, languages: Column) -> Column:
    """One sentence that tells what a profile looks for; what is missing is said so."""
    by = F.when(F.size(financiers) > 0, F.array_join(financiers, ", ")).otherwise("non précisé")
    return F.concat(
        F.lit("Programme "), kind, F.lit(" en "), F.coalesce(country, F.lit("—")), F.lit(", financé par "), by,
        F.coalesce(F.concat(F.lit(", années "), years), F.lit("")), F.lit(", langues "), F.array_join(F.transform(languages, F.upper), ", "),
    )
