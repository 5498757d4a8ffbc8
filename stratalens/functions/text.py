"""Text functions as columns: all run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tokens longer than this aren't indexed.
LONGEST_TOKEN = 40


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def collapse_space(c: Column) -> Column:
    """White space (Unicode) becomes single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_tag(c: Column) -> Column:
    """A tag's canonical value; null where nothing is left."""
    return F.nullif(F.lower(collapse_space(c)), F.lit(""))


def tag_key(value: Column) -> Column:
    """The digest that tags are ordered by."""
    raw = value.cast("binary")
    return F.sha2(F.concat(F.lit("tag-v1|").cast("binary"), F.lpad(F.hex(F.octet_length(value)), 16, "0").cast("binary"), raw), 256)


def contains_any(text: Column, cues: list[str]) -> Column:
    """Whether any cue is a substring, A-Z and a-z being alike."""
    low = ascii_lower(text)
    lower = lambda s: "".join(_LOWER[_UPPER.index(x)] if x in _UPPER else x for x in s)
    return reduce(lambda a, b: a | b, (low.contains(lower(c)) for c in cues), F.lit(False))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, over-long ones left out."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: (F.length(t) > 0) & (F.octet_length(t) < LONGEST_TOKEN))


def _lines(text: Column, keep) -> Column:
    return F.array_join(F.filter(F.split(text, "\n", -1), keep), "\n")


def is_heading(line: Column) -> Column:
    return F.trim(line).rlike(r"^#{1,6}( |$)")


def without_headings(text: Column) -> Column:
    return _lines(text, lambda x: ~is_heading(x))


def without_marked_lines(text: Column) -> Column:
    """Rerank text: if there is any angle bracket, lines with one go."""
    return F.when(text.rlike("[<>]"), _lines(text, lambda x: ~x.rlike("[<>]"))).otherwise(text)


def canonical_text(text: Column) -> Column:
    """Comments out, line ends unified, blanks at line ends and repeated or final empty lines gone."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), r"\r\n?", "\n")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(plain, r"^\n{2,}", "\n"), r"\n+$", "")


def escape_attribute(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))


def serialize_document(title: Column, tags: Column, body: Column) -> Column:
    """A heading, one element for each tag, and the body, with empty lines between."""
    marks = F.array_join(F.transform(tags, lambda t: F.concat(F.lit('<Tag value="'), escape_attribute(t), F.lit('" />'))), "\n")
    parts = F.array(F.concat(F.lit("# "), F.trim(title)), F.nullif(marks, F.lit("")), F.nullif(F.trim(body), F.lit("")))
    return F.concat(F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n\n"), F.lit("\n"))


def joined_view(*parts: Column) -> Column:
    """Non-empty parts (title, section path, match, neighbours) on lines of their own."""
    return F.concat_ws("\n", *(F.nullif(p, F.lit("")) for p in parts))


def fingerprint(domain: str, *parts: Column) -> Column:
    """SHA-256 over a domain and length-prefixed parts: no two lists of parts run together."""
    sized = [F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.sha2(F.concat(F.lit(domain + "|"), *sized), 256)


def redacted(label: str, c: Column) -> Column:
    """A label, the length and the hash of a text: nothing of the text itself."""
    return F.concat(F.lit(label + ":"), F.octet_length(c).cast("string"), F.lit(":"), F.substring(F.sha2(c, 256), 1, 16))


#: Words that point at what only the conversation shows.
DEICTIC = ("I", "me", "my", "you", "your")


def deictic_words(text: Column) -> Column:
    """The deictic words that a text has as words."""
    return F.array_intersect(F.array(*(F.lit(w) for w in DEICTIC)), F.split(text, r"[^\p{L}\p{N}]+"))


#: The alphabet of base 32, the start and factor of the 32-bit hash.
BASE32, FNV_START, FNV_FACTOR = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 2_166_136_261, 16_777_619


def base32(hexadecimal: Column) -> Column:
    """Hexadecimal digits as base 32 without padding: five bits a character, zeros at the end."""
    bits = F.array_join(F.transform(F.filter(F.split(hexadecimal, ""), lambda c: c != ""), lambda c: F.lpad(F.conv(c, 16, 2), 4, "0")), "")
    whole = F.rpad(bits, ((F.length(bits) + 4) / 5).cast("int") * 5, "0")
    fives = F.transform(F.sequence(F.lit(0), (F.length(whole) / 5).cast("int") - 1), lambda i: F.substring(F.lit(BASE32), F.conv(F.substring(whole, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1)))
    return F.when(F.length(hexadecimal) > 0, F.array_join(fives, "")).otherwise("")


def from_base32(text: Column) -> Column:
    """The hexadecimal digits (lower case) of base 32; null where it isn't base 32."""
    bits = F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.lpad(F.conv(F.instr(F.lit(BASE32), c) - 1, 10, 2), 5, "0")), "")
    size = (F.length(bits) / 8).cast("int") * 2
    digits = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.lower(F.conv(F.substring(bits, i * 4 + 1, F.lit(4)), 2, 16)))
    return F.when(text.rlike("^[A-Z2-7]+$"), F.array_join(digits, ""))


def identifier(prefix: str, hexadecimal: Column) -> Column:
    return F.concat(F.lit(prefix), base32(hexadecimal))


def fnv1a32(text: Column) -> Column:
    """The 32-bit FNV-1a hash over a text's code points."""
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    # the factor in two parts, so that products stay within 64 bits
    step = lambda h, c: low(low((h.bitwiseXOR(F.ascii(c).cast("long"))) * F.lit(FNV_FACTOR & 0xFFFF)) + F.shiftleft(low(h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(FNV_FACTOR >> 16)).bitwiseAND(F.lit(0xFFFF)), 16))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(FNV_START).cast("long"), step)
