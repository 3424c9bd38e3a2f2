"""Scalar functions over text columns. White space and letters are Unicode's unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_S = r"(?U)\s"
#: The characters that \s stands for.
SPACE = "\t\n\x0b\x0c\r \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: Literal replacements of glyph names, applied in this order.
GLYPHS = [
    ("[bracketleft]", "["), ("[bracketright]", "]"), ("[parenleft]", "("), ("[parenright]", ")"), ("[bullet]", ""), ("[dagger]", ""), ("[daggerdbl]", ""), ("[section]", ""), ("[paragraph]", ""),
    ("[endash]", "-"), ("[emdash]", "—"), ("[quotedblleft]", "“"), ("[quotedblright]", "”"), ("[quoteleft]", "'"), ("[quoteright]", "'"),
    ("[fi]", "fi"), ("[fl]", "fl"), ("[ff]", "ff"), ("[ffi]", "ffi"), ("[ffl]", "ffl"), ("[ft]", "ft"), ("[st]", "st"),
]
#: Headings after which a document's references and the like begin.
HEADINGS = ["references", "references and notes", "bibliography", "works cited", "literature cited", "acknowledgements", "acknowledgments"]


def trimmed(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACE))


def collapsed(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, _S + "+", " "))


def word_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"(?U)\S+"))


def preview(x: Column, n: int) -> Column:
    return F.left(x, F.lit(n))


def normalized(x: Column) -> Column:
    """For comparison: quotes and dashes folded, letters and white space only, lower case, spaces collapsed."""
    folded = F.translate(x, "’‘“”—–", "''\"\"  ")
    return collapsed(F.lower(F.regexp_replace(folded, r"(?U)[^\p{IsAlphabetic}\s]", "")))


def sanitized(x: Column) -> Column:
    """Printable ASCII only: quotes folded, dashes spelled out and then, where not ASCII, deleted, spaces collapsed."""
    folded = F.translate(x, "’‘“”", "''\"\"")
    for a, b in (("—", " — "), ("–", " - "), ("…", "...")):
        folded = F.replace(folded, F.lit(a), F.lit(b))
    return collapsed(F.regexp_replace(folded, r"[^\x21-\x7E \n\t]", ""))


def sanitize_changed(x: Column) -> Column:
    return sanitized(x) != collapsed(x)


def terminated(x: Column) -> Column:
    """x as it is if it ends, but for white space, in a closing mark; else right-trimmed with a full stop."""
    bare = F.regexp_replace(x, r"(?U)\s+$", "")
    return F.when(bare.rlike("[.!?…\"']$"), x).otherwise(F.concat(bare, F.lit(".")))


def think_stripped(x: Column) -> Column:
    """What follows the first closing think tag, trimmed; without one, x."""
    at = F.instr(x, "</think>")
    return F.when(at > 0, trimmed(F.substring(x, at + 8, F.length(x)))).otherwise(x)


def is_drop(x: Column) -> Column:
    return F.lower(trimmed(x)) == "drop"


def stem(path: Column) -> Column:
    """Lower-cased file name without folder and last extension."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, r"([^/\\]*)$", 1), r"^(.+?)(\.[^.]*)?$", 1))


def hyphens_rejoined(x: Column) -> Column:
    return F.regexp_replace(x, r"-\n(?=[a-z])", "")


def glyphs_replaced(x: Column) -> Column:
    """Glyph names written out and spaces collapsed. All names begin with a bracket: most lines are passed over."""
    y = x
    for name, text in GLYPHS:
        y = F.replace(y, F.lit(name), F.lit(text))
    y = F.when(F.contains(x, F.lit("[")), F.regexp_replace(y, r"\[uni[0-9A-Fa-f]+\]", "")).otherwise(x)
    return F.regexp_replace(y, " {2,}", " ")


def glyphs_scrubbed(x: Column) -> Column:
    return trimmed(glyphs_replaced(x))


def is_page_number(line: Column) -> Column:
    """Digits between hyphens and spaces; vacuously also hyphens alone."""
    x = trimmed(line)
    return (F.length(x) > 0) & x.rlike("^[- ]*[0-9]*[- ]*$")


def is_noise(line: Column) -> Column:
    """Short (bytes) and not ended as a sentence, or a link, or a DOI."""
    x = trimmed(line)
    return ((F.octet_length(x) < 40) & ~x.rlike("[.?!]$")) | x.rlike("^https?://") | x.rlike(r"^10\.[0-9]{4,}/")


def is_reference_heading(line: Column) -> Column:
    x = trimmed(line)
    return (F.octet_length(x) <= 40) & x.rlike(rf"(?i)^[0-9. ()]*(appendix|({'|'.join(HEADINGS)})\z)")


def is_caption(line: Column) -> Column:
    return trimmed(line).rlike(r"(?i)^(figure|fig\.|fig|table|tbl\.|tbl) [0-9]")


def artifact(ordinal: Column) -> Column:
    """File name of a 1-based chunk: three digits, more from 1000 on."""
    return F.concat(F.lit("paragraph_"), F.when(ordinal < 1000, F.lpad(ordinal.cast("string"), 3, "0")).otherwise(ordinal.cast("string")), F.lit(".wav"))
