"""Name normalisers as Column -> Column functions.

Thirteen of them, none a substitute for another: which one a join key uses is part of the key's meaning.  All stay in
the JVM; accents are folded by `translate` with a table derived from Unicode decomposition.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_table() -> tuple[str, str]:
    """Precomposed Latin letters up to U+024F and the letter that each decomposes to."""
    pairs = [(chr(cp), unicodedata.normalize("NFKD", chr(cp))[0]) for cp in range(0xC0, 0x250) if len(unicodedata.normalize("NFKD", chr(cp))) == 2]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _BASE = _fold_table()

# the accents that the narrower normalisers know (fixed values)
_UPPER_15 = ("ÀÂÄÉÈÊËÎÏÔÖÙÛÜÇ", "AAAEEEEIIOOUUUC")
_LOWER_15 = ("éèêëàâäîïôöùûüç", "eeeeaaaiioouuuc")
_UPPER_5 = ("ÉÈÊÀÂ", "EEEAA")
_LOWER_5 = ("éèêàâ", "eeeaa")
_LOWER_3 = ("éèà", "eea")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """Null for texts that are empty or white: blank keys never join."""
    return F.when(F.trim(_col(c)) != "", _col(c))


def strip_accents(c: Column | str) -> Column:
    return F.regexp_replace(F.translate(_col(c), _ACCENTED, _BASE), r"\p{M}+", "")


def collapse(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def alnum_key(c: Column | str) -> Column:
    """Nomenclature key: upper case, no accents, letters and digits only."""
    return F.regexp_replace(strip_accents(F.upper(F.trim(_col(c)))), r"[^\p{L}\p{N}]", "")


def staging_key(c: Column | str) -> Column:
    """Staging name: upper case, one apostrophe, hyphens and underscores as spaces, fifteen accents folded."""
    text = F.translate(F.upper(F.trim(F.coalesce(_col(c), F.lit("")))), "’`´-_", "'''  ")
    return collapse(F.translate(text, *_UPPER_15))


def type_key(c: Column | str) -> Column:
    """Type labels: lower case, no accents, single spaces."""
    return F.lower(collapse(strip_accents(_col(c))))


def token(c: Column | str, default: str = "INCONNU") -> Column:
    """Identifier part: upper case, no accents, hyphen and space as underscore, other marks dropped."""
    text = F.translate(F.upper(F.trim(strip_accents(_col(c)))), "- ", "__")
    return F.coalesce(F.nullif(F.regexp_replace(text, r"[^\p{L}\p{N}_]", ""), F.lit("")), F.lit(default))


def group_key(c: Column | str) -> Column:
    """Parent names of groupings: upper case, no accents, hyphen and underscore as space, single spaces."""
    return F.upper(collapse(F.translate(strip_accents(_col(c)), "-_", "  ")))


def group_token(c: Column | str) -> Column:
    return F.translate(group_key(c), " ", "_")


def ascii_key(c: Column | str) -> Column:
    """Parent names of localities: ASCII only, lower case, single spaces, hyphens kept."""
    return F.lower(collapse(F.regexp_replace(strip_accents(_col(c)), r"[^\x00-\x7F]", "")))


def ascii_token(c: Column | str) -> Column:
    """Runs of anything but ASCII letters and digits as one underscore, none at the ends, upper case."""
    text = F.regexp_replace(F.regexp_replace(strip_accents(_col(c)), r"[^\x00-\x7F]", ""), r"[^A-Za-z0-9]+", "_")
    return F.upper(F.regexp_replace(text, "^_+|_+$", ""))


def province_key(c: Column | str) -> Column:
    """Province names: lower case, fifteen accents folded, underscore as space, hyphens kept."""
    return collapse(F.translate(F.translate(F.lower(F.trim(_col(c))), *_LOWER_15), "_", " "))


def city_token(c: Column | str) -> Column:
    """City identifiers: five accents folded, hyphen and space as underscore, other marks dropped."""
    text = F.translate(F.translate(F.upper(F.trim(_col(c))), *_UPPER_5), "- ", "__")
    return F.regexp_replace(text, r"[^\p{L}\p{N}_]", "")


def territory_key(c: Column | str) -> Column:
    """Territory attributes: lower case, five accents folded, underscore as space, single spaces."""
    return collapse(F.translate(F.translate(F.lower(_col(c)), *_LOWER_5), "_", " "))


def display_key(c: Column | str) -> Column:
    """Search text: no accents, trimmed, lower case."""
    return F.lower(F.trim(strip_accents(_col(c))))


def hierarchy_key(*parts: Column | str) -> Column:
    """Normalised names of a path, joined by a bar; missing parts are empty."""
    return F.concat_ws("|", *(F.coalesce(display_key(p), F.lit("")) for p in parts))


def description_key(c: Column | str) -> Column:
    """Keys in descriptions: single spaces, lower case, three accents folded."""
    return F.translate(F.lower(collapse(_col(c))), *_LOWER_3)


NORMALIZERS = {
    "alnum_key": alnum_key, "staging_key": staging_key, "type_key": type_key, "token": token, "group_key": group_key,
    "group_token": group_token, "ascii_key": ascii_key, "ascii_token": ascii_token, "province_key": province_key,
    "city_token": city_token, "territory_key": territory_key, "display_key": display_key, "description_key": description_key,
}


# --- headers: a handful of strings, on the driver ---------------------------------------------------


def header_spaced(name: str) -> str:
    """Lower case, separators as one space, other marks dropped (accented letters too)."""
    return re.sub(r"[^a-z0-9 ]", "", re.sub(r"[\s\-_]+", " ", name.strip().lower())).strip()


def header_compact(name: str) -> str:
    """No accents, lower case, letters and digits only."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", "", plain.lower())


def header_upper(name: str) -> str:
    """Single spaces, upper case."""
    return " ".join(name.split()).upper()


# --- codes, numbers, labels -------------------------------------------------------------------------


def clean_code(c: Column | str) -> Column:
    """Digits before the first point; null if there are none."""
    return F.nullif(F.regexp_replace(F.substring_index(F.trim(_col(c)), ".", 1), r"\D", ""), F.lit(""))


def compact_code(c: Column | str) -> Column:
    """Upper case without white space; blank is null."""
    return F.nullif(F.upper(F.regexp_replace(_col(c), r"\s", "")), F.lit(""))


def zero_fill(c: Column | str, width: int) -> Column:
    """Zeros before short codes; longer ones stay whole."""
    text = _col(c).cast("string")
    return F.when(F.char_length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def padded_code(c: Column | str, width: int) -> Column:
    """A code that a workbook may have turned into a number: no '.0', upper case, zeros before."""
    return zero_fill(F.upper(F.regexp_replace(F.trim(_col(c)), r"\.0$", "")), width)


def lenient_int(c: Column | str) -> Column:
    """Whole part of a number; 0 for anything else."""
    value = _col(c).cast("string").try_cast("double")
    return F.coalesce(F.when(~F.isnan(value), value).try_cast("bigint"), F.lit(0).cast("bigint"))


def lenient_float(c: Column | str) -> Column:
    """A number with point or comma; null for anything else."""
    value = F.replace(F.trim(_col(c).cast("string")), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(~F.isnan(value), value)


def first_truthy(*columns: Column | str) -> Column:
    """The first that is neither null nor empty nor zero nor false, as text."""
    return F.coalesce(*(_truthy(_col(c)) for c in columns))


def _truthy(c: Column) -> Column:
    text = c.cast("string")
    return F.when(~text.isin("", "0", "0.0", "false"), text)


# ordered: "ouest" contains "est" (fixed values)
ZONES = (("nord", "ND", "Nord"), ("ouest", "OT", "Ouest"), ("centre", "CE", "Centre"), ("sud", "SD", "Sud"), ("est", "ET", "Est"))


def zone_code(c: Column | str) -> Column:
    """Zone code from a label by ordered containment; null if none is contained."""
    text, out = strip_accents(F.lower(_col(c))), None
    for part, code, _ in ZONES:
        out = F.when(text.contains(part), code) if out is None else out.when(text.contains(part), code)
    return out


def zone_label(code: Column | str) -> Column:
    out = None
    for _, known, label in ZONES:
        out = F.when(_col(code) == known, label) if out is None else out.when(_col(code) == known, label)
    return out


def slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip_accents(_col(c))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def xml_escape(c: Column | str) -> Column:
    out = _col(c)
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def path_label(*parts: Column | str) -> Column:
    """Parts of a path joined by ' > ', blank ones left out."""
    return F.concat_ws(" > ", *(blank_to_null(p) for p in parts))


def status_label(c: Column | str) -> Column:
    """Ordered containment tests for review states."""
    text = display_key(c)
    return F.when(text.contains("valid"), "validé").when(text.contains("rejet"), "rejeté").when(text.contains("propos"), "proposé").otherwise("inconnu")


def description_pairs(html: Column | str) -> Column:
    """Map of the 'key: value' (or 'key = value') lines of an HTML description; of equal keys the last counts."""
    lines = F.split(F.regexp_replace(F.regexp_replace(_col(html), r"(?i)<\s*(br|/p|/tr|/li|/div|/h[1-6])[^>]*>", "\n"), r"<[^>]*>", " "), "\n")
    split = F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(r"^\s*([^:=]+?)\s*[:=]\s*(.*?)\s*$"), F.lit(0)))
    good = F.filter(F.flatten(split), lambda x: F.trim(x) != "")
    entries = F.transform(good, lambda x: F.struct(description_key(F.regexp_extract(x, r"^\s*([^:=]+?)\s*[:=]", 1)).alias("key"), collapse(F.regexp_extract(x, r"[:=]\s*(.*)$", 1)).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)
