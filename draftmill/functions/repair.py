"""Repairing what OCR confuses, and comparing readings of one text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from draftmill.functions.text import norm, ratio_from

# Letters that are read for digits, the fields they are repaired in, words that stay, and narrow glyphs.
CONFUSED, DIGITS = "IlOoSBD", "1100580"
NUMERIC_FIELDS = ("drawing_number", "date", "scale", "job_number")
SAFE_WORDS = ("TO", "NO", "OF", "ON", "IN", "IS", "AS", "BY", "OR", "SO", "DO", "DIA", "DO.", "NO.", "SEC", "ELEV", "SCALE", "SITE", "PLAN")
NARROW = r"[1IiljL|/\\'\"`.,\-_0-9]"
REVISION_WORDS = ("REVISION", "REVISIONS", "AMENDMENT", "AMENDMENTS", "REV.")
#: Most characters that a more complete reading may add, and the least share of narrow ones among them.
EXTRA, NARROW_SHARE = 4, 0.6


def with_digits(s: Column, field: str | None = None) -> Column:
    """Letters read for digits made digits, where their place in the word speaks for it. Every test reads the word as it
    was, and no test looks beyond its word, as the characters around a word are blanks."""
    numeric = field in NUMERIC_FIELDS
    if field is not None and not numeric:
        return s

    def word(w: Column) -> Column:
        safe = F.upper(F.regexp_replace(F.upper(w), r"^[.,;:]+|[.,;:]+$", "")).isin(*SAFE_WORDS)
        whole = (w.rlike(r"\d") & (F.length(w) <= 12)) | (F.lit(numeric) & (F.length(w) <= 3))

        def char(c: Column, i: Column) -> Column:
            before, after = F.substring(w, i, F.when(i > 0, 1).otherwise(0)), F.substring(w, i + 2, F.lit(1))
            alone = ~before.rlike(r"\p{L}") & ~after.rlike(r"\p{L}")
            return F.when(whole | before.rlike(r"\d") | after.rlike(r"\d") | alone, F.translate(c, CONFUSED, DIGITS)).otherwise(c)

        return F.when(safe | w.rlike(r"^\s"), w).otherwise(F.array_join(F.transform(F.regexp_extract_all(w, F.lit("(?s)(.)"), F.lit(1)), char), ""))

    repaired = F.array_join(F.transform(F.regexp_extract_all(s, F.lit(r"(\s|\S+)"), F.lit(1)), word), "")
    if numeric:
        return repaired
    plain = F.size(F.filter(F.regexp_extract_all(s, F.lit(r"(\S+)"), F.lit(1)), lambda w: (F.length(w) > 2) & F.replace(w, F.lit("."), F.lit("")).rlike(r"^\p{L}+$")))
    return F.when((plain >= 2) & ~s.rlike(r"\d"), s).otherwise(repaired)


def variants(s: Column, field: str | None = None, most: int = 8) -> Column:
    """The text, the text with one letter repaired (from the left, `most` entries in all), and the one of with_digits."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.translate(F.substring(s, i, F.lit(1)), CONFUSED, "") != F.substring(s, i, F.lit(1)))
    one = F.transform(F.slice(at, 1, most - 1), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.translate(F.substring(s, i, F.lit(1)), CONFUSED, DIGITS), F.substring(s, i + 1, F.length(s))))
    every = F.concat(F.array(s), one)
    full = with_digits(s, field)
    return F.when(F.array_contains(every, full), every).otherwise(F.concat(every, F.array(full)))


def more_complete(main: Column, other: Column) -> Column:
    """What another reading has beyond the main one, if that is a few, mostly narrow characters; else null."""
    m, a = F.trim(main), F.trim(other)
    at = F.instr(a, m)
    extra = F.trim(F.concat(F.substring(a, F.lit(1), at - 1), F.substring(a, at + F.length(m), F.length(a))))
    core = F.regexp_replace(extra, r"\s", "")
    narrow = F.length(core) - F.length(F.regexp_replace(core, NARROW, ""))
    fits = (m != "") & (F.length(a) > F.length(m)) & (at > 0) & F.length(extra).between(1, EXTRA) & (narrow >= NARROW_SHARE * F.length(core))
    return F.when(fits, extra)


def first_more_complete(main: Column, others: Column) -> Column:
    """The first of an array of readings that differs from the main one and is more complete."""
    return F.get(F.filter(others, lambda o: (F.trim(o) != F.trim(main)) & more_complete(main, o).isNotNull()), 0)


def same_text(a: Column, b: Column, least: float = 70.0) -> Column:
    """Neither empty, and one holds the other or they are alike enough."""
    x, y = norm(F.coalesce(a, F.lit(""))), norm(F.coalesce(b, F.lit("")))
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x) | (ratio_from(x, y, least) >= least))


def correction_kind(verbatim: Column, corrected: Column, basis: Column) -> Column:
    """fix with a basis, normalize without; null if nothing but case and punctuation has changed."""
    flat = lambda c: F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")
    changed = (F.coalesce(corrected, F.lit("")) != "") & (flat(verbatim) != flat(corrected))
    return F.when(changed & (F.coalesce(basis, F.lit("")) != ""), "fix").when(changed, "normalize")


def series(path: Column) -> Column:
    """The drawing series that the folders of a path name."""
    p = F.upper(path)
    return F.when(p.contains("BSM"), "BSM").when(p.contains("CABANA"), "YFA-Cabana").when(p.contains("STATE"), "YFA-StateGov").when(p.contains("YFA"), "YFA").otherwise("unknown")


def reviewed(s: Column) -> Column:
    """1 for 1 or true, as number or text, else 0."""
    return F.when(F.lower(F.trim(s.cast("string"))).isin("1", "true"), 1).otherwise(0)


def names_revision(s: Column) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in REVISION_WORDS]), lambda w: F.contains(F.upper(s), w))
