"""Text expressions over tokens of drawing sheets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats and words that decide what a text is.
SCALE = r"(?i)\bSCALE\b|\b\d+\s*:\s*\d+\b|(\d+\s+)?\d+(/\d+)?\s*\"\s*=\s*\d+\s*'|\b(AS\s+SHOWN|AS\s+NOTED|FULL\s+SIZE|N\.?T\.?S\.?|NOT\s+TO\s+SCALE|VARIOUS)\b"
VAGUE_SCALE = r"(?i)AS\s+SHOWN|AS\s+NOTED|VARIOUS"
CAPTION = r"(?i)^\s*(NORTH|SOUTH|EAST|WEST|FRONT|REAR|SIDE)?\s*(ELEVATION|PLAN|PERSPECTIVE)\b|^\s*SECTIONS?\s+[A-Z0-9]{1,2}\s*[-–—]\s*[A-Z0-9]{1,2}\b|^\s*DETAIL\s+\w"
MONTH = "(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)"
DATE = rf"\b\d{{1,2}}\s*[./-]\s*\d{{1,2}}\s*[./-]\s*\d{{2,4}}\b|\b{MONTH}[A-Z]*\.?\s+\d{{4}}\b|\b\d{{1,2}}\s+{MONTH}[A-Z]*\.?\s+\d{{2,4}}\b|\b(19|20)\d{{2}}\b"
YEAR = r"\b(1[89]\d{2}|20\d{2})\b"
DRAWING_NUMBER = r"\b\d{2,4}\s*/\s*[A-Z]{1,2}\s*\d{1,3}[A-Z]?\b|\b[A-Z]{1,3}\s*-?\s*\d{2,5}\b|\b\d{3,6}\s*[-/]\s*\d{1,4}\b"
DIMENSION = r"^[\d\s'\"/\-.,ØøRr]+$"
BARE_LABEL = r"(?i)^\s*SCALES?\s*[:.]?\s*$"
#: What begins like this is another field's label, and no name of a person.
NO_PERSON = r"(?i)^\s*(DATE(\b|\d)|(SCALES?|DRAWN|CHKD|CHECK|CHECKED|CHEEK|APPD|APPROVED|CLIENT|JOB|PROJECT|TITLE|DRAWING|DWG|DRG|SHEET|REVISION|E|CH|CE|H|HE)\b)"
TYPE_WORDS = ("PERSPECTIVE", "ELEVATION", "SECTION", "DETAIL", "PLAN")
PROBE_WORDS = ("SCALE", "DATE", "DRAWN", "DRAWING", "CHECKED", "ARCHITECT", "TITLE", "SHEET", "JOB")
STATUS_WORDS = {"not_started": 0, "queued": 0, "running": 1, "success": 2, "failed": 3}
REASONS = ("illegible", "not_present", "ambiguous", "low_resolution", "requires_visual")
RELIABLE_HEIGHT, MARGINAL_HEIGHT = 20.0, 8.0


def norm(s: Column) -> Column:
    """Upper case, runs of white space as one blank."""
    return F.trim(F.regexp_replace(F.upper(s), r"\s+", " "))


def squeezed(s: Column) -> Column:
    """Upper case without white space."""
    return F.regexp_replace(F.upper(s), r"\s+", "")


def number_key(s: Column) -> Column:
    return F.regexp_replace(squeezed(s), r"[.,;:]+$", "")


def alpha_ratio(s: Column) -> Column:
    """Letters among the characters that are no white space; 0 for none."""
    seen = F.length(F.regexp_replace(s, r"\s", ""))
    return F.when(seen == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(s, r"[^\p{L}]", "")) / seen)


def is_scale(s: Column) -> Column:
    return s.rlike(SCALE)


def is_bare_label(s: Column) -> Column:
    """A scale's label alone, which is no scale."""
    return s.rlike(BARE_LABEL)


def is_vague_scale(s: Column) -> Column:
    return s.rlike(VAGUE_SCALE)


def is_caption(s: Column) -> Column:
    return s.rlike(CAPTION)


def is_dimension(s: Column) -> Column:
    """Digits, marks of feet, inches and radius, and what stands between them."""
    return s.rlike(DIMENSION)


def keep_line(s: Column) -> Column:
    """A caption, a scale, or a short line of capitals that are mostly letters."""
    t = F.trim(s)
    capitals = t.rlike(r"\p{Lu}") & ~t.rlike(r"\p{Ll}")
    return is_caption(t) | is_scale(t) | (capitals & F.length(t).between(4, 40) & (alpha_ratio(t) > 0.70))


def is_date(s: Column) -> Column:
    return s.rlike(f"(?i){DATE}")


def year(s: Column) -> Column:
    return F.nullif(F.regexp_extract(s, YEAR, 1), F.lit("")).try_cast("int")


def is_drawing_number(s: Column) -> Column:
    v = F.regexp_replace(norm(F.coalesce(s, F.lit(""))), r"[.,;:]+$", "")
    return (v != "") & ~v.rlike(f"(?i)^({DATE})$") & v.rlike(f"(?i)^({DRAWING_NUMBER})$")


def has_drawing_number(s: Column) -> Column:
    return s.rlike(f"(?i){DRAWING_NUMBER}")


def drawing_type(s: Column) -> Column:
    """The one type word of a text, `mixed` for several, null for none."""
    found = F.array_compact(F.array(*[F.when(F.upper(s).contains(w), F.lit(w.lower())) for w in TYPE_WORDS]))
    return F.when(F.size(found) == 1, F.get(found, 0)).when(F.size(found) > 1, F.lit("mixed"))


def verdict(height: Column) -> Column:
    return F.when(height >= RELIABLE_HEIGHT, "reliable").when(height >= MARGINAL_HEIGHT, "marginal").otherwise("unrecoverable")


def image_status(s: Column) -> Column:
    """0 to 3 as number or text, or a legacy word; anything else is 0."""
    t = F.lower(F.trim(s))
    words = reduce(lambda c, kv: c.when(t == kv[0], kv[1]), STATUS_WORDS.items(), F.when(t.rlike("^[0-3]$"), t.try_cast("int")))
    return words.otherwise(0)


def notes(values: Column) -> Column:
    """Trimmed, without blanks and nulls, each once, in the order of their first place."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def reason_of(values: Column) -> Column:
    return F.get(F.filter(notes(values), lambda x: x.isin(*REASONS)), 0)


def other_notes(values: Column) -> Column:
    """The notes without the one that is the reason."""
    first = reason_of(values)
    return F.filter(notes(values), lambda x: first.isNull() | (x != first))


def indel_ratio(a: Column, b: Column) -> Column:
    """100 * 2 * longest common subsequence / both lengths: the rows of the dynamic programme folded over the letters."""
    letters = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    row0 = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))

    def step(row: Column, c: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            best = F.when(F.substring(b, j, 1) == c, F.get(row, j - 1) + 1).otherwise(F.greatest(F.get(row, j), F.get(done, j - 1)))
            return F.concat(done, F.array(best))

        return F.when(F.length(b) == 0, row).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(b), F.lit(1))), F.array(F.lit(0)), cell))

    lcs = F.element_at(F.aggregate(letters(a), row0, step), -1)
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(200.0 * lcs / total)


def ratio_from(a: Column, b: Column, least: float) -> Column:
    """indel_ratio where it may get to `least`, else 0: what texts have in common is no longer than the shorter one, so most
    pairs are told apart by their lengths, without the rows of the programme."""
    total = F.length(a) + F.length(b)
    return F.when(200.0 * F.least(F.length(a), F.length(b)) >= least * total, indel_ratio(a, b)).otherwise(F.lit(0.0))


def reply_object(s: Column) -> Column:
    """The outermost braces of a model's reply, with fences and other text around it dropped; null for none."""
    return F.nullif(F.regexp_extract(s, r"(?s)\{.*\}", 0), F.lit(""))


def format_check(name: Column, value: Column, first: int = 1900, last: int = 2000) -> Column:
    """1 or 0 for fields with a format, null for the others. A person's name has a letter, and nothing of other fields."""
    v = F.coalesce(value, F.lit(""))
    flat = F.trim(F.regexp_replace(v, r"\s+", " "))
    person = flat.rlike("[A-Za-z]") & ~(is_date(flat) | has_drawing_number(flat) | is_scale(flat) | flat.rlike(NO_PERSON))
    one = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(name == "scale", one(is_scale(v))).when(name == "date", one(F.coalesce(year(v).between(first, last), F.lit(False)))).when(name == "drawing_number", one(is_drawing_number(v))).when(name == "draughtsperson", one(person))
