"""Text functions as Column expressions: comparison keys, tidying, signatures, redaction.

All run inside generated code. Accents are dropped by a translation table built from Unicode decompositions of the Latin
blocks; letters of other alphabets stay as they are.
"""

from __future__ import annotations

import unicodedata
from functools import cache
from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Both start with what they take out, so that other characters cost one comparison.
_INNER_APOSTROPHE = r"['’](?<=[\p{L}\p{N}]['’])(?=[\p{L}\p{N}])"
_SINGLE_LETTERS = r" (?<=(?:^|\s)\p{L} )(?=\p{L}(?:\s|$))"


@cache
def _accents() -> tuple[str, str]:
    """Latin letters with marks and what is left without them, where that is one character."""
    plain = {chr(c): "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]}
    kept = {a: b for a, b in plain.items() if a != b and len(b) == 1}
    return "".join(kept), "".join(kept.values())


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip_accents(text: Column) -> Column:
    """Letters without marks; combining marks go."""
    return F.regexp_replace(F.translate(text, *_accents()), r"\p{Mn}+", "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def join_initials(spaced: Column) -> Column:
    """Single letters one space apart are joined: ``S R L`` is ``SRL``."""
    return F.regexp_replace(spaced, _SINGLE_LETTERS, "")


def _ascii(text: Column) -> Column:
    """Only ASCII characters: no accents, marks or letters of other alphabets to look for."""
    return F.octet_length(text) == F.char_length(text)


def _ascii_key(t: Column) -> Column:
    """``_any_key`` of ASCII texts."""
    s = F.when(F.contains(t, F.lit("'")), F.regexp_replace(t, _INNER_APOSTROPHE, "")).otherwise(t)
    return join_initials(F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))


def _any_key(t: Column) -> Column:
    s = strip_accents(F.regexp_replace(t, _INNER_APOSTROPHE, ""))
    s = F.replace(F.lower(s), F.lit("ß"), F.lit("ss"))
    return join_initials(F.trim(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " ")))


def exact_key(text: Column | str) -> Column:
    """What an exact match compares: no case, no accents, no punctuation, initials joined, apostrophes inside words gone."""
    t = _text(text)
    return F.when(_ascii(t), _ascii_key(t)).otherwise(_any_key(t))


def words(text: Column | str) -> Column:
    """ASCII words in upper case, as an array."""
    s = F.upper(strip_accents(F.regexp_replace(_text(text), _INNER_APOSTROPHE, "")))
    s = F.regexp_replace(s, r"[^\x00-\x7F]", "")
    return F.filter(F.split(join_initials(F.trim(F.regexp_replace(s, r"[^A-Z0-9]+", " "))), " "), lambda w: w != "")


def tidy(text: Column | str) -> Column:
    """Words of letters and digits, one space apart; apostrophes inside words stay."""
    found = F.regexp_extract_all(_text(text), F.lit(r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"), F.lit(0))
    return join_initials(F.replace(F.array_join(found, " "), F.lit("’"), F.lit("'")))


def counterpart_case(text: Column) -> Column:
    """Every word with a capital initial."""
    return F.initcap(text)


def raw_signature(raw: Column | str, least: int = 2) -> Column:
    """What stays of a bank's text from month to month: words without digits; empty with fewer than ``least``."""
    t = _text(raw)
    # The key of an ASCII text is that of the tidied one. Keys have one space between words.
    kept = F.trim(F.regexp_replace(F.when(_ascii(t), _ascii_key(t)).otherwise(_any_key(tidy(t))), "(?:^| )[^ ]*[0-9][^ ]*", ""))
    return kept if least <= 1 else F.when(F.size(F.split(kept, " ")) >= least, kept).otherwise("")


def own_name_key(raw: Column | str, amount: Column) -> Column:
    """(signature, amount to the cent), null without a signature."""
    s = raw_signature(raw, 1)
    return F.when((s != "") & amount.isNotNull(), F.struct(s.alias("signature"), F.round(amount, 2).cast("decimal(18,2)").alias("amount")))


def own_name_direction_key(raw: Column | str, amount: Column) -> Column:
    """(signature, out or in)."""
    s = raw_signature(raw, 1)
    return F.when((s != "") & amount.isNotNull(), F.struct(s.alias("signature"), F.when(amount < 0, "out").otherwise("in").alias("direction")))


def normalize_description(text: Column | str) -> Column:
    return F.trim(F.lower(_text(text)))


def starts_with(description: Column | str, pattern: Column | str) -> Column:
    """The description begins with the pattern's whole words."""
    p, d = words(pattern), words(description)
    return (F.size(p) > 0) & (F.slice(d, 1, F.greatest(F.size(p), F.lit(1))) == p)


def seal(description: Column | str, proposed: Column | str) -> Column:
    """Start of the description up to the last word of a proposed key, null if the key isn't a subsequence of its words."""
    d, k = words(description), words(proposed)
    start = F.struct(F.lit(0).alias("j"), F.lit(0).alias("last"), F.lit(0).alias("i"))

    def step(s: Column, w: Column) -> Column:
        hit = F.coalesce(w == F.get(k, s["j"]), F.lit(False))
        i = s["i"] + 1
        return F.struct(F.when(hit, s["j"] + 1).otherwise(s["j"]).alias("j"), F.when(hit, i).otherwise(s["last"]).alias("last"), i.alias("i"))

    end = F.aggregate(d, start, step)
    long_word = F.exists(k, lambda w: F.length(F.regexp_replace(w, "[^A-Z]", "")) >= 4)
    ok = (F.size(k) > 0) & long_word & (end["j"] == F.size(k))
    return F.when(ok, F.array_join(F.slice(d, 1, F.greatest(end["last"], F.lit(1))), " "))


def sealed(answer: Column | str, raw: Column | str) -> Column:
    """Every word of the answer stands in the raw text; words of four letters or more may be a part of a word."""
    a, r = words(answer), words(raw)
    return (F.size(a) > 0) & F.forall(a, lambda w: F.exists(r, lambda x: (x == w) | ((F.length(w) >= 4) & F.contains(x, w))))


def strip_symbols(text: Column | str) -> Column:
    """Letters, numbers, punctuation and separators of any alphabet."""
    return F.regexp_replace(_text(text), r"[^\p{L}\p{N}\p{P}\p{Z}]", "")


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared words over all words; 0 for two empty texts."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    every = F.size(F.array_union(x, y))
    return F.when(every > 0, F.size(F.array_intersect(x, y)) / every).otherwise(F.lit(0.0))


def containment(inner: Column | str, outer: Column | str) -> Column:
    """Share of the inner text's words that the outer text holds."""
    x, y = F.array_distinct(words(inner)), F.array_distinct(words(outer))
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x)).otherwise(F.lit(0.0))


#: Patterns of sensitive tokens and what replaces them, in order.
REDACTIONS = (
    (r"\b[A-Z]{2}\d{2}[A-Z0-9]{4,30}\b", "<ACCOUNT_ID>"),
    (r"\b\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{1,7}\b", "<CARD_ID>"),
    (r"[\*X]{4}[\s\-]?\d{4}", "<CARD_ID>"),
    (r"(?i)\b(CAU|NDS|POS|TRN|CRO|RIF|ID\s*TRANSAZIONE)\s*[\d\-]+", "<TX_CODE>"),
    (r"(?i)\b[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]\b", "<FISCAL_ID>"),
)
#: Stand-ins for owner names, by position.
STAND_INS = ("Person Alpha", "Person Beta", "Person Gamma", "Person Delta")


def name_pattern(name: str) -> str:
    """Regex for a name's words in any order."""
    tokens = [f"\\Q{t}\\E" for t in name.split()]
    return r"(?i)\b(?:" + "|".join(r"\s+".join(p) for p in permutations(tokens)) + r")\b"


def redact(text: Column | str, owners: tuple[str, ...] = (), extra: tuple[str, ...] = ()) -> Column:
    """Sensitive tokens replaced: owner names, account and card numbers, bank codes, fiscal codes, extra patterns."""
    s = _text(text)
    for i, name in enumerate(owners):
        if name.strip():
            s = F.regexp_replace(s, name_pattern(name), STAND_INS[i % len(STAND_INS)])
    for pattern, mark in REDACTIONS:
        s = F.regexp_replace(s, pattern, mark)
    for pattern in extra:
        s = F.regexp_replace(s, pattern, "<REDACTED>")
    return s


def restore(text: Column | str, owners: tuple[str, ...]) -> Column:
    s = _text(text)
    for i, name in enumerate(owners):
        s = F.regexp_replace(s, name_pattern(STAND_INS[i % len(STAND_INS)]), name)
    return s


def leaks(text: Column | str) -> Column:
    """Whether an account or card number is still there."""
    return _text(text).rlike(REDACTIONS[0][0]) | _text(text).rlike(REDACTIONS[1][0])


#: Fixed value: an account number written in one piece.
IBAN = r"\b([A-Z]{2}\d{2}[A-Z0-9]{11,30})\b"


def destination(description: Column | str, raw: Column | str) -> Column:
    """Who a one-sided transfer went to: an account number if a text holds one, else the description in upper case."""
    text = F.trim(F.regexp_replace(F.upper(_text(description)), r"\s+", " "))
    first = lambda c: F.nullif(F.regexp_extract(c, IBAN, 1), F.lit(""))
    return F.coalesce(first(F.upper(_text(raw))), first(text), text)


#: Legal forms at the end of a company's name, taken off in this order; lengths that decide what a brand's pattern is.
LEGAL_FORMS = (
    " s.p.a.", " spa", " s.r.l.", " srl", " s.a.s.", " sas", " ltd.", " ltd", " llc", " inc.", " inc", " corp.", " gmbh", " ag", " nv", " bv", " sarl", " sas", " s.a.", " sa", " ou", " ab", " oy",
)
LEAST_NAME, WHOLE_NAME, LEAST_PREFIX = 3, 10, 5


def brand_name(name: Column) -> Column:
    """A company's name in lower case, without legal forms and signs other than hyphens."""
    out = F.trim(F.lower(name))
    for form in LEGAL_FORMS:
        out = F.trim(F.regexp_replace(out, form.replace(".", "\\.") + "\\z", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?U)[^\w\s\-]", ""), r"(?U)\s+", " "))


def brand_pattern(name: Column) -> Column:
    """The regular expression that finds a brand in a bank's text: the whole name as words if it is short, else the first two
    thirds of it, as banks cut long names; null for names under three characters."""
    bare = brand_name(name)
    n = F.length(bare)
    quoted = lambda c: F.concat(F.lit("\\b"), F.regexp_replace(c, r"([ \-])", r"\\$1"))
    short = F.concat(quoted(bare), F.lit("\\b"))
    long = quoted(F.substring(bare, F.lit(1), F.greatest(F.lit(LEAST_PREFIX), F.floor(n * 2 / 3).cast("int"))))
    return F.when(n >= LEAST_NAME, F.when(n <= WHOLE_NAME, short).otherwise(long))
