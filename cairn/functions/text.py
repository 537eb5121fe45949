"""Column functions over text: tokens, cleaning, classification, compression, levels."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions import values as C

#: Splits at anything that is neither a letter nor a number; \\s of all scripts.
NOT_ALNUM = r"[^\p{IsAlphabetic}\p{N}]+"
SPACE = r"(?U)\s+"
#: Characters of a text's head, from which its summary comes if that is decided there; its entities from two or six times as many.
HEAD = 400
_EDGES = r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _full(words: Column) -> Column:
    return F.filter(words, lambda w: w != "")


def _any(tests: list[Column]) -> Column:
    return reduce(Column.__or__, tests)


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def words(text: Column | str) -> Column:
    """Words between white space."""
    return _full(F.split(col(text), SPACE))


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and numbers."""
    return _full(F.split(F.lower(col(text)), NOT_ALNUM))


def terms(text: Column | str) -> Column:
    """Tokens of more than one byte, as the lexical stages take them."""
    return F.filter(tokens(text), lambda t: F.octet_length(t) > 1)


def content_terms(text: Column | str) -> Column:
    """Distinct terms without stopwords."""
    return F.array_except(F.array_distinct(terms(text)), F.array(*map(F.lit, C.STOPWORDS)))


def trimmed(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def bare(word: Column) -> Column:
    """A word without leading and trailing signs."""
    return F.regexp_replace(word, _EDGES, "")


def count_tokens(text: Column | str) -> Column:
    """The larger of a quarter of the characters and the words."""
    by_chars = F.floor(F.char_length(col(text)) / 4).cast("int")
    return F.greatest(by_chars, F.size(words(text)))


def sentences(text: Column | str) -> Column:
    """Sentences with their closing sign, trimmed."""
    return _full(F.transform(F.split(col(text), r"(?<=[.!?\n])"), trimmed))


def claims(text: Column | str) -> Column:
    """Sentences of more than one byte."""
    return F.filter(sentences(text), lambda s: F.octet_length(s) > 1)


# Cleaning


def strip_private(text: Column | str) -> Column:
    return F.regexp_replace(col(text), C.PRIVATE_BLOCK, "")


def redact_secrets(text: Column | str) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, C.REDACTED), C.SECRET_PATTERNS, col(text))


def lines(text: Column | str) -> Column:
    """Lines without their ends; a final line end makes no line."""
    return F.split(F.regexp_replace(col(text), r"\r?\n\z", ""), r"\r?\n")


def exclude_lines(text: Column | str, patterns: tuple[str, ...] | list[str]) -> Column:
    """Drops each line that holds one of the patterns, taken literally."""
    if not patterns:
        return col(text)
    return F.array_join(F.filter(lines(text), lambda x: ~_any([F.contains(x, F.lit(p)) for p in patterns])), "\n")


def normalize_space(text: Column | str) -> Column:
    """One space between the words of a line; lines stay."""
    return trimmed(F.array_join(F.transform(lines(text), lambda x: trimmed(F.regexp_replace(x, SPACE, " "))), "\n"))


def preprocess(text: Column | str, exclude: tuple[str, ...] | list[str] = ()) -> Column:
    """struct(text, redacted): private blocks, secrets and excluded lines gone, white space in order."""
    cleaned = redact_secrets(strip_private(text))
    kept = exclude_lines(cleaned, exclude)
    changed = (cleaned != col(text)) | (kept != cleaned)
    return F.struct(normalize_space(kept).alias("text"), changed.alias("redacted"))


# Classification


def detect_type(text: Column | str) -> Column:
    low = F.lower(col(text))
    out = F
    for kind, signals in C.TYPE_SIGNALS:
        out = out.when(_any([F.contains(low, F.lit(s)) for s in signals]), kind)
    return out.otherwise(C.DEFAULT_TYPE)


def entities(text: Column | str) -> Column:
    """The first words that are technology terms, capitalised, or hold digits and letters; no two alike but for case."""
    text = col(text)  # most texts have all that are taken in their head
    full = lambda size: F.transform(F.array(_entities(_head(text, size))), lambda x: F.when(F.size(x) >= C.MAX_ENTITIES, x))[0]
    return F.coalesce(full(2 * HEAD), full(6 * HEAD), _entities(text))


def _by_letter(parts) -> str:
    """A pattern of any of the parts, by their first letters."""
    return "|".join(f"{a}(?:{'|'.join(p[1:] for p in parts if p[0] == a)})" for a in sorted({p[0] for p in parts}))


_TECH = f"(?:{_by_letter(C.TECH_TERMS)})"
#: Words that are a technology term but for signs around it, or have a digit or a capital; no other is an entity.
_ENTITY = rf"\A[^\p{{IsAlphabetic}}\p{{N}}./]*{_TECH}[^\p{{IsAlphabetic}}\p{{N}}./]*\z|[0-9\p{{IsUppercase}}]"
#: A technology term that is a token; a place that begins none is told by one letter.
_TAG = rf"(?=[{''.join(sorted({t[0] for t in C.TECH_TERMS}))}])(?<![a-z0-9]){_TECH}(?![a-z0-9])"


def _entities(text: Column) -> Column:
    some = F.filter(words(text), lambda w: F.rlike(w, F.lit(_ENTITY)))
    clean = F.transform(some, lambda w: F.regexp_replace(w, r"^[^\p{IsAlphabetic}\p{N}./]+|[^\p{IsAlphabetic}\p{N}./]+$", ""))

    def wanted(w: Column) -> Column:
        tech = F.lower(w).isin(*C.TECH_TERMS)
        capital = F.rlike(w, F.lit(r"(?s)^\p{IsUppercase}.*[\p{IsLowercase}\p{IsUppercase}]")) & F.rlike(w, F.lit(r"(?s)^..*[\p{IsLowercase}\p{IsUppercase}]"))
        mixed = F.rlike(w, F.lit("[0-9]")) & F.rlike(w, F.lit(r"\p{IsAlphabetic}"))
        return (F.octet_length(w) >= 2) & (tech | capital | mixed)

    def ascii_lower(w: Column) -> Column:
        return F.translate(w, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def add(found: Column, w: Column) -> Column:
        known = F.exists(found, lambda e: ascii_lower(e) == ascii_lower(w))
        return F.when((F.size(found) >= C.MAX_ENTITIES) | known, found).otherwise(F.concat(found, F.array(w)))

    return F.aggregate(F.filter(clean, wanted), F.array().cast("array<string>"), add)


def tags(text: Column | str) -> Column:
    """Technology terms among the tokens, in the order of the list."""
    found = F.slice(F.array_intersect(F.array(*map(F.lit, C.TECH_TERMS)), tokens(text)), 1, C.MAX_TAGS)
    may = F.rlike(F.lower(col(text)), F.lit(_TAG))  # else no token is one
    return F.when(~may, F.array().cast("array<string>")).otherwise(found)


def merge_tags(given: Column | str, found: Column | str) -> Column:
    """The caller's tags as they are, then those found that are not among them."""
    return F.concat(col(given), F.filter(col(found), lambda t: ~F.array_contains(col(given), t)))


# Compression

#: Every protected literal has one of these.
_IN_LITERALS = ("`", "/", ":\\", *(f".{end}" for end in re.search(r"\\.\(\?:([a-z|]+)\)", C.PROTECTED)[1].split("|")))


def compress(text: Column | str, intensity: str = "full") -> Column:
    """Shorter text; code, addresses and paths stay as they are.

    The text is taken apart at protected literals. In what is between, phrases are
    rewritten; then all is words again, and a word with a literal in it is kept.
    """
    mark = "\u0000"
    text = col(text)
    may = _any([F.contains(text, F.lit(x)) for x in _IN_LITERALS])
    literals = F.when(may, F.regexp_extract_all(text, F.lit(C.PROTECTED), F.lit(0))).otherwise(F.array().cast("array<string>"))
    dropped = [*C.FILLERS, *(() if intensity == "lite" else C.ARTICLES)]
    short = F.create_map(*(F.lit(x) for pair in C.ABBREVIATIONS.items() for x in pair))
    # Each literal stands for its number between marks, so a mark alone counts as one number.
    key = lambda w: F.lower(bare(F.regexp_replace(w, mark, "\u00000\u0000")))

    def shorten(w: Column, k: Column) -> Column:
        found = F.try_element_at(short, k)
        end = F.regexp_extract(w, r"[^\p{IsAlphabetic}\p{N}]*$", 0)
        return F.when(~k.isin(*dropped), F.coalesce(F.concat(found, end), w))

    def rewritten(masked: Column) -> Column:
        return reduce(lambda t, pair: F.regexp_replace(t, f"(?iu){pair[0]}", pair[1]), C.PHRASES, masked)

    def phrased(masked: Column) -> Column:
        may = lambda low: _any([F.contains(low, F.lit(old)) for old, _ in C.PHRASES])
        return F.when(_any([F.contains(masked, F.lit(x)) for x in _FOLDED]) | once(F.lower(masked), may), rewritten(masked)).otherwise(masked)

    masked = once(F.when(may, F.regexp_replace(text, C.PROTECTED, mark)).otherwise(text), phrased)
    one = lambda w: F.when(~F.rlike(w, F.lit(_RARE)), w).otherwise(once(key(w), lambda k: shorten(w, k)))
    kept = F.filter(F.transform(words(masked), one), lambda w: w.isNotNull())
    joined = lambda pieces: F.array_join(F.zip_with(pieces, literals, lambda p, x: F.concat(F.coalesce(p, F.lit("")), F.coalesce(x, F.lit("")))), "")
    return joined(F.split(F.array_join(kept, " "), mark, -1))


#: Words that may be a filler, an article or a long form but for signs around it; compression leaves all others as they are.
_RARE = r"\A[^0-9A-Za-z]*(?iu:" + _by_letter((*C.FILLERS, *C.ARTICLES, *C.ABBREVIATIONS)) + r")[^0-9A-Za-z]*\z"
#: What is the same as a letter of a phrase in some case; and what takes literals beyond words or stands for literals besides.
_FOLDED = ("\u017f", "\u0130", "\u0131", "\u212a")
_BEYOND = ("`", "\u0000", *_FOLDED)


def compressed_words(text: Column | str, intensity: str = "full") -> Column:
    """The distinct words of a text's compressed form; words are compressed one by one, and only those that may change, unless the text has a phrase or literals go beyond words."""
    text, low = col(text), F.lower(col(text))
    whole = _any([F.contains(low, F.lit(old)) for old, _ in C.PHRASES] + [F.contains(text, F.lit(x)) for x in _BEYOND])
    pair = lambda every: F.struct(every.alias("every"), F.filter(every, lambda w: F.rlike(w, F.lit(_RARE))).alias("rare"))
    short = lambda x: F.array_union(F.array_except(x["every"], x["rare"]), _full(F.transform(x["rare"], lambda w: compress(w, intensity))))
    apart = once(once(F.array_distinct(words(text)), pair), lambda x: F.when(F.size(x["rare"]) == 0, x["every"]).otherwise(short(x)))
    return F.when(whole, F.array_distinct(words(compress(text, intensity)))).otherwise(apart)


def summary(compressed: Column | str) -> Column:
    """The first sentence, or two if the first is short."""

    def of(parts: Column) -> Column:
        take = F.when(count_tokens(F.get(parts, F.lit(0))) < 40, 2).otherwise(1)
        return F.when(F.size(parts) == 0, trimmed(compressed)).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), take), ". "), F.lit(".")))

    return F.transform(F.array(_parts(col(compressed))), of)[0]


def _parts(compressed: Column) -> Column:
    return _full(F.transform(F.split(compressed, r"[.\n]"), trimmed))


def _head(text: Column, size: int) -> Column:
    """The whole words and white space among the first characters of a text."""
    return F.regexp_replace(F.substring(text, 1, size), r"(?U)\S+\z", "")


def summary_of(text: Column | str, intensity: str = "full") -> Column:
    """The summary of a text's compressed form; of a long text its head is compressed alone if that gives the same.

    It does if a third sentence begins in the head, as no phrase that is rewritten has an end of sentence in it,
    and if the head has neither backticks, between which literals go beyond words, nor the sign that stands for literals.
    """
    text = col(text)
    whole = summary(compress(text, intensity))

    def chosen(head: Column) -> Column:
        short = F.transform(F.array(compress(head, intensity)), lambda c: F.struct(summary(c).alias("s"), F.size(_parts(c)).alias("n")))[0]
        return F.transform(F.array(short), lambda x: F.when((x["n"] >= 3) & ~F.rlike(head, F.lit("[`\\x00]")), x["s"]))[0]

    return F.coalesce(F.when(F.char_length(text) > HEAD, F.transform(F.array(_head(text, HEAD)), chosen)[0]), whole)


def primary_topic(text: Column | str) -> Column:
    """The first capitalised word of three bytes in capitals, else the first word, else MEMO."""
    bared = F.transform(words(text), bare)
    named = F.filter(bared, lambda w: (F.octet_length(w) >= 3) & F.rlike(w, F.lit(r"^\p{IsUppercase}")))
    return F.upper(F.coalesce(F.get(named, F.lit(0)), F.get(bared, F.lit(0)), F.lit("MEMO")))


def key_values(text: Column | str) -> Column:
    """Up to three distinct tokens with a digit, or acronyms of two to six letters."""
    some = F.filter(words(text), lambda w: F.rlike(w, F.lit(_ENTITY)))
    clean = F.transform(some, lambda w: F.regexp_replace(w, r"^[^\p{IsAlphabetic}\p{N}=/]+|[^\p{IsAlphabetic}\p{N}=/]+$", ""))
    wanted = F.filter(clean, lambda w: (F.octet_length(w) >= 2) & (F.rlike(w, F.lit("[0-9]")) | F.rlike(w, F.lit("^[A-Z]{2,6}$"))))
    return F.slice(F.array_distinct(wanted), 1, 3)


def headline(text: Column | str) -> Column:
    facts = key_values(text)
    return F.when(F.size(facts) == 0, primary_topic(text)).otherwise(F.concat(primary_topic(text), F.lit(": "), F.array_join(facts, "+")))


def levels(text: Column | str, intensity: str = "full") -> Column:
    """struct(compressed, summary, headline)."""
    of = lambda short: F.struct(short.alias("compressed"), summary(short).alias("summary"), headline(text).alias("headline"))
    return F.transform(F.array(compress(text, intensity)), of)[0]  # so that a text is compressed once


# Names, dates, consensus


def database_name(name: Column | str) -> Column:
    """A name as one safe part of a path: other characters become -, names with separators or of dots alone are null."""
    clean = trimmed(name)
    safe = F.regexp_replace(clean, r"[^A-Za-z0-9._\-]", "-")
    return F.when(~F.rlike(clean, F.lit(r"^$|[/\\\\]")) & ~F.rlike(safe, F.lit(r"^\.*$")), safe)


def short_date(when: Column | str) -> Column:
    return F.date_format(col(when), "MMM''yy")


def timestamp_text(when: Column | str) -> Column:
    return F.date_format(col(when), "yyyy-MM-dd HH:mm")


def consensus(endorsed: Column | str, disputed: Column | str) -> Column:
    """(e + 1) / (e + d + 2) for so many endorsements and disputes."""
    e, d = col(endorsed).cast("double"), col(disputed).cast("double")
    return (e + 1) / (e + d + 2)


def similarity(a: Column | str, b: Column | str) -> Column:
    """Jaccard of the words of two texts; 1 if both have none."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)).cast("double") / union)
