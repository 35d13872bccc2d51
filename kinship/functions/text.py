"""Cleaning, tokens and derived keys of names and addresses, as Column expressions that stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinship.functions import dictionaries as words

def array_of(items: list[str]) -> Column:
    return F.array(*map(F.lit, items))


def table_of(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def is_number(token: Column) -> Column:
    return token.rlike(r"^[0-9]+$")


def numbers(tokens: Column) -> Column:
    return F.filter(tokens, is_number)


def letters(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~is_number(t))


def base_clean(text: Column) -> Column:
    """Lower case, without apostrophes; & and + spelled out, @ a space; null becomes empty. Text that may not be Latin goes through to_latin first, as a column of its own."""
    s = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[’'`´]", "")
    return F.replace(F.replace(F.replace(s, F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" and ")), F.lit("@"), F.lit(" "))


def tokens(text: Column) -> Column:
    """Runs of a-z or of digits of a clean text."""
    return F.filter(F.split(F.regexp_replace(text, r"(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])", " "), "[^a-z0-9]+"), lambda t: t != "")


def glue_letters(toks: Column) -> Column:
    """Runs of single letters become one token: l l c -> llc."""
    joined = F.regexp_replace(F.array_join(toks, " "), r"(?<=\b[a-z]) (?=[a-z]\b)", "")
    return F.filter(F.split(joined, " "), lambda t: t != "")


def stem(token: Column) -> Column:
    """Singular of an English plural; numbers and words of up to three letters stay."""
    cut = F.when(token.endswith("ies") & (F.length(token) > 4), F.regexp_replace(token, "ies$", "y"))
    cut = cut.when(token.endswith("s") & ~token.rlike("(ss|us|is|os)$"), F.regexp_replace(token, "s$", ""))
    return F.when(is_number(token) | (F.length(token) <= 3), token).otherwise(cut.otherwise(token))


def canon(token: Column, table: Column) -> Column:
    """The table's form of a token, else of its stem, else the stem."""
    return let(stem(token), lambda root: F.coalesce(F.try_element_at(table, token), F.try_element_at(table, root), root))


def fix_first_letter(token: Column, table: Column) -> Column:
    """A leading l that was an I: lndia -> india; words of the table stay."""
    return F.when((F.length(token) > 2) & ~F.map_contains_key(table, token), F.regexp_replace(token, words.LEADING_L, "i")).otherwise(token)


def fix_digits(text: Column) -> Column:
    """Digits read for letters: between letters, and 0, 1, 5 before letters unless they are an ordinal."""
    for digit, letter in words.DIGIT_LETTERS.items():
        text = F.regexp_replace(text, words.DIGIT_INSIDE.format(digit=digit), letter)
    for digit in words.LEADING_DIGITS:
        text = F.regexp_replace(text, words.DIGIT_LEADING.format(digit=digit), words.DIGIT_LETTERS[digit])
    return text


def skeleton(token: Column) -> Column:
    """A consonant key that survives other spellings; numbers stay; a word of vowels keeps its first."""
    s = token
    for a, b in words.SOUND_RULES:
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.regexp_replace(s, r"(.)\1+", "$1")
    bare = let(s, lambda x: F.coalesce(F.nullif(F.regexp_replace(x, "[aeiou]", ""), F.lit("")), F.substring(x, 1, 1)))
    return F.when(is_number(token) | (token == ""), token).otherwise(bare)


def split_ends(toks: Column) -> Column:
    """(core, legal, extra): legal, stop and generic words are taken off both ends, stop words out of the middle."""
    return let(toks, _split_ends)


def _split_ends(toks: Column) -> Column:
    legal, stop, edge = array_of(words.LEGAL), array_of(words.STOP), array_of(words.EDGE)
    ends = array_of([*words.LEGAL, *words.STOP, *words.EDGE])
    inner = F.filter(F.transform(toks, lambda t, i: F.when(~F.array_contains(ends, t), i)), lambda i: i.isNotNull())
    bounds = F.struct(F.array_min(inner).alias("a"), F.array_max(inner).alias("b"))
    pick = lambda cut, among: F.array_sort(F.array_distinct(F.filter(cut, lambda t: F.array_contains(among, t))))

    def parted(at: Column) -> Column:
        first, last = at["a"], at["b"]
        kept = F.when(first.isNull(), F.array().cast("array<string>")).otherwise(F.slice(toks, first + 1, last - first + 1))
        cut = F.when(first.isNull(), toks).otherwise(F.concat(F.slice(toks, F.lit(1), first), F.slice(toks, last + 2, F.size(toks))))
        core = F.filter(kept, lambda t: ~F.array_contains(stop, t))
        plain = F.filter(toks, lambda t: ~F.array_contains(stop, t) & ~F.array_contains(legal, t))
        best = let(core, lambda c: F.when(F.size(c) > 0, c).otherwise(let(plain, lambda p: F.when(F.size(p) > 0, p).otherwise(toks))))
        return F.struct(best.alias("core"), pick(cut, legal).alias("legal"), pick(cut, edge).alias("extra"))

    return let(bounds, parted)


def collapse_domains(text: Column) -> Column:
    """Web addresses of a lower-case text as the name that they hold: www.foo.com -> foo."""
    return F.regexp_replace(text, words.DOMAIN, " $1 ")


def raw_name_tokens(name: Column) -> Column:
    """Clean tokens before any table is applied, for learning one."""
    s = F.replace(collapse_domains(base_clean(name)), F.lit("."), F.lit(" "))
    return F.flatten(F.transform(F.split(s, ","), lambda p: glue_letters(tokens(p))))


def name_parts(name: Column, translit: Column | None = None) -> Column:
    """(core, legal, extra, alias) of a name: aliases are the cores of all parts around "doing business as" and the like, joined by " | ", empty if there is one part."""
    s = collapse_domains(base_clean(name))
    s = F.regexp_replace(fix_digits(s), words.PRIVATE, " pvt ")
    s = F.replace(F.replace(s, F.lit("(india)"), F.lit(" ")), F.lit("."), F.lit(" "))
    table = table_of(words.NAME_CANON)

    def form(t: Column) -> Column:
        t = F.coalesce(F.try_element_at(translit, t), t) if translit is not None else t
        return let(fix_first_letter(t, table), lambda x: canon(x, table))

    def parted(piece: Column) -> Column:
        toks = F.flatten(F.transform(F.split(piece, ","), lambda q: glue_letters(tokens(q))))
        return split_ends(F.filter(F.transform(toks, form), lambda t: t != ""))

    def joined(parts: Column) -> Column:
        cores = F.filter(F.transform(parts, lambda p: F.array_join(p["core"], " ")), lambda c: c != "")
        alias = let(cores, lambda c: F.when(F.size(c) > 1, F.array_join(c, " | ")).otherwise(""))
        return F.struct(parts[0]["core"].alias("core"), parts[0]["legal"].alias("legal"), parts[0]["extra"].alias("extra"), alias.alias("alias"))

    pieces = let(s, lambda x: let(F.filter(F.split(x, words.ALIAS), lambda p: F.trim(p) != ""), lambda ps: F.when(F.size(ps) > 0, ps).otherwise(F.array(x))))
    return let(F.transform(pieces, parted), joined)


def _phrases(segment: Column) -> Column:
    """Phrases become their short forms, longest phrases first."""
    rows = sorted({**words.ADDRESS_PHRASES, **words.US_STATES}.items(), key=lambda r: (-len(r[0]), r[0]))
    pattern = {p: re.escape(p).replace(r"\ ", " ?") for p, _ in rows}
    out = segment
    for phrase, short in rows:
        out = F.regexp_replace(out, rf"\b{pattern[phrase]}\b", f" {short} ")
    return F.when(segment.rlike(r"\b(?:" + "|".join(pattern.values()) + r")\b"), out).otherwise(segment)


def address_parts(address: Column) -> Column:
    """(tokens, postal, landmark) of an address: short forms, the last 5 or 6 digit number as postal code, whether a landmark word stands in it."""
    s = F.regexp_replace(base_clean(address), words.ZIP4, "$1")
    s = F.regexp_replace(s, words.PIN_PARTS, "$1$2")
    s = F.regexp_replace(s, words.ORDINAL, "$1")
    table = table_of(words.ADDRESS_CANON)
    plain = lambda g: F.concat(F.lit(" "), F.regexp_replace(g, "[^a-z0-9]+", " "), F.lit(" "))
    segments = F.transform(F.transform(F.split(s, ","), plain), lambda g: glue_letters(tokens(_phrases(g))))
    toks = F.filter(F.transform(F.flatten(segments), lambda t: let(fix_first_letter(t, table), lambda x: canon(x, table))), lambda t: t != "")
    return with_postal(toks)


def with_postal(toks: Column) -> Column:
    """(tokens, postal, landmark) of an address's tokens; other numbers lose leading zeros."""

    def found(t: Column) -> Column:
        last = F.array_max(F.filter(F.transform(t, lambda x, i: F.when(x.rlike("^[1-9][0-9]{4,5}$"), i)), lambda i: i.isNotNull()))
        postal = let(last, lambda at: F.when(at.isNotNull() & ((at > 0) | (F.size(t) == 1)), F.get(t, at)).otherwise(""))
        return let(postal, lambda p: bare(t, p))

    def bare(t: Column, p: Column) -> Column:
        short = F.transform(t, lambda x: F.when(is_number(x) & (x != p), F.regexp_replace(x, "^0+(?=[0-9])", "")).otherwise(x))
        return let(short, lambda x: F.struct(x.alias("tokens"), p.alias("postal"), F.arrays_overlap(x, array_of(words.LANDMARKS)).cast("int").alias("landmark")))

    return let(toks, found)


def acronym(toks: Column) -> Column:
    """Initials of two or more words, else empty."""
    alpha = letters(toks)
    return F.when(F.size(alpha) >= 2, F.array_join(F.transform(alpha, lambda t: F.substring(t, 1, 1)), "")).otherwise("")


def house_numbers(toks: Column, postal: Column) -> Column:
    """An address's numbers without the last one that is the postal code."""
    nums = numbers(toks)
    back = F.array_position(F.reverse(nums), postal)
    at = F.size(nums) - back.cast("int")
    return F.when((postal != "") & (back > 0), F.filter(nums, lambda _, i: i != at)).otherwise(nums)


def country_key(country: Column) -> Column:
    return F.lower(F.trim(F.coalesce(country, F.lit(""))))
