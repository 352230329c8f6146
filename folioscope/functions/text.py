"""Text expressions. All are built-in column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed


def _plain(ch: str) -> str:
    """A character's compatibility decomposition without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))


def fold_tables(ranges) -> tuple[str, str, dict[str, str]]:
    """Folding of lower-case characters, from Unicode's decompositions: (from, to) strings for ``translate`` with what becomes
    one character or, at the end of ``from``, none; and a table of what becomes several."""
    src, dst, gone, several = [], [], [], {}
    for code in (c for r in ranges for c in r):
        ch = chr(code)
        if 0xD800 <= code <= 0xDFFF or ch != ch.lower():
            continue
        base = _plain(ch)
        if base == ch:
            continue
        if not base:
            gone.append(ch)
        elif len(base) == 1:
            src.append(ch)
            dst.append(base)
        else:
            several[ch] = base
    return "".join(src + gone), "".join(dst), several


HANGUL = range(0xAC00, 0xD7A4)  # syllables: folded by arithmetic
FOLD_FROM, FOLD_TO, FOLD_LONG = fold_tables([range(0x80, HANGUL[0]), range(HANGUL[-1] + 1, 0x20000), range(0x2F800, 0x2FA20)])
#: What of it is accented Latin or a mark: enough for Latin scripts.
LATIN_FROM, LATIN_TO = (lambda kept: ("".join(a for a, _ in kept) + "".join(map(chr, range(0x300, 0x370))), "".join(b for _, b in kept)))(
    [(a, b) for a, b in zip(FOLD_FROM, FOLD_TO) if (0xC0 <= ord(a) < 0x250 or 0x1E00 <= ord(a) < 0x1F00) and b.isalpha()])


def char_class(codes) -> str:
    """A pattern's character class for these code points, as ranges."""
    spans: list[list[int]] = []
    for code in sorted(codes):
        if spans and code == spans[-1][1] + 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans) + "]"


#: What folds to several characters, and a short class around it that most texts of Latin scripts don't match.
LONG_PATTERN = char_class([*map(ord, FOLD_LONG), *HANGUL])
LONG_NEAR = char_class([*(ord(c) for c in FOLD_LONG if ord(c) < 0x587), *range(0x587, 0x110000)])
WORD_PATTERN = r"[\p{L}\p{N}]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strings(values) -> Column:
    """A literal array<string>."""
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _table(pairs: dict[str, str]) -> Column:
    """A constant table as one string, which the planner copies and compares cheaply however often it is named."""
    return F.lit("\x01" + "".join(f"{key}\x02{value}\x01" for key, value in pairs.items()))


def _found(table: Column, key: Column) -> Column:
    """The value of a key in ``_table``, else null."""
    at = F.position(F.concat(F.lit("\x01"), key, F.lit("\x02")), table)
    return F.when(at > 0, F.substring_index(F.substring(table, at + F.length(key) + 2, F.lit(24)), "\x01", 1))


def _point(number: Column) -> Column:
    """The character with this code."""
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def _replaced(text: Column, pattern: str, body) -> Column:
    """``text`` with each match of ``pattern`` replaced by ``body(match)``."""
    pieces, marks = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(pieces, marks, lambda p, m: F.concat(p, F.coalesce(body(m), F.lit("")))), "")


def fold(c) -> Column:
    """Lower case without accents, for any script: compatibility decomposition, marks dropped."""
    table = _table(FOLD_LONG)

    def jamo(n, first, size, each):
        return _point(first + F.floor(n % size / each).cast("int"))

    def one(ch):
        n = F.ascii(ch) - HANGUL[0]
        tail = F.when(n % 28 > 0, _point(0x11A7 + n % 28)).otherwise(F.lit(""))
        syllable = F.concat(_point(0x1100 + F.floor(n / 588).cast("int")), jamo(n, 0x1161, 588, 28), tail)
        return F.when(n.between(0, len(HANGUL) - 1), syllable).otherwise(F.coalesce(_found(table, ch), ch))

    def rest(t):
        return F.when(t.rlike(LONG_NEAR), _replaced(t, LONG_PATTERN, one)).otherwise(t)

    return F.transform(F.array(F.translate(F.lower(F.coalesce(_c(c), F.lit(""))), FOLD_FROM, FOLD_TO)), rest)[0]


def words(c) -> Column:
    """Lowercase, accent-free letter/digit runs, as an array."""
    return F.regexp_extract_all(fold(c), F.lit(WORD_PATTERN), F.lit(0))


STEM_PATTERN = "^(.{%d,}?)(%s)$" % (fixed.MIN_STEM, "|".join(fixed.SUFFIXES))


def stem(word) -> Column:
    """Light suffix stripper: the first suffix of the list that leaves at least three letters goes."""
    w = _c(word)
    suffix = F.regexp_extract(w, STEM_PATTERN, 2)
    return _stripped(w, suffix, F.left(w, F.length(w) - F.length(suffix)))


def stem_within(word: Column) -> Column:
    """``stem`` inside array functions, which evaluate every mention of a part: suffix and base are bound, so made once."""
    def bound(value, use):
        return F.get(F.transform(F.array(value), use), F.lit(0))

    return bound(F.regexp_extract(word, STEM_PATTERN, 2), lambda suffix: bound(
        F.left(word, F.length(word) - F.length(suffix)), lambda base: _stripped(word, suffix, base)))


def _stripped(w: Column, suffix: Column, base: Column) -> Column:
    doubled = (
        suffix.isin("ing", "ings", "ed")
        & (F.length(base) > fixed.MIN_STEM)
        & (F.right(base, F.lit(1)) == F.substring(base, -2, 1))
        & ~F.right(base, F.lit(2)).isin(fixed.KEEP_DOUBLE)
    )
    return (
        F.when(suffix == "", w)
        .when((suffix == "s") & F.right(w, F.lit(2)).isin("ss", "us", "is"), w)
        .when(suffix.isin("ies", "ied"), F.concat(base, F.lit("y")))
        .when(doubled, base.substr(F.lit(1), F.length(base) - 1))
        .otherwise(base)
    )


def is_ascii(c) -> Column:
    return F.octet_length(_c(c)) == F.length(_c(c))


def match_level(term, token) -> Column:
    """2 = same word, 1 = same word after stemming or by a close prefix, 0 = unrelated."""
    a, b = _c(term), _c(token)
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    near = (F.length(short) >= 5) & (F.length(long) - F.length(short) <= 2)
    return (
        F.when(a == b, 2)
        # a stem keeps the first three letters of its word, so most pairs need none
        .when((F.left(a, F.lit(3)) == F.left(b, F.lit(3))) & (stem(a) == stem(b)), 1)
        .when((short != "") & F.startswith(long, short) & (~is_ascii(short) | near), 1)
        .otherwise(0)
    )


def content_words(c) -> Column:
    """Words of a text without the small ones."""
    return F.filter(words(c), lambda w: ~w.isin(fixed.STOPWORDS))


def headline_signature(title) -> Column:
    """Sorted distinct stems of the content words; the lowercase title when nothing is left."""
    key = F.array_join(F.array_sort(F.array_distinct(F.transform(content_words(title), stem))), " ")
    return F.when(key != "", key).otherwise(F.lower(F.trim(F.coalesce(_c(title), F.lit("")))))


def headline_words(c) -> Column:
    """Distinct [a-z0-9]{2,} runs of a headline minus the briefing's stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0))
    return F.filter(F.array_distinct(found), lambda w: ~w.isin(fixed.HEADLINE_STOPWORDS))


def jaccard(a, b) -> Column:
    x, y = _c(a), _c(b)
    both = F.size(F.array_intersect(x, y))
    return both / F.greatest(F.lit(1), F.size(F.array_distinct(x)) + F.size(F.array_distinct(y)) - both)


def slug(c) -> Column:
    return F.trim(F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", "-"), F.lit("-"))


def slugify(c, limit: int = 70) -> Column:
    cut = F.rtrim(F.substring(slug(c), 1, limit), F.lit("-"))
    return F.when(cut == "", F.lit("untitled")).otherwise(cut)


def label(c) -> Column:
    """Normalised tag: trimmed, lowercase, spaces to hyphens."""
    return F.regexp_replace(F.lower(F.trim(_c(c))), " ", "-")


def squash(c) -> Column:
    """Letters, digits and underscores only, lowercase."""
    return F.regexp_replace(F.lower(F.coalesce(_c(c), F.lit(""))), r"[^\p{L}\p{N}_]+", "")


def same_text(a, b) -> Column:
    return (squash(a) != "") & (squash(a) == squash(b))


def whole_word(pattern: str) -> str:
    """The pattern between word boundaries, for letters of any script."""
    return r"(?<![\p{L}\p{N}_])" + pattern + r"(?![\p{L}\p{N}_])"


def is_english_slug(text) -> Column:
    """True when a lowercase text holds one of the English function words as a whole word."""
    return F.lower(_c(text)).rlike(whole_word("(?:" + "|".join(fixed.ENGLISH_WORDS) + ")"))


def strip_tags(c, by: str = " ") -> Column:
    return F.regexp_replace(_c(c), "<[^>]+>", by)


#: A character reference: decimal, hexadecimal, or a name with or without its semicolon.
REFERENCE = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{1,32};?)"


def _character(number: Column) -> Column:
    """The text of a numeric reference: numbers that are no character become U+FFFD, control characters vanish."""
    low = F.array(*[F.lit(bytes([n]).decode("cp1252", "replace")) for n in range(0x80, 0xA0)])
    none = (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    gone = number.between(1, 8) | number.between(14, 31) | (number == 11) | (number == 127) | number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(0xFFFE) == 0xFFFE)
    points = _point(F.when(none | gone, F.lit(0xFFFD)).otherwise(number))
    windows = F.when(number.isin(0x81, 0x8D, 0x8F, 0x90, 0x9D), points).otherwise(F.get(low, (number - 0x80).cast("int")))
    return F.when(number.between(0x80, 0x9F), windows).when(gone & ~none, F.lit("")).otherwise(points)


def named_once(df: DataFrame, keep: list[str], **values: Column) -> DataFrame:
    """``df`` with columns that later filters and columns refer to without being put in their place again and again.

    Decoding is a long expression; the optimizer would write it out wherever its column is named.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def unescape(c) -> Column:
    """One round of decoding: every numeric reference and every name of the HTML standard.

    A name without its semicolon is taken where the standard knows it so; else its longest beginning that is such a name.
    """
    from html.entities import html5

    names = _table(html5)
    longest = max(len(n) for n in html5 if not n.endswith(";"))

    def decoded(mark):
        body = F.rtrim(F.substring(mark, 3, 40), F.lit(";"))
        digits = F.ltrim(F.when(body.rlike("^[xX]"), F.substring(body, 2, 40)).otherwise(body), F.lit("0"))
        many = F.length(digits) > 9
        number = F.when(digits == "", F.lit(0)).when(many, F.lit(0x110000)).when(body.rlike("^[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("bigint")
        name = F.substring(mark, 2, 40)
        sizes = F.filter(F.sequence(F.lit(longest), F.lit(2), F.lit(-1)), lambda n: n < F.length(name))
        part = F.get(F.filter(sizes, lambda n: _found(names, F.left(name, n)).isNotNull()), F.lit(0))
        begun = F.concat(_found(names, F.left(name, part)), F.substring(name, part + 1, F.lit(40)))
        return F.when(mark.startswith("&#"), _character(number)).otherwise(F.coalesce(_found(names, name), begun, mark))

    def round_(t):
        return F.when(t.contains("&"), _replaced(t, REFERENCE, decoded)).otherwise(t)

    return F.transform(F.array(_c(c)), round_)[0]  # the text is named once: rounds of decoding nest


def clean(c) -> Column:
    """Decoded (three rounds at most) and squeezed text."""
    rounds = F.array(*[F.lit(n) for n in range(3)])  # the long expression is written once
    text = F.aggregate(rounds, F.coalesce(_c(c), F.lit("")), lambda t, _: unescape(t))
    return F.trim(F.regexp_replace(text, r"[\s\x1C-\x1F\x85\p{Z}]+", " "))


def strip_jats(c) -> Column:
    return clean(strip_tags(F.coalesce(_c(c), F.lit(""))))


def display_count(c) -> Column:
    """1.2M / 34k / 9,876 style counts."""
    n = F.coalesce(_c(c), F.lit(0))
    return (
        F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", F.floor(n / 1e5 + 0.5) / 10), F.lit("M")))
        .when(n >= 10_000, F.concat(F.floor(n / 1000 + 0.5).cast("string"), F.lit("k")))
        .otherwise(F.format_number(n, 0))
    )


def byline(authors, shown: int = 3) -> Column:
    a = _c(authors)
    head = F.array_join(F.slice(a, 1, shown), ", ")
    return F.when(F.coalesce(F.size(a), F.lit(0)) <= 0, F.lit("")).when(
        F.size(a) <= shown, head
    ).otherwise(F.concat(head, F.lit(" +"), (F.size(a) - shown).cast("string")))


def venue_line(venue, year) -> Column:
    return F.array_join(F.filter(F.array(_c(venue), _c(year).cast("string")), lambda x: x != ""), " · ")


def filter_echo(phrases, author, since, before, exclude) -> Column:
    """Plain words for what a query was understood to ask."""
    quoted = F.array_join(
        F.transform(_c(phrases), lambda p: F.concat(F.lit('"'), F.array_join(p, " "), F.lit('"'))), " and "
    )
    return F.concat_ws(
        "; ",
        F.when(F.size(_c(phrases)) > 0, F.concat(F.lit("exactly "), quoted)),
        F.when(_c(author) != "", F.concat(F.lit("by "), _c(author))),
        F.when(_c(since).isNotNull(), F.concat(F.lit("since "), _c(since).cast("string"))),
        F.when(_c(before).isNotNull(), F.concat(F.lit("before "), _c(before).cast("string"))),
        F.when(F.size(_c(exclude)) > 0, F.concat(F.lit("without "), F.array_join(_c(exclude), ", "))),
    )
