"""Text expressions on Spark columns; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the retrieval operators, spelled out so that every engine agrees.
SPACE = r"[ \t\n\r\f\x0B   -     　﻿]"
#: Characters that count as one token each: CJK ideographs, Hangul, kana.
WIDE = "[一-鿿가-힯぀-ゟ゠-ヿ]"
ASCII = "[a-z0-9一-鿿]+"
METRIC = "[^a-zA-Z0-9一-鿿]+|[一-鿿]|[a-zA-Z0-9]+"
WORD = r"[\p{L}\p{M}\p{N}_]+"
#: Characters `strip_special` keeps, fixed values.
KEPT = "一-龥a-zA-Z0-9 \\t\\n\\r\\f\\x0B.,;:!?\"'()\\[\\]{}。，；：！？“”‘’（）【】-"
#: Entities `strip_html` decodes, in this order, fixed values.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'))


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body uses it.

    Lambda bodies are interpreted, so an expression inside one is evaluated anew for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim(c: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    """White space runs as one blank, trimmed: the form that content hashes use."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def content_hash(c: Column) -> Column:
    return F.sha2(collapse(c), 256)


def strip_html(c: Column) -> Column:
    c = F.regexp_replace(c, "<[^>]+>", "")
    for entity, plain in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def strip_special(c: Column) -> Column:
    return F.regexp_replace(c, f"[^{KEPT}]", "")


def normalize_space(c: Column) -> Column:
    """Blanks and tabs as one blank, at most one empty line in a row, trimmed."""
    return trim(F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "\n{3,}", "\n\n"))


def strip_header_footer(c: Column, least_lines: int = 10, longest: int = 79, share: float = 0.1) -> Column:
    """Without the lines whose trimmed text, 1 to `longest` characters, repeats at least
    max(3, share of the lines) times; texts under `least_lines` lines stay."""
    lines = F.split(c, "\n")

    def cleaned(ls: Column) -> Column:
        short = F.filter(F.transform(ls, trim), lambda x: F.length(x).between(1, longest))
        need = F.greatest(F.lit(3), F.ceil(F.size(ls) * share)).cast("int")
        # sorted, equal lines are neighbours: a line repeats enough if it equals the one `need - 1` places on
        often = let(
            F.array_sort(short),
            lambda o: F.array_distinct(F.filter(o, lambda x, i: F.coalesce(F.get(o, i + need - 1) == x, F.lit(False)))),
        )
        return let(often, lambda out: F.array_join(F.filter(ls, lambda x: ~F.array_contains(out, trim(x))), "\n"))

    return F.when(F.size(lines) >= least_lines, let(lines, cleaned)).otherwise(c)


def token_count(c: Column) -> Column:
    """Estimated model tokens: one for each wide character, one for four others, rounded up."""
    wide = F.regexp_count(c, F.lit(WIDE))
    return (wide + F.ceil((F.length(c) - wide) / 4)).cast("int")


def words(c: Column, pattern: str = WORD) -> Column:
    """Lower-cased word tokens, as an array."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({pattern})"), F.lit(1))


def words_cjk(c: Column) -> Column:
    """Word tokens, with each run of Han characters as single characters and pairs.

    No dictionary is needed to find a Chinese word inside a longer run. Texts without Han
    characters give their words.
    """
    han = "[一-鿿]"
    rest = F.regexp_replace(c, han, " ")
    runs = F.regexp_extract_all(c, F.lit(f"({han}+)"), F.lit(1))
    singles = F.flatten(F.transform(runs, lambda r: F.filter(F.split(r, ""), lambda x: x != "")))
    pairs = F.flatten(
        F.transform(
            runs,
            lambda r: F.when(
                F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))
            ).otherwise(F.array().cast("array<string>")),
        )
    )
    return F.when(F.rlike(c, F.lit(han)), F.concat(words(rest), singles, pairs)).otherwise(words(c))


def ascii_tokens(c: Column) -> Column:
    """Lower-cased runs of a-z, 0-9 and Han characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({ASCII})"), F.lit(1))


def metric_tokens(c: Column) -> Column:
    """Tokens of BLEU and ROUGE: words, single Han characters, and runs of anything else but blanks."""
    found = F.regexp_extract_all(F.lower(c), F.lit(f"({METRIC})"), F.lit(1))
    return F.filter(found, lambda x: F.length(trim(x)) > 0)


def ngrams(tokens: Column, n: int) -> Column:
    """Blank-joined n-grams of a token array; none if it is shorter."""
    return F.when(
        F.size(tokens) >= n,
        F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " ")),
    ).otherwise(F.array().cast("array<string>"))


def sentences(c: Column) -> Column:
    """Cut after sentence ends and line ends; blank pieces go."""
    return F.filter(F.split(c, "(?<=[。！？.!?\n])\\s*"), lambda x: F.length(trim(x)) > 0)
