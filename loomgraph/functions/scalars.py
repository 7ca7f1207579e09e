"""Scalar building blocks as Column -> Column functions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: characters kept by the n-gram tokenizer (ASCII letters and digits, Hangul syllables).
NOT_GRAM_CHAR = "[^0-9A-Za-z가-힣]"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it (a lambda's argument is not inlined)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def char_ngrams(text: Column, n: int = 2) -> Column:
    """All character n-grams, in order, of the text without anything but letters, digits and Hangul; empty if too short."""

    def grams(s: Column) -> Column:
        # By an array of characters: substr() counts characters from the start each time, which is quadratic in a long text.
        every = let(F.split(s, ""), lambda c: F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.array_join(F.slice(c, i, F.lit(n)), "")))
        return F.when(F.length(s) >= n, every).otherwise(F.array().cast("array<string>"))

    return let(F.regexp_replace(F.coalesce(text, F.lit("")), NOT_GRAM_CHAR, ""), grams)


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def squeeze_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def normalize_name(text: Column, affixes: tuple[str, ...] = ("Inc", "Ltd", "Corp", "Co", "LLC", "주식회사", "\\(주\\)")) -> Column:
    """Organisation name without legal forms, blanks and punctuation, lower-cased."""
    bare = F.regexp_replace(text, "(?i)" + "|".join(rf"\b{a}\b\.?" if a.isascii() and a.isalpha() else a for a in affixes), "")
    return F.lower(F.regexp_replace(bare, r"[\s.,&()-]", ""))


def bigram_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of character-bigram sets; a text of one character counts as the set of itself; two empty texts give 0."""

    def grams(x: Column) -> Column:
        g = F.array_distinct(char_ngrams(x))
        return F.when(F.size(g) > 0, g).otherwise(F.array(x))

    union = F.size(F.array_union(grams(a), grams(b)))
    both = F.size(F.array_intersect(grams(a), grams(b)))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), both / union).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, epsilon: float = 1e-9) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(epsilon))


def lenient_date(text: Column) -> Column:
    """'2024/3', '2024-03-05T10:00', '2024' to a date: slashes as dashes, cut at T, missing parts 1; null if there is no such date."""
    parts = F.split(F.substring_index(F.replace(text, F.lit("/"), F.lit("-")), "T", 1), "-")
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(1))
    whole = F.format_string("%04d-%02d-%02d", F.get(parts, F.lit(0)).try_cast("int"), part(1), part(2))
    return F.when(F.get(parts, F.lit(0)).try_cast("int").isNotNull(), whole.try_cast("date"))


def key_value_map(text: Column) -> Column:
    return F.str_to_map(text, F.lit(";"), F.lit("="))


def dump_map(m: Column) -> Column:
    """'k=v;k=v' in key order."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")


def hash_unit(text: Column) -> Column:
    """A number in [0, 1] from the first 32 bits of SHA-256: a repeatable draw."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[0-9a-z가-힣]+"), F.lit(0)))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(word_set(a), word_set(b)))


def route_question(q: Column, global_words: list[str], hop_words: list[str]) -> Column:
    """'global' if any global word occurs, else 'multihop' if any hop word does, else 'fact'."""
    return F.when(q.rlike("|".join(global_words)), "global").when(q.rlike("|".join(hop_words)), "multihop").otherwise("fact")


def canonical(term: Column, synonyms: dict[str, str]) -> Column:
    """The canonical predicate of a synonym; null outside the vocabulary."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv]), term)


def ceil_div(a: Column, b: Column) -> Column:
    return F.ceil(a / b).cast("long")


def euler_verdict(odd: Column) -> Column:
    """From the number of odd-degree nodes (connectivity is not looked at)."""
    return F.when(odd == 0, "circuit").when(odd == 2, "path").otherwise("none")
