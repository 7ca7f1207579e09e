"""License scans by ordered signature rules, in DataFrame expressions only.

Every rule of license_rules.py has a priority, a label, a strength and a regex over the text's words (lower-cased, one blank between). The
keyword prefilter is read off the regexes: each has beginnings of words that all its matches hold, and runs only on texts in which these
begin a word. One pass of one alternation finds which keywords a text has; texts with no rule's first keyword are not searched at all.
No text that a rule matches is left out. Matches are marked in the text where they stand and their word intervals read off in one pass over
the words; a detection inside the interval of one of higher priority (or of equal priority and longer) is suppressed by one scan
over the sorted intervals. Time and memory are linear in the text, for any number of matches.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.license_rules import parse

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What parts the words of texts not yet lower-cased.
RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

# The base phrases and labels of the contract.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

#: Words too common to gate a rule by if it has others.
COMMON = frozenset("a all and any as by do for in is it may mit modify no of or that the this to under want what with without you have software source code version free file".split())

#: Characters above which words are counted without being held.
LONG = 1_000_000

_INTERVAL = "array<struct<first:int,n:int>>"
_FOUND = "array<struct<first:int,end:int,priority:int,label:string,strength:double>>"
#: What the suppression scan keeps is one bit a detection, so many to a number, so that its state stays small.
WORD_BITS = 62


def required(regex: str) -> list[str]:
    """Beginnings of words that every match of a rule's regex holds: literals outside of all groups, from a word's start on."""
    out, run, at_start, i = [], "", True, 0
    literal = lambda c: c.isalnum() or not c.isascii()

    def close() -> None:
        nonlocal run
        if run:
            out.append(run)
        run = ""

    while i < len(regex):
        c, optional = regex[i], regex[i + 1 : i + 2] == "?"
        if literal(c):
            if optional:
                close()
                at_start, i = False, i + 2
            else:
                if run or at_start:
                    run += c
                at_start, i = False, i + 1
        elif c == " ":
            close()
            at_start, i = not optional, i + 1 + optional
        elif c == "[":
            close()
            at_start, i = False, regex.index("]", i) + 1
        elif c == "(":
            close()
            depth, j, ends, last = 0, i, [], ""
            while True:
                d = regex[j]
                if d in "()":
                    depth += 1 if d == "(" else -1
                if depth == 0 or depth == 1 and d == "|":
                    ends.append(last == " ")
                if depth == 0:
                    break
                last, j = d, j + 1
            optional = regex[j + 1 : j + 2] == "?"
            at_start = all(ends) and (at_start or not optional)
            i = j + 1 + optional
        else:
            raise ValueError(f"a rule can't hold {c!r}: {regex}")
    close()
    return out


@functools.cache
def rules() -> list[tuple[int, str, float, str, tuple[str, ...]]]:
    """(priority, label, strength, regex, keywords) of all rules; of a rule's required words the two that tell most, the best first."""
    chosen = []
    for priority, label, strength, regex in parse():
        words = sorted(dict.fromkeys(required(regex)), key=lambda w: (w in COMMON or len(w) < 2, -len(w)))
        if not words:
            raise ValueError(f"a rule must hold a word outside of groups: {regex}")
        chosen.append((priority, label, strength, regex, words[:2]))
    every = {w for *_, words in chosen for w in words}
    # A keyword that begins another stands for both, so that one pass finds all.
    shortest = {w: next(w[:k] for k in range(1, len(w) + 1) if w[:k] in every) for w in every}
    return [(p, label, s, r, tuple(dict.fromkeys(shortest[w] for w in words))) for p, label, s, r, words in chosen]


def _alternation(words: list[str]) -> str:
    """A regex of any of the words, their common beginnings shared."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    parts = [c + (_alternation(rest) if all(rest) else "") for c, rest in sorted(by.items())]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def gate() -> str:
    """A regex found in every text, as it is, that any rule or base phrase matches: a word begins with some rule's first keyword."""
    first = _alternation(sorted({words[0] for *_, words in rules()} | {"license" if "license" in phrase else phrase for _, phrase in BASE}))
    return f"(?i)(?:^|{RAW_GAP}){first}"


def count_words(text: Column) -> Column:
    """Number of words of a text as it is; the pieces between gaps, without the empty ones at its two ends.

    A text above LONG characters is counted by putting one character in each word's place instead, which is slower but holds no pieces.
    """
    word = f"[^{RAW_GAP[1:]}"
    marks = F.length(F.regexp_replace(text, rf"\A{RAW_GAP}++|({word}){word}*+{RAW_GAP}*+", "$1"))
    ends = F.when(F.left(text, F.lit(1)).rlike(RAW_GAP), 1).otherwise(0) + F.when(F.right(text, F.lit(1)).rlike(RAW_GAP), 1).otherwise(0)
    pieces = F.size(F.split(text, f"{RAW_GAP}+", -1)) - ends
    return F.when(text == "", 0).when(F.length(text) > LONG, marks).otherwise(pieces).cast("long")


def words_of(text: Column) -> Column:
    """' w1 w2 ... wn ' of the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), GAP, " ")), F.lit(" "))


def keywords_of(words: Column) -> Column:
    """The distinct keywords of the rules that begin a word."""
    every = sorted({w for *_, words_ in rules() for w in words_})
    return F.array_distinct(F.regexp_extract_all(words, F.lit(f" ({_alternation(every)})"), F.lit(1)))


def places(words: Column, regex: Column) -> Column:
    """array of struct(first, n): first word (from 0) and number of words of every match of regex in words_of().

    Matches are put between two control characters, which no word holds; the words that carry them are the matches' ends.
    """
    marked = F.regexp_replace(words, F.concat(F.lit(" ((?:"), regex, F.lit("))(?= )")), F.lit(" \x01$1\x02"))
    none = F.array().cast(_INTERVAL)

    def read(m: Column) -> Column:
        split = F.transform(F.split(F.substr(m, F.lit(2)), " "), lambda w, i: F.when(F.startswith(w, F.lit("\x01")) | F.endswith(w, F.lit("\x02")), F.struct(i.alias("i"), w.alias("w"))))
        return F.get(F.transform(F.array(F.array_compact(split)), pair), F.lit(0))

    def pair(ends: Column) -> Column:
        first = F.transform(F.filter(ends, lambda e: F.startswith(e["w"], F.lit("\x01"))), lambda e: e["i"])
        last = F.transform(F.filter(ends, lambda e: F.endswith(e["w"], F.lit("\x02"))), lambda e: e["i"])
        return F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), (b - a + 1).alias("n")))

    return F.get(F.transform(F.array(marked), lambda m: F.when(F.contains(m, F.lit("\x01")), read(m)).otherwise(none)), F.lit(0))


def detections(words: Column, keywords: Column) -> Column:
    """array of struct(first, end, priority, label, strength) of all rules' matches."""
    literal = F.array(
        *[F.struct(F.lit(p).alias("priority"), F.lit(label).alias("label"), F.lit(float(s)).alias("strength"), F.lit(regex).alias("regex"), F.array(*map(F.lit, need)).alias("need")) for p, label, s, regex, need in rules()]
    )

    def run(r: Column) -> Column:
        one = lambda m: F.struct(m["first"].alias("first"), (m["first"] + m["n"]).alias("end"), r["priority"].alias("priority"), r["label"].alias("label"), r["strength"].alias("strength"))
        return F.transform(places(words, r["regex"]), one)

    # Bound to a variable first: the optimizer would compute an inlined expression again for every rule.
    fired = lambda held: F.filter(literal, lambda r: F.size(F.array_except(r["need"], held)) == 0)
    return F.flatten(F.get(F.transform(F.array(keywords), lambda held: F.transform(fired(held), run)), F.lit(0)))


def unsuppressed(found: Column) -> Column:
    """Detections not inside another's interval of higher priority, or of equal priority and more words; in order of their places.

    Sorted by first word, longer ones first, then priority, whatever holds a detection comes before it. So for each priority the
    farthest end so far (and the first word of the earliest interval that reaches it) decides.
    """
    key = lambda d: F.struct(d["first"].alias("first"), (-d["end"]).alias("back"), d["priority"].alias("priority"), d["label"].alias("label"), d["strength"].alias("strength"))
    back = lambda k: F.struct(k["first"].alias("first"), (-k["back"]).alias("end"), k["priority"].alias("priority"), k["label"].alias("label"), k["strength"].alias("strength"))
    far = F.array(*[F.struct(F.lit(-1).alias("end"), F.lit(-1).alias("first")) for _ in range(1 + max(p for p, *_ in rules()))])
    zero = F.lit(0).cast("long")
    start = F.struct(far.alias("far"), zero.alias("bits"), F.lit(0).alias("n"), F.array().cast("array<bigint>").alias("words"))

    def step(s: Column, d: Column) -> Column:
        own = F.get(s["far"], d["priority"])
        higher = F.exists(F.slice(s["far"], F.lit(1), d["priority"]), lambda f: f["end"] >= d["end"])
        longer = (own["end"] > d["end"]) | ((own["end"] == d["end"]) & (own["first"] < d["first"]))
        reach = F.transform(s["far"], lambda f, i: F.when(i == d["priority"], F.struct(d["end"].alias("end"), d["first"].alias("first"))).otherwise(f))
        bits = F.when(higher | longer, s["bits"]).otherwise(s["bits"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), s["n"])))
        full = s["n"] == WORD_BITS - 1
        return F.struct(
            F.when(d["end"] > own["end"], reach).otherwise(s["far"]).alias("far"),
            F.when(full, zero).otherwise(bits).alias("bits"),
            F.when(full, F.lit(0)).otherwise(s["n"] + 1).alias("n"),
            F.when(full, F.concat(s["words"], F.array(bits))).otherwise(s["words"]).alias("words"),
        )

    def kept(ordered: Column) -> Column:
        bits = F.aggregate(ordered, start, step, lambda s: F.concat(s["words"], F.array(s["bits"])))
        held = lambda words: F.filter(ordered, lambda d, i: F.getbit(F.get(words, F.floor(i / WORD_BITS).cast("int")), i % WORD_BITS) == 1)
        return F.get(F.transform(F.array(bits), held), F.lit(0))

    in_order = F.transform(F.array_sort(F.transform(found, key)), back)
    return F.when(F.size(found) < 2, found).otherwise(F.get(F.transform(F.array(in_order), kept), F.lit(0)))


def scan(docs: DataFrame) -> DataFrame:
    """Scan whole texts of docs (doc_id, text). Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and found
    (array of the unsuppressed detections: first and end word, priority, label, strength).

    n_base counts the places of the base phrases; first_word and last_word are the least and largest word number at which one starts, null
    if none. labels holds the base labels and those of the unsuppressed detections, distinct, sorted, comma-joined; score is the largest
    strength among these, 0.5 for a base label alone, 0 for none. A null text counts as empty: no words, empty label strings. Rows
    repeating a doc_id are scanned each; other columns are ignored; an empty table gives no rows. Texts may have any length that a string
    holds. No shuffle, no Python.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(_INTERVAL)
    one = docs.select("doc_id", count_words(text).alias("n_words"), F.when(text.rlike(gate()), words_of(text)).alias("w"))
    one = one.withColumn("keywords", F.when(F.col("w").isNotNull(), keywords_of(F.col("w"))))
    base = [F.when(F.contains("w", F.lit(f" {phrase} ")), places(F.col("w"), F.lit(phrase))).otherwise(none).alias(f"b{i}") for i, (_, phrase) in enumerate(BASE)]
    empty = F.array().cast(_FOUND)
    one = one.select("doc_id", "n_words", *base, F.when(F.col("w").isNotNull(), detections(F.col("w"), F.col("keywords"))).otherwise(empty).alias("all"))
    one = one.withColumn("found", F.when(F.size("all") > 0, unsuppressed(F.col("all"))).otherwise(empty)).withColumn("base", F.flatten(F.array("b0", "b1", "b2")))
    base_labels = F.array_compact(F.array(*[F.when(F.size(f"b{i}") > 0, F.lit(label)) for i, (label, _) in enumerate(BASE)]))
    all_labels = F.array_sort(F.array_union(base_labels, F.transform("found", lambda d: d["label"])))
    starts = F.transform("base", lambda m: m["first"].cast("long"))
    score = F.greatest(F.coalesce(F.array_max(F.transform("found", lambda d: d["strength"])), F.lit(0.0)), F.when(F.size("base") > 0, 0.5).otherwise(0.0))
    return one.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"), F.array_join(all_labels, ",").alias("labels"), score.alias("score"), "found",
    )
