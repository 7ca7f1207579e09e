"""Language identification by rank-order profiles: out-of-place distance of a text's most frequent character n-grams."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import slices_by_bytes, text_buffer
from loomgraph.storage import materialize

#: n-grams in a profile.
PROFILE = 400
#: Documents that a language's profile is learned from: all it has, or a hashed sample of this many on average.
SAMPLE = 2_000
#: Labels beyond this many are no set of languages: an error, so that what is collected stays bounded by LANGUAGES x PROFILE rows.
LANGUAGES = 10_000
#: Letters whose n-grams are counted at a time.
BLOCK = 1 << 20
UNKNOWN = "und"


@functools.cache
def _fold() -> np.ndarray:
    """Code point to lower-case letter; 1 for all that is no letter."""
    out = np.ones(0x110000, np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


def _letters(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all rows end to end, runs of non-letters as one 1, and the rows' offsets."""
    try:
        codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        offs = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
    except UnicodeError:  # bytes that are no UTF-8: row by row, each such byte as a replacement character
        rows = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
        codes = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
        offs = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    codes = _fold()[codes]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 1) | (codes[:-1] != 1)
    cut = offs[:-1]
    keep[cut[cut < len(codes)]] = True
    return codes[keep], np.concatenate([[0], np.cumsum(keep)])[offs]


def gram_counts(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 1- to 3-grams of one text, ascending, and their counts. A gram packs 21 bits a character; 1 stands for a gap."""
    if not len(letters) or not (letters != 1).any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    a = np.concatenate([[1] if letters[0] != 1 else [], letters, [1] if letters[-1] != 1 else []]).astype(np.uint64)
    parts = [_block_counts(a[max(0, lo - 2) : lo + BLOCK], min(lo, 2)) for lo in range(0, len(a), BLOCK)]
    if len(parts) == 1:
        return parts[0]
    grams, back = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(back, np.concatenate([c for _, c in parts]), len(grams)).astype(np.int64)


def _block_counts(a: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the grams that end in a block, the first `before` letters being those in front of it."""
    s = np.uint64(21)
    two = (a[:-1] << s) | a[1:]
    three = (two[:-1] << s) | a[2:]
    own = a[before:]
    every = np.sort(np.concatenate([own[own != 1], two[max(0, before - 1) :], three]))
    first = np.flatnonzero(np.concatenate([every[:1] == every[:1], every[1:] != every[:-1]]))
    return every[first], np.diff(np.append(first, len(every)))


def top_grams(grams: np.ndarray, counts: np.ndarray, n: int = PROFILE) -> np.ndarray:
    """The n most frequent grams, most frequent first, ties to the smaller code."""
    return grams[np.argsort(-counts, kind="stable")[:n]]


def _count_rows(batches):
    for batch in batches:
        langs = batch.column(1).to_pylist()
        raw, offsets = text_buffer(batch.column(0))
        for lo, hi in slices_by_bytes(offsets, 2_000_000):
            a, b = offsets[lo], offsets[hi]
            letters, offs = _letters(raw[a:b], offsets[lo : hi + 1] - a)
            by: dict[str, list] = {}
            for r in range(lo, hi):
                by.setdefault(langs[r], []).append(gram_counts(letters[offs[r - lo] : offs[r - lo + 1]]))
            for lang, parts in by.items():
                grams, back = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([c for _, c in parts]), len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.view(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])


class Profiles:
    """Learned languages and the rank of each gram in each profile."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.unique(np.array([r[1] for r in rows], np.int64).view(np.uint64)) if rows else np.zeros(0, np.uint64)
        self.rank = np.full((len(self.langs), len(self.grams) + 1), -1, np.int32)
        at = np.searchsorted(self.grams, np.array([r[1] for r in rows], np.int64).view(np.uint64)) if rows else []
        where = {lang: i for i, lang in enumerate(self.langs)}
        for (lang, _, rank), k in zip(rows, at):
            self.rank[where[lang], k] = rank

    def predict(self, grams: np.ndarray) -> tuple[str, float]:
        """The nearest language and 1 - distance / largest distance; a gram missing from a profile is `size` out of place."""
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, grams)
        at[at == len(self.grams)] = len(self.grams)
        miss = (at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != grams)
        at = np.where(miss, len(self.grams), at)
        rank = self.rank[:, at]
        off = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(grams))))
        total = off.sum(axis=1)
        best = int(np.argmin(total))
        return self.langs[best], 1.0 - float(total[best]) / (self.size * len(grams))


def learn_profiles(labelled: DataFrame, size: int = PROFILE, sample: int = SAMPLE) -> list[tuple[str, int, int]]:
    """(lang, gram, rank) of the `size` most frequent grams of each language in labelled (doc_id, text, lang).

    Rows of null lang or text are left out. A language of more than `sample` documents is learned from those whose hashed doc_id and text
    fall below sample / documents, so about `sample`. What is returned is bounded by LANGUAGES x size; more labels are an error.
    """
    base = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = materialize(base.groupBy("lang").agg(F.count("*").alias("docs")), "languages")
    if sizes.count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} labels: these are no languages")
    unit = (F.xxhash64(F.lit("language sample"), "doc_id", "text").bitwiseAND(F.lit(0xFFFFFFFF)) / F.lit(float(1 << 32))).alias("u")
    # One row a language, of which there are LANGUAGES at most.
    chosen = base.join(F.broadcast(sizes), "lang").where(unit < F.lit(float(sample)) / F.col("docs")).select("text", "lang")
    counts = chosen.mapInArrow(_count_rows, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("gram"))
    best = counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size)
    return [tuple(r) for r in best.select("lang", "gram", "rank").collect()]


def _predict_rows(rows, size: int):
    def run(batches):
        profiles = Profiles(rows, size)
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            for lo, hi in slices_by_bytes(offsets, 2_000_000):
                a, b = offsets[lo], offsets[hi]
                letters, offs = _letters(raw[a:b], offsets[lo : hi + 1] - a)
                got = [profiles.predict(top_grams(*gram_counts(letters[offs[r] : offs[r + 1]]), size)) for r in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([g[0] for g in got]), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, labelled: DataFrame, size: int = PROFILE, sample: int = SAMPLE) -> DataFrame:
    """Language of every text of docs (doc_id, text), by profiles learned from labelled (doc_id, text, lang).

    Returns doc_id, lang_pred, score (0 to 1). Null texts and texts without a letter, and all texts if nothing could be learned, give
    `und` and 0. Ties go to the first language by code point. Rows repeating a doc_id are predicted each, equal texts alike.
    """
    rows = learn_profiles(labelled, size, sample)
    return docs.select("doc_id", "text").mapInArrow(_predict_rows(rows, size), "doc_id long, lang_pred string, score double")


def _keep_rows(rows, size: int, text_at: int):
    def run(batches):
        profiles = Profiles(rows, size)
        for batch in batches:
            raw, offsets = text_buffer(batch.column(text_at))
            keep = np.zeros(batch.num_rows, bool)
            for lo, hi in slices_by_bytes(offsets, 2_000_000):
                a, b = offsets[lo], offsets[hi]
                letters, offs = _letters(raw[a:b], offsets[lo : hi + 1] - a)
                for r in range(hi - lo):
                    keep[lo + r] = profiles.predict(top_grams(*gram_counts(letters[offs[r] : offs[r + 1]]), size))[0] != UNKNOWN
            yield batch.filter(pa.array(keep))

    return run


def keep_identified(docs: DataFrame, labelled: DataFrame, size: int = PROFILE, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all their columns, whose text has a language by identify(); no shuffle.

    Rejected are only null texts and texts without a letter. If nothing could be learned though docs has rows, this is an error, as every row
    would be rejected. An empty table gives no rows; rows repeating a doc_id are judged each; columns of any name pass unchanged.
    """
    rows = learn_profiles(labelled, size, sample)
    if not rows and not docs.isEmpty():
        raise ValueError("no labelled text to learn a language from")
    return docs.mapInArrow(_keep_rows(rows, size, docs.columns.index("text")), docs.schema)
