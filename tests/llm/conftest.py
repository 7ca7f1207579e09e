import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, shard string, copies int, offset long"

EN = "the of and to in that with for was this from which are have been were their there would about after other into more some".split()
FR = "le la les des une que dans pour est sur avec pas par plus ce qui ont mais comme tout être fait leur aussi".split()


def sentence(words, rng, n):
    return " ".join(rng.choice(words) + rng.choice(["", "tion", "ment", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Texts of all odd kinds: null, empty, blank, no letters, one word, repeats, near copies, a very long text, non-Latin scripts."""
    rng = random.Random(5)
    out = []
    for i in range(60):
        words, lang = (EN, "en") if i % 3 else (FR, "fr")
        out.append((i, sentence(words, rng, rng.randint(8, 120)), lang, f"src{i % 4}"))
    base = out[1][1].split()
    for i in range(60, 70):
        w = list(base)
        w[rng.randrange(len(w))] = f"changed{i}"
        out.append((i, " ".join(w), "en", "src0"))
    out += [(70 + i, out[2][1], "en", "src0") for i in range(20)]
    out += [(90, None, "en", "src1"), (91, "", "fr", None), (92, " \n\t ", None, "src1"), (93, "12 34 5.6 !!", None, None), (94, "Word", "en", "src2")]
    out += [(95, "日本語のテキスト это текст ελληνικά it's don't <|endoftext|>", None, "src3"), (96, sentence(EN, rng, 30_000), "en", "src3"), (97, "a b c d e", "en", "src1"), (98, "a b c d e", "en", "src1")]
    out += [(99, "\x1c control \x85 and \xa0 blanks", "en", "src2"), (3, out[3][1], "en", "src3"), (None, "a row without a number", "en", "src1")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", 1, 2) for r in rows], DOC).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
