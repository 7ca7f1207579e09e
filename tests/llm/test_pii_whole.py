import random

from loomgraph.llm import pii


def iban(country, bban):
    n = int("".join(str(int(c, 36)) for c in f"{bban}{country}00"))
    return f"{country}{98 - n % 97:02d}{bban}"


def test_text_after_an_iban_is_no_part_of_it(spark):
    rng = random.Random(1)
    every = [iban(c, "".join(rng.choice("0123456789") for _ in range(n - 4))) for n, cs in pii.IBAN_LENGTHS.items() for c in cs.split()]
    every += ["ES9121000418450200051332", "SE4550000000058398257466", "CZ6508000000192000145399", "AT611904300234573201", "LT121000011101001000", "BE68539007547034"]
    tails = [" BIC CAIXESBB", " 12.50 EUR", " 2024 IBAN", ""]
    rows = []
    for k, one in enumerate(every):
        for spaced in (one, " ".join(one[i : i + 4] for i in range(0, len(one), 4))):
            rows += [(len(rows), f"pay {spaced}{tail}", spaced, tail) for tail in tails]
    df = spark.createDataFrame(rows, "doc_id long, text string, iban string, tail string").repartition(4)
    for r in pii.pseudonymize(df, "k").collect():
        assert r.pii_kinds == ["iban"] and r.text.startswith("pay ") and r.text.endswith(r.tail), r
        new = r.text[4 : len(r.text) - len(r.tail)]
        flat = new.replace(" ", "")
        assert new != r.iban and [c == " " for c in new] == [c == " " for c in r.iban]
        assert int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def test_what_follows_an_iban_is_searched(spark):
    texts = [
        ("ES91 2100 0418 4502 0005 1332 10.0.0.1", ["iban", "ip"]),
        ("AT61 1904 3002 3457 3201 DE89 3704 0044 0532 0130 00", ["iban", "iban"]),
        ("BE68 5390 0754 7034 4532 0151 1283 0366", ["iban", "card"]),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.pii_kinds for r in pii.pseudonymize(df, "k").collect()} == {i: k for i, (_, k) in enumerate(texts)}


def test_secrets_of_letters_only(spark):
    texts = ["password: CorrectHorseBatteryStaple", "api_key=AbCdEfGhIjKlMnOpQrSt", 'Access-Key = "abcdefghijklmnopqrst" and more', "a TOKEN:abcdefghijklmnopqrst"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10 + i, f"7 {t}") for i, t in enumerate(texts)] + [(20, "no secret: here"), (21, "password: short")]
    out = {r.doc_id: r for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    for i, t in enumerate(texts):
        assert out[i].pii_kinds == ["secret"] and out[i].text != t and out[10 + i].text == f"7 {out[i].text}"
    assert out[20].text == "no secret: here" and out[21].text == "password: short"
