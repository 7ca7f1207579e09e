"""Each kind of personal data against plain Python, and the forms in which it stands in prose."""

import hashlib
import random
import re
from datetime import date, timedelta

from loomgraph.llm import pii
from test_pii_whole import iban
from test_text_ops import feistel, permute

KEY = "k"


def digest(*parts):
    return hashlib.sha256("|".join([KEY, *parts]).encode()).hexdigest()


def refill(text, digits):
    it = iter(digits)
    return re.sub("[0-9]", lambda _: next(it), text)


def brute_iban(one):
    body = one[4:]
    new = refill(body, permute(re.sub("[^0-9]", "", body), KEY, "iban"))
    n = int("".join(str(int(c, 36)) for c in f"{new}{one[:2]}00"))
    return f"{one[:2]}{98 - n % 97:02d}{new}"


def brute_ssn(one):
    area, group, serial = map(int, one.split("-"))
    a, b = feistel((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999, KEY, "ssn")
    area = a // 99 + 1
    return f"{area + (area >= 666):03d}-{a % 99 + 1:02d}-{b + 1:04d}"


def brute_mail(one):
    local, host = one.lower().split("@")
    return f"u{digest('local', local)[:16]}@h{digest('host', host)[:16]}.example"


def brute_secret(value):
    new = (digest("secret", value.lower()) * 9)[: len(value)]
    return new.upper() if re.fullmatch("[^a-z]*[A-Z][^a-z]*", value) else new


def brute_date(day):
    for first, days in pii.ERAS:
        x = (day - date.fromisoformat(first)).days
        if 0 <= x < days:
            side, tweak = (300, "date") if days == pii.DAYS else (int((days * 5 // 4) ** 0.5), f"date {first}")
            while True:
                p, q = feistel(x // side, x % side, side, side, KEY, tweak)
                x = p * side + q
                if x < days:
                    return date.fromisoformat(first) + timedelta(x)


def test_kinds_against_plain_python(spark):
    rng = random.Random(7)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    cases = []
    for _ in range(40):
        one = iban("DE", num(18))
        cases.append((f"to {one}.", f"to {brute_iban(one)}."))
        one = iban("GB", "".join(rng.choice("ABCDWXYZ") for _ in range(4)) + num(14))
        cases.append((f"to {one},", f"to {brute_iban(one)},"))
        one = f"{rng.choice([1, 665, 667, 899, rng.randint(1, 665)]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
        cases.append((f"ssn {one}.", f"ssn {brute_ssn(one)}."))
        one = f"{rng.choice('abc')}.{num(2)}@{rng.choice(['Foo', 'mail3.bar'])}.{rng.choice(['com', 'org'])}"
        cases.append((f"mail {one}{(end := rng.choice(['', '.', '...', ', ', '. And', '>']))}", f"mail {brute_mail(one)}{end}"))
        one = "".join(rng.choice(rng.choice(["ABCDEF", "abcdef0123", "ABC123"])) for _ in range(rng.randint(16, 90)))
        cases.append((f"api_key = {one}", f"api_key = {brute_secret(one)}"))
        day = date(rng.choice([4, 1066, 1899, 1900, 2099, 2100, 9999]), rng.randint(1, 12), rng.randint(1, 28))
        cases.append((f"on {day.isoformat()} and", f"on {brute_date(day).isoformat()} and"))
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in pii.pseudonymize(df, KEY).collect()}
    assert got == {i: b for i, (_, b) in enumerate(cases)}


def test_ssn_is_a_bijection_of_valid_numbers():
    some = {f"{a:03d}-{g:02d}-{s:04d}" for a in (1, 2, 665, 667, 899) for g in (1, 50, 99) for s in (1, 2, 9999)}
    out = {brute_ssn(x) for x in some}
    assert len(out) == len(some) and all(0 < int(x[:3]) < 900 and x[:3] != "666" and x[4:6] != "00" and x[7:] != "0000" for x in out)


def test_one_phone_in_many_spellings(spark):
    same = [["+33 612345678", "+33612345678", "+33 6 12 34 56 78", "+33-612-345-678"], ["+1 (663) 555-6869", "+1 663 555 6869", "(663) 555-6869", "663-555-6869"], ["+351 212 345 678", "+351212345678"]]
    rows = [(10 * k + i, f"call {p}!") for k, ps in enumerate(same) for i, p in enumerate(ps)]
    out = {r.doc_id: r for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    for k, ps in enumerate(same):
        got = [re.sub("[^0-9]", "", out[10 * k + i].text) for i in range(len(ps))]
        national = {g[-10:] if k == 1 else g for g in got}
        assert len(national) == 1 and all(out[10 * k + i].pii_kinds == ["phone"] for i in range(len(ps))), (ps, got)
        assert not any(re.sub("[^0-9]", "", p) in got for p in ps)


def test_odd_forms(spark):
    texts = ["a.b@foo.com.", "x@y", "x@y.z", "mail " + "a@" + "b." * 3000 + "com", "a@b.c-d.org.", "@@@ 1.2.3 2021-13-01 0000-01-01 12.12.12", "a" * 200_000 + "@foo.com", ("1234 " * 50_000) + "a.b@foo.com"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pii_matches string")
    out = {r.doc_id: r for r in pii.pseudonymize(df, KEY).collect()}
    assert [out[i].pii_kinds for i in range(len(texts))] == [["email"], [], [], [], ["email"], [], ["email"], ["email"]]
    assert all(r.pii_matches == "x" for r in out.values()) and out[0].text == brute_mail("a.b@foo.com") + "."


def test_clean_prose_is_left_alone(spark):
    """No figure of ordinary prose is taken for personal data."""
    clean = ["Version 3.11.2 of 4 parts, pp. 12-15, 1,234,567 items at 19.99 EUR", "in 1999-2000 and 10:30", "ISBN 978-3-16-148410-0", "order 4111111111111112", "see 10.1000/182", "call 12345", "DE89370400440532013001", "ratio 3/4/5", "secret: short", "the token is here", "user@localhost", "room 12-34-5678"]
    df = spark.createDataFrame(list(enumerate(clean)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.pseudonymize(df, KEY).collect()} == dict(enumerate(clean))
