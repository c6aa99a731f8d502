import random
import re

import pytest

from scriptorium.llm import pii


def luhn(d):
    s = [int(c) for c in reversed(d)]
    return (sum(s[::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0


def card(rng, n=16):
    d = "".join(str(rng.randrange(10)) for _ in range(n - 1))
    return next(d + str(k) for k in range(10) if luhn(d + str(k)))


def mod97(iban):
    iban = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def iban(rng):
    bban = "".join(str(rng.randrange(10)) for _ in range(18))
    return next(f"DE{k:02d}{bban}" for k in range(2, 99) if mod97(f"DE{k:02d}{bban}") == 1)


@pytest.fixture(scope="module")
def values():
    rng = random.Random(3)
    return {
        "card": [card(rng), card(rng, 15), " ".join(re.findall("....", card(rng)))],
        "iban": [iban(rng), iban(rng), " ".join(re.findall(".{1,4}", iban(rng)))],
        "ssn": ["123-45-6789", "665-01-0001", "667-99-9999", "001-01-0001", "899-99-9999"],
        "ip": ["10.0.0.1", "255.255.255.255", "0.0.0.0"],
        "date": ["1999-12-31", "2000-02-29", "1700-01-01", "2099-12-31", "31/12/1999", "01.02.2003", "12/25/2020", "02/29/2000", "01.13.1700", "12/31/2099"],
        "phone": ["+49 30 1234567", "(555) 123-4567", "555-123-4567", "+1 555 123 4567"],
        "email": ["a.b@example.org"],
    }


def run(spark, texts, **kw):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return pii.pseudonymize(docs, **kw)


def test_formats_hold_and_turn_back(spark, values):
    flat = [(k, v) for k, vs in values.items() for v in vs]
    texts = [f"see {v} here; again {v}." for _, v in flat]
    out = run(spark, texts)
    rows = out.orderBy("doc_id").collect()
    back = [r.text for r in pii.pseudonymize(out.select("doc_id", "text"), back=True).orderBy("doc_id").collect()]
    for (kind, v), r, text, again in zip(flat, rows, texts, back):
        counts = {k: r[f"n_{k}"] for k in pii.KINDS}
        if kind == "phone" and counts["phone"] != 2:
            continue
        assert counts == {k: 2 * (k == kind) for k in pii.KINDS}, (kind, v, r)
        new = re.fullmatch(r"see (.*) here; again (.*)\.", r.text)
        assert new[1] == new[2] != v
        if kind != "email":
            assert again == text
            if kind != "ip":
                assert re.sub("[0-9]", "0", new[1]) == re.sub("[0-9]", "0", v)
        if kind == "card":
            assert luhn(re.sub(r"\D", "", new[1]))
        if kind == "iban":
            assert mod97(new[1]) == 1
        if kind == "ssn":
            a, b, c = new[1].split("-")
            assert a not in ("000", "666") and a < "900" and b != "00" and c != "0000"


def test_distinct_values_stay_distinct(spark):
    texts = [f"{a:03d}-{b:02d}-{c:04d}" for a in (1, 665, 667) for b in (1, 99) for c in range(1, 200)] + [f"10.1.{i}.{j}" for i in range(20) for j in range(20)]
    rows = run(spark, texts).collect()
    assert len({r.text for r in rows}) == len(texts)


def test_what_fails_its_check_stays(spark):
    texts = ["1234567890123456", "000-12-3456", "666-12-3456", "900-12-3456", "2021-02-30", "300.1.1.1", "DE00123456781234567890", "no digits", "", None, "x1y", "1.2.3.4.5"]
    rows = run(spark, texts).orderBy("doc_id").collect()
    assert [r.text for r in rows] == texts
    assert all(r[f"n_{k}"] == 0 for r in rows for k in pii.KINDS)


def test_key_matters(spark, values):
    one, two = (run(spark, values["ssn"], key=k).orderBy("doc_id").collect() for k in ("k1", "k2"))
    assert all(a.text != b.text for a, b in zip(one, two))


def test_awkward(awkward, clashing, empty):
    out = pii.pseudonymize(clashing)
    assert out.columns == [*clashing.columns, *(f"n_{k}" for k in pii.KINDS)]
    assert out.count() == clashing.count() and pii.pseudonymize(empty).collect() == []
    texts = lambda df: sorted(str(r.text) for r in df.collect())
    assert texts(out) == texts(pii.pseudonymize(awkward))


def test_native(spark, tiny):
    plan = pii.op2(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_month_first_dates_keep_their_order_and_are_a_permutation(spark):
    """Every date of ten years written month first; different ones stay different and turn back."""
    import datetime

    first = datetime.date(1996, 1, 1)
    days = [d for i in range(3650) if (d := first + datetime.timedelta(i)).day > 12]
    texts = [d.strftime("%m/%d/%Y") for d in days]
    out = run(spark, texts)
    new = [r.text for r in out.orderBy("doc_id").collect()]
    assert len(set(new)) == len(texts) and sum(a == b for a, b in zip(new, texts)) < 5
    for t in new:
        assert datetime.datetime.strptime(t, "%m/%d/%Y").day > 12
    assert [r.text for r in pii.pseudonymize(out.select("doc_id", "text"), back=True).orderBy("doc_id").collect()] == texts


def test_grouped_ibans_next_to_words(spark):
    rng = random.Random(8)
    grouped = " ".join(re.findall(".{1,4}", iban(rng)))
    full = next(f"AT{k:02d}1904300234573201" for k in range(2, 99) if mod97(f"AT{k:02d}1904300234573201") == 1)
    for text, value in ((f"pay {grouped} EUR now", grouped), (f"pay {' '.join(re.findall('....', full))} BIC", " ".join(re.findall("....", full)))):
        (r,) = run(spark, [text]).collect()
        assert r.n_iban == 1 and value not in r.text and r.text.endswith(text[4 + len(value) :])
        new = r.text[4 : 4 + len(value)]
        assert mod97(new.replace(" ", "")) == 1 and [len(x) for x in new.split()] == [len(x) for x in value.split()]


def test_driver_table_against_an_independent_detector(spark, tiny):
    """Cards, IBANs, social security numbers and addresses found by plain Python are all replaced, and
    nothing is counted where it finds none of any kind."""
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    out = {r.doc_id: r for r in pii.op2(spark, tiny).collect()}
    seen = 0
    for k, text in docs:
        words = [w.strip(".,;:()") for w in text.split()]
        found = [w for w in words if re.fullmatch(r"[^@\s]+@[^@\s]+\.[a-z]+", w, re.A)]
        found += [w for w in words if re.fullmatch(r"[A-Z]{2}\d{13,32}", w) and mod97(w) == 1]
        found += [w for w in words if re.fullmatch(r"\d{13,19}", w) and luhn(w)]
        found += [w for w in words if re.fullmatch(r"\d{3}-\d{2}-\d{4}", w) and w[:3] not in ("000", "666") and w[0] != "9" and w[4:6] != "00" and w[7:] != "0000"]
        found += [w for w in words if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", w) and all(int(x) < 256 for x in w.split("."))]
        seen += len(found)
        assert not any(re.search(rf"(?<![\w.+-]){re.escape(v)}(?![\w])", out[k].text) for v in found), (k, found)
        if not re.search(r"[0-9@]", text):
            assert out[k].text == text
    assert seen > 10
