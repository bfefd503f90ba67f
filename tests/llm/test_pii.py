import datetime
import ipaddress
import random
import time

import pytest

from meridion.llm.pii import KEY_SETTING, KINDS, NAMES, Pseudonyms, luhn_digit, permute, pseudonym_report, pseudonym_stage, session_key

from .fixtures import SCHEMA, documents

KEY = b"test key"


@pytest.mark.parametrize("size", [2, 3, 10, 97, 1000, 4096])
def test_permutation(size):
    image = [permute(v, size, KEY, b"t") for v in range(size)]
    assert sorted(image) == list(range(size))
    assert [permute(v, size, KEY, b"t", True) for v in image] == list(range(size))


@pytest.mark.parametrize(
    ("text", "kind"),
    [("4111 1111 1111 1111", "card"), ("4111111111111111", "card"), ("+1 (743) 555-3824", "phone"), ("743-555-3824", "phone"), ("+44 20 7946 0958", "phone"), ("a.b-c@mail5.example.com", "email"),
     ("233.233.171.252", "ipv4"), ("2001:db8::ff00:42:8329", "ipv6"), ("GB82 WEST 1234 5698 7654 32", "iban"), ("123-45-6789", "ssn"), ("2024-02-29", "date"), ("31/12/1999", "date"), ("12/31/1999", "date"), ("1.2.2003", "date"),
     ("24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "secret")],
)
def test_kinds(text, kind):
    new, counts = Pseudonyms(KEY).replace(f"see {text}, and {text} too")
    assert {NAMES[k]: n for k, n in enumerate(counts) if n} == {kind: 2}
    first, second = new.removeprefix("see ").removesuffix(" too").split(", and ")
    assert first == second != text
    assert Pseudonyms(KEY, back=True).replace(first)[0] == text and (kind == "ipv4" or len(first) == len(text))
    if kind == "card":
        digits = "".join(c for c in first if c.isdigit())
        assert luhn_digit(digits[:-1]) == digits[-1] and len(first) == len(text)


@pytest.mark.parametrize("text", ["4111 1111 1111 1112", "000-12-3456", "256.1.1.1", "2023-02-30", "version 1.2.3", "at 12:30:45", "3.14159", "127.0.0.1", "12345", "GB83 WEST 1234 5698 7654 32"])
def test_invalid_values_stay(text):
    assert Pseudonyms(KEY).replace(f"x {text} y") == (f"x {text} y", [0] * len(NAMES))


def test_neighbours():
    new, counts = Pseudonyms(KEY).replace("4316522678525456 4111111111111111 and +1 (743) 555-3824 233.233.171.252")
    assert {NAMES[k]: n for k, n in enumerate(counts) if n} == {"card": 2, "phone": 1, "ipv4": 1}
    assert Pseudonyms(KEY, back=True).replace(new)[0] == "4316522678525456 4111111111111111 and +1 (743) 555-3824 233.233.171.252"


@pytest.mark.parametrize("text", ["+1 (017) 555-7713", "+1 (132) 555-1352", "+1 132 155 1352", "+10175557713", "+1 74 35 55 38 24", "415 555 2671", "1 415 555 2671", "(415)-555-2671", "(415).555.2671", "(415)555-2671"])
def test_phone_forms(text):
    new, counts = Pseudonyms(KEY).replace(f"call {text}, or {text} now")
    assert {NAMES[k]: n for k, n in enumerate(counts) if n} == {"phone": 2}
    first, second = new.removeprefix("call ").removesuffix(" now").split(", or ")
    assert first == second != text
    assert [c.isdigit() for c in first] == [c.isdigit() for c in text]
    assert Pseudonyms(KEY, back=True).replace(first)[0] == text


def test_phones_with_low_area_codes_stay_distinct():
    own = Pseudonyms(KEY)
    texts = [f"+1 ({a:03d}) {b}55-{c:04d}" for a in range(0, 400, 7) for b in (0, 5) for c in (17, 9000)]
    assert len({own.replace(t)[0] for t in texts}) == len(texts)
    assert all(Pseudonyms(KEY, back=True).replace(own.replace(t)[0])[0] == t for t in texts)


def test_distinct_values_stay_distinct():
    rng = random.Random(1)
    bodies = {f"4{rng.randrange(10**14):014d}" for _ in range(300)}
    cards = [b + luhn_digit(b) for b in bodies]
    own = Pseudonyms(KEY)
    assert len({own.replace(c)[0] for c in cards}) == len(cards)


def test_report_and_stage(spark):
    rows = documents() + [(3000, "mail me: joe@example.org", "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("lang", "_pii").withColumnRenamed("source", "_rest")
    out = {r.doc_id: r for r in pseudonym_report(df, KEY).collect()}
    assert len(pseudonym_report(df, KEY).collect()) == len(rows)
    assert out[3000].n_replaced == 1 and out[3000].kinds == {"email": 1} and "joe" not in out[3000].text
    staged = pseudonym_stage(df, KEY)
    assert staged.columns == df.columns
    before = {d: t for d, t, *_ in rows}
    assert all(r.text == before[r.doc_id] for r in staged.collect() if r.doc_id not in (3000, None))
    assert pseudonym_stage(df.limit(0), KEY).count() == 0


def test_one_value_has_one_pseudonym_however_written():
    own = Pseudonyms(KEY)
    new = [own.replace(t)[0] for t in ("2001:db8::ff00:42:8329", "2001:0db8:0000:0000:0000:ff00:0042:8329", "2001:DB8:0:0:0:FF00:42:8329")]
    assert len({int(ipaddress.IPv6Address(x)) for x in new}) == 1 and new[0].count(":") == 5 and len(new[1]) == 39 and new[2].upper() == new[2]
    forms = {"2024-07-31": "%Y-%m-%d", "7/31/2024": "%m/%d/%Y", "31.07.2024": "%d.%m.%Y", "31.7.2024": "%d.%m.%Y", "31/07/2024": "%d/%m/%Y"}
    dates = [own.replace(t)[0] for t in forms]
    assert len({datetime.datetime.strptime(x, form) for x, form in zip(dates, forms.values())}) == 1
    assert [len(x) for x in dates] == [10, 9, 10, 9, 10]


@pytest.mark.parametrize("year", [1904, 2001])
def test_dates_are_permuted_among_those_written_alike(year):
    own, back = Pseudonyms(KEY), Pseudonyms(KEY, back=True)
    days = [datetime.date(year, 1, 1) + datetime.timedelta(k) for k in range(0, 365, 9)]
    for form in ("{y}-{m:02d}-{d:02d}", "{m}/{d}/{y}", "{d}.{m}.{y}"):
        texts = [form.format(y=x.year, m=x.month, d=x.day) for x in days]
        new = [own.replace(t)[0] for t in texts]
        assert len(set(new)) == len(new) and [len(x) for x in new] == [len(t) for t in texts]
        assert [back.replace(x)[0] for x in new] == texts


def test_against_brute_force():
    """Every stretch of a text is tried as a value of every kind; spans are found there and nowhere else."""
    rng = random.Random(9)
    card = lambda: (b := "".join(rng.choice("0123456789") for _ in range(15))) + luhn_digit(b)
    valid = [
        lambda: ("card", card()), lambda: ("ssn", f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"), lambda: ("email", f"u{rng.randint(0, 99)}.x@h{rng.randint(0, 9)}.example.org"),
        lambda: ("ipv4", ".".join(str(rng.randint(1, 126)) for _ in range(4))), lambda: ("date", f"{rng.randint(1950, 2050)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"),
        lambda: ("phone", f"{rng.randint(2, 9)}17-555-{rng.randint(0, 9999):04d}"), lambda: ("secret", "".join(rng.choice("0123456789abcdef") for _ in range(40))),
        lambda: ("ipv6", ":".join(f"{rng.randint(1, 65535):x}" for _ in range(8))),
    ]
    wrong = ["4111 1111 1111 1112", "000-12-3456", "a@b", "@x.org", "300.1.1.1", "2023-13-01", "12:30:45", "1.2.3", "17", "deadbeef", "x--y"]
    for _ in range(60):
        parts, truth = [], []
        for _ in range(rng.randint(0, 12)):
            if rng.random() < 0.5:
                kind, value = rng.choice(valid)()
                truth.append((kind, value))
                parts.append(value)
            else:
                parts.append(rng.choice(wrong))
            parts.append(rng.choice([" and ", ", so ", "; ", " (x) ", "\n"]))
        text = "".join(parts)
        spans = Pseudonyms(KEY).spans(text)
        assert [(NAMES[k], text[a:b]) for a, b, k, _ in spans] == truth
        changes = {name: change for name, _, change in KINDS}
        assert [new for *_, new in spans] == [changes[kind](value, KEY, False) for kind, value in truth]
        assert Pseudonyms(KEY, back=True).replace(Pseudonyms(KEY).replace(text)[0])[0] == text


def test_very_long_texts_and_keys():
    own = Pseudonyms(KEY)
    for text in ["a" * 500_000 + " x@y", "a." * 200_000 + "@b", "1 " * 200_000, "1:" * 200_000, "(555) " * 60_000, "f" * 500_000, "+1 23" * 60_000, "@" * 200_000, "1.2." * 100_000]:
        began = time.time()
        own.spans(text)
        assert time.time() - began < 10
    many = " ".join(f"u{k}@example.org" for k in range(30_000))
    began = time.time()
    assert len(own.spans(many)) == 30_000 and time.time() - began < 30


def test_key_of_the_session(spark):
    df = spark.createDataFrame([(1, "joe@example.org")], "doc_id long, text string")
    with pytest.raises(ValueError, match="key"):
        pseudonym_report(df, b"")
    assert session_key(spark) == session_key(spark) and len(session_key(spark)) == 32
    spark.conf.set(KEY_SETTING, "named")
    assert session_key(spark) == b"named"
    spark.conf.unset(KEY_SETTING)
