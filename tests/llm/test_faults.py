"""Cases that were once wrong."""

import random
import re

import pytest

from lakeload.llm import fingerprint, pii, secrets, urlfilter
from lakeload.llm.queries import RULES

KEY = b"k" * 16


def test_a_comma_or_control_character_in_a_host_closes_no_label(spark):
    urls = [
        "http://example,foo.com/en/x", "http://www,x.example.com/en/", "http://com,/x", "http://a\x00example.com/en/",
        "http://\x01.example.com/en/", "http://x.www\x01.example.com/en/",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(RULES, urlfilter.RULE_SCHEMA)
    found = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages, rules).collect()}
    under = ("example.com/en/", "block")
    assert found == {0: ("com/", "allow"), 1: under, 2: (None, "allow"), 3: ("com/", "allow"), 4: under, 5: under}


def test_equal_dates_stay_equal_in_all_formats():
    for day in (1, 12, 13, 25, 28):
        for month in (1, 2, 12):
            made = pii.pseudonym("date", f"2019-{month:02d}-{day:02d}", KEY)
            y, m, d = made.split("-")
            assert pii.pseudonym("date", f"{day:02d}.{month:02d}.2019", KEY) == f"{d}.{m}.{y}"
            assert pii.pseudonym("date", f"{month:02d}/{day:02d}/2019", KEY) == f"{m}/{d}/{y}"
            if day > 12:
                assert pii.pseudonym("date", f"{day:02d}/{month:02d}/2019", KEY) == f"{d}/{m}/{y}"


def test_equal_phone_numbers_stay_equal_however_spaced():
    for numbers in (
        ["+14765556291", "+1 476 555 6291", "+1 (476) 555-6291", "+1-476-555-6291"],
        ["+44 20 7946 0958", "+44 2079 46 0958", "+442079460958"],
        ["+353 12 345 678", "+35312345678"],
    ):
        made = {re.sub(r"\D", "", pii.pseudonym("phone", n, KEY)) for n in numbers}
        assert len(made) == 1
        code = re.match(r"1|44|353", re.sub(r"\D", "", numbers[0])).group()
        assert made.pop().startswith(code)


def test_long_local_parts_are_replaced_whole():
    for size in (3, 63, 64, 65, 70, 200, 5000):
        local = "ab1" * size
        ((start, end, kind, made),) = pii.find(f"write to {local}@mail.example.org now", KEY)
        assert (start, end, kind) == (9, 9 + len(local) + 17, "email")
        assert len(made) == end - start and not made.startswith(local[:6])
    assert [s[:2] for s in pii.find("__.a@b.org x@y.net @z.com", KEY)] == [(3, 10), (11, 18)]


@pytest.mark.parametrize(
    "text, spans",
    [
        ("see https://example.com/docs/reference/configuration/options/index for more", ""),
        ("user_id=" + "Ab1/" * 9, ""),
        ("user_id=someone password: Ab1+Ab1+Ab1+x", "account:0:15,assign:16:39"),
        ("token=abcdef1 at https://api.example.com/v1 for user_id=someone", "short:0:13,endpoint:17:43,account:48:63"),
    ],
)
def test_no_span_is_its_own_complement(spark, text, spans):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert secrets.scan(docs).first().spans == spans


def test_ids_in_text_are_in_their_own_order(spark):
    rows = [(name, f"text of {name} " * 4) for name in ["b", "a", "é", "a1", "", "Z", "10", "9"]] + [(None, "none")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    for ranges in (5000, 2):
        dealt = fingerprint.ranges_with_next(docs, rows=ranges).collect()
        assert sorted((r.doc_id or "") for r in dealt if not r.follower) == sorted((i or "") for i, _ in rows)
    got = {r.doc_id: r for r in fingerprint.compare_with_edits(docs).collect()}
    order = [None, "", "10", "9", "Z", "a", "a1", "b", "é"]
    plain = dict(rows)
    for i, after in zip(order, order[1:] + order[:1]):
        edit = fingerprint.edited(plain[i], plain[after])
        assert got[i].edited_sha256 == __import__("hashlib").sha256(edit.encode()).hexdigest()


def test_texts_are_rewritten_value_by_value(spark, frame):
    """Planted values against their own pseudonyms, with everything between them as it was."""
    pick = random.Random(9)

    def digits(n):
        return "".join(pick.choices("0123456789", k=n))

    def card():
        body = pick.choice("3456") + digits(14)
        return body + str(pii.luhn(body))

    makers = {
        "email": lambda: f"{pick.choice(['ann', 'b.c', 'Dee-9'])}{digits(2)}@host{digits(1)}.example.org",
        "card": card,
        "date": lambda: f"{pick.randrange(1950, 2030)}-{pick.randrange(1, 13):02d}-{pick.randrange(1, 29):02d}",
        "ip": lambda: ".".join(str(pick.randrange(256)) for _ in range(4)),
        "ssn": lambda: f"{pick.randrange(100, 600)}-{pick.randrange(10, 99)}-{pick.randrange(1000, 9999)}",
        "phone": lambda: f"+1 {pick.randrange(200, 999)} {pick.randrange(200, 999)} {digits(4)}",
    }
    rows, expected = [], {}
    for i in range(60):
        text, made, counts = "start", "start", dict.fromkeys(pii.KINDS, 0)
        for _ in range(pick.randrange(0, 8)):
            kind = pick.choice(list(makers))
            value = makers[kind]()
            between = pick.choice([" and ", " (", "\n", " é 漢字 ", ", then "])
            after = ")" if between == " (" else " end"
            text += between + value + after
            made += between + pii.pseudonym(kind, value, KEY) + after
            counts[kind] += 1
        rows.append((i, text))
        expected[i] = (made, *counts.values())
    got = {r.doc_id: tuple(r)[1:] for r in pii.pseudonymize(frame(rows), KEY).collect()}
    assert got == expected
