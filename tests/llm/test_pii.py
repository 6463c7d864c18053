"""Pseudonyms: valid in their format, equal for equal values, one-to-one; the rest untouched."""

from __future__ import annotations

import datetime as dt
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lakeward.llm import pii
from lakeward.llm.queries import QUERIES

from llm_cases import AWKWARD, SMALL, docs_of, plan_of_frame  # noqa: F401


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def iban_ok(value):
    plain = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def replaced(spark, *texts, **options):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = pii.pseudonymize(frame, found_col="kinds", **options).orderBy("doc_id").collect()
    return [(r.text, r.kinds) for r in out]


VALUES = {
    "email": ["was.91@mail6.example.com", "Jo.Do+x@EXAMPLE.co.uk"],
    "card": ["4111111111111111", "4111 1111 1111 1111", "3782-822463-10005", "378282246310005"],
    "phone": ["+1 (017) 555-7713", "+44 20 7946 0958", "(212) 555-0187", "555-123-4567"],
    "ip": ["192.168.0.1", "8.8.8.8", "255.255.255.255"],
    "date": ["2024-02-29", "31/12/1999", "12/31/1999", "01.05.2001"],
    "iban": ["DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19"],
    "ssn": ["123-45-6789"],
    "secret": ["24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "0a1b2c3d" * 25, "0A1B2C3D" * 60 + "7"],
    "ipv6": ["2001:0db8:85a3:0000:0000:8a2e:0370:7334", "2001:db8::1", "fe80::1", "2001:db8:85a3::8a2e:370:7334", "2001:db8::"],
}
SHAPE = str.maketrans({**dict.fromkeys("0123456789", "9")})


@pytest.mark.parametrize("kind", sorted(VALUES))
def test_each_kind_keeps_its_format(spark, kind):
    texts = [f"Ask at {v}, please." for v in VALUES[kind]]
    for value, (text, kinds) in zip(VALUES[kind], replaced(spark, *texts)):
        new = re.fullmatch(r"Ask at (.*), please\.", text)[1]
        assert kinds == [kind] and new != value
        if kind not in ("ip", "secret", "ipv6"):
            assert new.translate(SHAPE).upper().translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "X" * 26)) == value.translate(
                SHAPE
            ).upper().translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "X" * 26))
        if kind == "card":
            assert luhn(new)
        if kind == "iban":
            assert iban_ok(new) and new[:2] == value[:2]
        if kind == "ip":
            assert all(0 <= int(o) <= 255 for o in new.split("."))
        if kind == "date":
            patterns = ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d.%m.%Y"]
            assert any(_parses(new, p) for p in patterns)
        if kind == "phone" and value.startswith("+"):
            assert new.split(" ")[0] == value.split(" ")[0]


def _parses(text, pattern):
    try:
        dt.datetime.strptime(text, pattern)
        return True
    except ValueError:
        return False


def test_values_that_fail_their_check_stay(spark):
    texts = [
        "4111111111111112", "0000000000000000", "300.1.2.3", "2023-02-29", "DE89370400440532013001",
        "abcd::beef", "a::b", "12::30", "Ada::Bec::add", "1:2:3:4:5:6:7::8:9",
        "000-45-6789", "1.2.3", "version 2.0.1", "12345", "a@b", "1990-2000", "31/31/2000", "3.14159265358979",
    ]
    assert replaced(spark, *texts) == [(t, []) for t in texts]


def test_equal_values_stay_linked_and_different_ones_apart(spark):
    card = "4111111111111111"
    out = replaced(spark, f"a {card} b {card}", f"{card}!", f"{card[:4]} {card[4:8]} {card[8:12]} {card[12:]}")
    first = re.findall(r"\d{16}", out[0][0])
    assert first[0] == first[1] == re.findall(r"\d{16}", out[1][0])[0] == out[2][0].replace(" ", "")
    octets = [f"10.0.{i}.{j}" for i in range(8) for j in range(50)]
    new = replaced(spark, " ".join(octets))[0][0].split(" ")
    assert len(set(new)) == len(octets)
    days = [(dt.date(2000, 1, 1) + dt.timedelta(d)).isoformat() for d in range(400)]
    new = replaced(spark, " ".join(days))[0][0].split(" ")
    assert len(set(new)) == len(days)


def test_key_decides(spark):
    assert replaced(spark, "8.8.8.8", key="a") != replaced(spark, "8.8.8.8", key="b")


def test_neighbours_and_noise(spark):
    a, b = "4111111111111111", "5500005555555559"
    text, kinds = replaced(spark, f"{a} {b} x.1@m.example.com###\n+1 (017) 555-7713***")[0]
    assert kinds == ["card", "card", "email", "phone"]
    assert a not in text and b not in text and "x.1@" not in text and "7713" not in text[-12:]
    assert text.endswith("***") and "###\n+1 (" in text


def test_every_ordered_pair_of_values_side_by_side(spark):
    values = [(kind, v) for kind in VALUES for v in VALUES[kind]]
    pairs = [(a, b) for a in values for b in values]
    alone = dict(zip([v for _, v in values], replaced(spark, *[v for _, v in values])))
    out = replaced(spark, *[f"{a} {b}" for (_, a), (_, b) in pairs])
    wrong = [
        (a, b, got)
        for ((kind, a), (other, b)), got in zip(pairs, out)
        if got != (f"{alone[a][0]} {alone[b][0]}", [kind, other])
    ]
    assert not wrong


def test_a_failed_candidate_hides_no_value(spark):
    texts = [
        "+1 (826) 555-4081 190.137.223.204", "+1 (843) 555-7672 170.106.47.218", "+1 555-123-4567 2024-01-31",
        "2024 4111 1111 1111 1111", "1999 2024 4111 1111 1111 1111", "AB12 4111 1111 1111 1111",
        "DE12 4111 1111 1111 1111 22", "1-800-555-1234", "+1 555 123-4567",
        "+1 (017) 555-7713 4111 1111 1111 1111 5500 0055 5555 5559",
    ]
    kinds = [["phone", "ip"], ["phone", "ip"], ["phone", "date"], *[["card"]] * 4, ["phone"], ["phone"], ["phone", "card", "card"]]
    out = replaced(spark, *texts)
    assert [k for _, k in out] == kinds
    assert all(old[-5:] != new[-5:] for old, (new, _) in zip(texts, out) if not old.endswith(" 22"))
    assert [new[: len(new) - 19] for new, _ in out[3:6]] == ["2024 ", "1999 2024 ", "AB12 "]


def test_very_long_runs(spark):
    texts = ["x@a" + ".a" * 200_000, "4" * 300_000, "1.2." * 100_000, "+1 " * 100_000, "A1" * 200_000, "a@" * 100_000, "f" * 400_000]
    out = replaced(spark, *texts)
    assert [len(t) for t, _ in out] == [len(t) for t in texts]
    hex_runs = [1, 4, 6]  # digits, or letters of one case to F: secrets of any length
    assert out[0][1] == ["email"] and [out[i] for i in (2, 3, 5)] == [(texts[i], []) for i in (2, 3, 5)]
    assert all(out[i][1] == ["secret"] and len(set(out[i][0])) == 16 for i in hex_runs)


def test_borders_after_letters(spark):
    texts = ["tel+1 (017) 555-7713", "tel(212) 555-0187", "am2024-02-29", "x192.168.0.1", "no4111111111111111", "_a.b@mail.example.com"]
    kinds = ["phone", "phone", "date", "ip", "card", "email"]
    assert [k for _, k in replaced(spark, *texts)] == [[k] for k in kinds]


@pytest.mark.parametrize("count", [1, 255, 256, 257, 700])
def test_blocks_of_candidates(spark, count):
    """Every value as alone, and what lies between them kept, across the borders of blocks."""
    days = [(dt.date(1990, 1, 1) + dt.timedelta(i)).isoformat() for i in range(count)]
    alone = [t for t, _ in replaced(spark, *days)]
    gaps = [f" <{i}> " for i in range(count)]
    text, kinds = replaced(spark, "".join(g + d for g, d in zip(gaps, days)) + " end")[0]
    assert text == "".join(g + d for g, d in zip(gaps, alone)) + " end" and kinds == ["date"] * count


def plain_text_permutation(value, alphabets, key, kind):
    """The network on characters, written with hashlib."""
    half = len(value) // 2
    left, right = value[:half], value[half:]

    def shifted(part, other, turn):
        noise = bytes.fromhex(hashlib.sha512(f"{key}|{kind}|{turn}|{other}".encode()).hexdigest())
        out = []
        for at, c in enumerate(part):
            for letters in alphabets:
                if c in letters:
                    c = letters[(letters.index(c) + noise[at % 64]) % len(letters)]
                    break
            out.append(c)
        return "".join(out)

    for turn in range(pii.ROUNDS):
        if turn % 2 == 0:
            left = shifted(left, right, turn)
        else:
            right = shifted(right, left, turn)
    return left + right


def test_against_a_plain_network(spark):
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    emails = ["was.91@mail6.example.com", "Jo.Do+x@EXAMPLE.co.uk"]
    secrets = VALUES["secret"]
    got = [t for t, _ in replaced(spark, *emails, *secrets)]
    expected = [plain_text_permutation(e, [digits, lower, lower.upper()], pii.KEY, "email") for e in emails]
    for value in secrets:
        small = value.lower()
        parts = [small[i : i + 128] for i in range(0, len(small), 128)]
        new = "".join(plain_text_permutation(p, [digits + "abcdef"], pii.KEY, f"secret{n or ''}") for n, p in enumerate(parts))
        expected.append(new.upper() if value != small else new)
    assert got == expected


def test_awkward_rows_and_clashing_columns(docs_of):
    docs = docs_of(AWKWARD).withColumnRenamed("source", "kinds").withColumn("new", F.lit(1))
    out = pii.pseudonymize(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert pii.pseudonymize(docs_of([])).count() == 0


def test_query_leaves_no_value_and_no_clean_text_changed(spark, plan_of_frame):
    out = QUERIES["op10_pii"](spark, SMALL)
    assert not re.search("Python|Pandas|Arrow", plan_of_frame(out))
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = out.collect()
    assert len(rows) == len(before)
    for r in rows:
        old = before[r.doc_id]
        private = re.findall(r"[\w.]+@[\w.]+\w|\+1 \(\d{3}\) \d{3}-\d{4}", old)
        private += [c for c in re.findall(r"(?<!\d)\d{16}(?!\d)", old) if luhn(c)]
        assert not [v for v in private if v in r.text]
        if not r.kinds:
            assert r.text == old
