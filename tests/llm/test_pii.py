import random

import brute
import pytest

from siltworks.llm import pii
from siltworks.llm.queries import QUERIES

ODD = [
    None, "", "a@b.c", "x a@b.c_d@e.f y", "..@x.y", "a@.b.c", "a@b..c", "a@b.c..d@e.f.", "a@b.c.@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.3.0004",
    "4111 1111 1111 1111", "4111-1111--1111-1111", "4111111111111111 4111 1111 1111 1111", "+1 (555) 010-9999 x +49", "+123456789 +1.2.3", "\x01a@b.c\x02\x03d@e.f\x03.g@h.i",
    "é 😀 a@b.c 😀 10.0.0.1", "DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432", "a" * 5000 + "@b.c", "1 " * 20000, "b." * 20000, "a@" + "b." * 20000 + "c", "1.1.1." * 5000, "+1" + " " * 20000,
]


def random_texts(n):
    r = random.Random(5)
    parts = ["a", "b1", "@", ".", "-", " ", "_", "+", "12", "4111", "1111", "255", "256", "(", ")", "é", "\n", "%", "\x01", "\x03", "0"]
    return ["".join(r.choice(parts) for _ in range(r.randint(1, 60))) for _ in range(n)]


def test_base_spans_match_plain_regexes(spark, docs, sf_dir):
    texts = ODD + random_texts(3000)
    rows = pii.digest(docs(list(enumerate(texts)))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == brute.pii_row(texts[r.doc_id]), repr(texts[r.doc_id][:200])
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    added = 0
    for r in QUERIES["op9_pii"](spark, "/root/testdata/sf0.01").collect():
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == brute.pii_row(texts[r.doc_id])
        found = [x for x in r.spans.split(",") if x.startswith("secret")]
        assert found == brute.secrets(texts[r.doc_id])
        added += len(found)
    assert added > 5


def test_secrets_need_context_and_both_kinds_of_characters(docs):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [f'token = "{key}"', f"the hash {key} of it", f"{key} is my password", "token abcdefghijabcdefghijabcdefghij", f"tokens {key}", f"api_key={key[:19]}", f"API-KEY: {key[:20]} x"]
    rows = pii.digest(docs(list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [[x for x in r.spans.split(",") if x.startswith("secret")] for r in rows] == [brute.secrets(t) for t in texts]
    assert [bool(brute.secrets(t)) for t in texts] == [True, False, True, False, False, False, True]


@pytest.mark.parametrize("n", [127, 128, 129, 255, 256, 257, 40000])
def test_many_spans_in_one_text(docs, n):
    text = "a@b.cd, " * n
    r = pii.digest(docs([(1, text)])).first()
    assert (r.n_email, r.base_sha256) == (n, brute.pii_row(text)[4])


def test_iban_and_context(docs):
    rows = pii.digest(docs([(1, "IBAN: DE89 3704 0044 0532 0130 00."), (2, "DE89 3704 0044 0532 0130 01"), (3, "GB82WEST12345698765432")])).orderBy("doc_id").collect()
    assert rows[0].spans == "iban:6:33" and rows[0].scores == "1.0"
    assert "iban" not in rows[1].spans
    assert rows[2].spans == "iban:0:22" and rows[2].scores == "0.8"


def test_iban_ends_before_other_upper_case(docs):
    texts = {
        "DE89 3704 0044 0532 0130 00 EUR 20": ["iban:0:27"],
        "DE89370400440532013000 BIC COBADEFFXXX": ["iban:0:22"],
        "DE89370400440532013000 GB82 WEST 1234 5698 7654 32": ["iban:0:22", "iban:23:50"],
        "AB12 3456 DE89 3704 0044 0532 0130 00": ["iban:10:37"],
        "DE89 3704 0044 0532 0130 00EUR": [],
        "DE89 3704 0044 0532 0130 01 EUR 20": [],
    }
    rows = list(enumerate(texts))
    found = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("iban")] for r in pii.digest(docs(rows)).collect()}
    assert found == dict(enumerate(texts.values()))
    assert pii.redact(docs([(1, "pay DE89370400440532013000 BIC COBADEFFXXX")])).first().text == "pay <IBAN> BIC COBADEFFXXX"


def test_redact_and_edge_rows(spark, docs):
    out = pii.redact(docs([(None, "mail a@b.c now"), (1, None), (1, None)])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == [(0, "mail <EMAIL> now"), (1, ""), (1, "")]
    assert pii.digest(docs([(1, "a")]).limit(0)).count() == 0


@pytest.mark.parametrize("number,ok", [("4111111111111111", True), ("4111111111111112", False), ("0000000000000", True)])
def test_luhn(spark, number, ok):
    from pyspark.sql import functions as F

    assert spark.range(1).select(pii.luhn(F.lit(number)).alias("x")).first().x is ok


def test_columns_named_like_working_ones_stay(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd", "kept", "too", 3)], "doc_id long, text string, __t string, __email string, ___w int")
    out = pii.redact(df)
    assert out.columns == df.columns and tuple(out.first()) == (1, "mail <EMAIL>", "kept", "too", 3)
    assert {"__t", "__email", "___w", "pii"} <= set(pii.find_pii(df).columns)
