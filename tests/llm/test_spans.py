"""Secrets and personal data against plain Python patterns."""

import random
import time

import pytest
from barloom.llm import pii, secret_scan, spans
from pyspark.sql import functions as F
from tests.llm.reference_rules import personal, secrets

ALPHABET = ["a", "B", "é", "😀", " ", " ", "\n", ".", "-", "@", "+", "1", "23", "4567", "255", "256", "0", "(", ")", "_", "%", "a.b", "x@y.z", "AKIA", "ABCDEFGH1234567890", "token", "API_KEY", "apikey", "secret", "Passwd", "=", ":", '"', "'", "abcdef0123456789abcdef01", "4111111111111111", "5500 0000 0000 0004", "value1", "192.168.0.1", "ſ", "K", "+1 (743) 555-3824"]


def texts():
    draw = random.Random(5)
    made = ["".join(draw.choice(ALPHABET) for _ in range(draw.randrange(1, 40))) for _ in range(3000)]
    return [*made, "", " ", "token = " * 5, "1" * 40_000 + ".", "a" * 60_000 + "@", "secret=token: abcdef", "a@b.c_x@d.e", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "1 " * 3000, "+1 " + "(" * 3000, "a@" + "b." * 1000 + "c"]


def frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_base_secrets_equal_plain_patterns(spark):
    rows = texts()
    out = frame(spark, rows).select("doc_id", secret_scan.found_in(F.col("text")).alias("spans")).collect()
    for r in out:
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in secret_scan.BASE] == secrets(rows[r["doc_id"]]), rows[r["doc_id"]]


def test_base_personal_data_equal_plain_patterns(spark):
    rows = texts()
    out = pii.find(frame(spark, rows), keep=["doc_id"]).collect()
    for r in out:
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in pii.BASE] == personal(rows[r["doc_id"]]), rows[r["doc_id"]][:200]


def test_ledger_scans_only_new_pairs_and_returns_findings_to_all_paths(spark):
    key = "token = abcdef123456"
    first = spark.createDataFrame([("a", key), ("b", key), (None, key), ("c", None), ("c", None), ("d", "x")], "path string, text string")
    found, ledger = secret_scan.scan(first)
    got = sorted((str(r["path"]), spans_text(r)) for r in found.collect())
    assert got == [("None", "assign:0:20"), ("a", "assign:0:20"), ("b", "assign:0:20"), ("c", ""), ("c", ""), ("d", "")]
    assert ledger.count() == 3
    second = spark.createDataFrame([("e", key, 1), ("f", "AKIA" + "Z" * 16, 2)], "path string, text string, blob int")
    found, after = secret_scan.scan(second, ledger)
    assert sorted((r["path"], spans_text(r)) for r in found.collect()) == [("e", "assign:0:20"), ("f", "access:0:20")]
    assert after.count() == 4
    assert secret_scan.scan(second, ledger, rules_version=2)[1].where("rules_version = 2").count() == 2
    empty, _ = secret_scan.scan(first.limit(0))
    assert empty.count() == 0


def spans_text(row):
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in row["spans"])


def test_redaction_keeps_rows_and_columns(spark):
    rows = [(1, "mail a@b.com or +1 (743) 555-3824 now", 7), (1, "mail a@b.com or +1 (743) 555-3824 now", 7), (None, None, None), (3, "", 1), (4, "nothing here", 2)]
    out = pii.redact(spark.createDataFrame(rows, "doc_id long, text string, spans int"))
    assert out.columns == ["doc_id", "text", "spans"]
    assert sorted(str(r["spans"]) for r in out.collect()) == ["1", "2", "7", "7", "None"]
    assert sorted(str(r["text"]) for r in out.collect()) == ["", "None", "mail <EMAIL> or <PHONE> now", "mail <EMAIL> or <PHONE> now", "nothing here"]


def test_look_alikes_need_support(spark):
    rows = [f"call {200 + k}-555-{1000 + k} today, mail u{k}@site{k}.com" for k in range(50)] + ["nothing personal 12-34"] * 20
    out = {r["doc_id"]: spans_text(r) for r in pii.find(frame(spark, rows), keep=["doc_id"]).collect()}
    assert all("email:" in out[k] for k in range(50)) and not any(out[k] for k in range(50, 70))


def test_joined_order(spark):
    row = spark.range(1).select(spans.joined(F.array().cast(f"array<{spans.SPAN}>")).alias("x")).collect()[0]
    assert row["x"] == ""


MILLION = 1_000_000
#: Texts that a pattern which tries each place of a run anew, or recurses for each part, could not get through; and their base spans.
LONG = {
    "parts": ("x a@b" + ".c" * MILLION, [("email", 2, 5 + 2 * MILLION)]),
    "digits": ("1" * MILLION + ". @ + eyJ", []),
    "numbers": ("1 " * (MILLION // 2) + ".+@", []),
    "addresses": ("12." * 60_000 + "@+", [("ip", 12 * k, 12 * k + 11) for k in range(15_000)]),
    "dials": ("+1 " * (MILLION // 3) + "@.", []),
    "letters": ("a" * MILLION + "@.+", []),
    "token starts": ("eyJa" * (MILLION // 4) + ".eyJ @", []),
    "names": ("token" * (MILLION // 5) + "=", []),
    "marks": ("xoxa-" * (MILLION // 5) + " AKIA" * 1000, []),
}


@pytest.mark.parametrize("name", LONG)
def test_long_texts_take_seconds(spark, name):
    text, expected = LONG[name]
    began = time.monotonic()
    rows = frame(spark, ["mail a@b.com", text, None])
    data = {r["doc_id"]: r["spans"] for r in pii.find(rows, keep=["doc_id"]).collect()}
    keys = rows.select(secret_scan.found_in(F.col("text")).alias("spans")).collect()[1]["spans"]
    assert time.monotonic() - began < 60
    assert [(s["kind"], s["start"], s["end"]) for s in data[1] if s["kind"] in pii.BASE] == expected
    assert [(s["kind"], s["start"], s["end"]) for s in keys if s["kind"] in secret_scan.BASE] == ([("hex", 0, MILLION)] if name in ("digits", "letters") else [])
    assert len(data[0]) == 1 and data[2] == []


def test_tokens_begin_no_run_and_sql_agrees(spark):
    import duckdb

    part = "eyJ" + "h" * 12
    token = f"{part}.{part}.{'s' * 12}"
    rows = [token, f" {token}.{token}", f"x{token}", f"é{token} {token}", f"-{token}", f"{token}\n{token}", f".{token}.x", None]
    expected = [["0:44"], ["1:45", "46:90"], [], ["1:45", "46:90"], [], ["0:44", "45:89"], ["1:45"], []]
    got = [[f"{s['start']}:{s['end']}" for s in r["spans"] if s["kind"] == "jwt"] for r in frame(spark, rows).select(secret_scan.found_in(F.col("text")).alias("spans")).collect()]
    assert got == expected
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(rows)))
    found = {r[0]: r[-1] for r in con.execute(f"SELECT doc_id, spans FROM ({secret_scan.SQL})").fetchall()}
    assert [[s.removeprefix("jwt:") for s in found[k].split(",") if s.startswith("jwt:")] for k in range(len(rows))] == expected
