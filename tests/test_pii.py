import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from basketflow.functions import pii as X
from basketflow.operators import pii

SALT = "unit-test-salt-0123456789"


def _col(spark, values, expr):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(expr).collect()]


def test_phone_pipeline_rule(spark):
    vals = ["8 (999) 123-45-67", "+7-999-123-45-67", "9991234567", "call me", " 7 999 123 45 67\t"]
    got = _col(spark, vals, X.normalize_phone("x"))
    assert [(r["value"], r["ok"]) for r in got] == [
        ("+79991234567", True), ("+79991234567", True), ("9991234567", False), ("call me", False),
        ("+79991234567", True)]


def test_phone_digits_rule(spark):
    vals = ["8 (999) 123-45-67", "9991234567", "", "abc", "+1 202 555 0100"]
    assert _col(spark, vals, X.normalize_phone_digits("x")) == [
        "+79991234567", "+79991234567", "", "", "+12025550100"]


def test_hash_matches_sha256_and_blank(spark):
    got = _col(spark, ["  a@b.c\t", "", "   ", None], X.hash_value(F.col("x"), SALT))
    assert got[0] == hashlib.sha256(f"{SALT}:a@b.c".encode()).hexdigest()
    assert got[1:] == ["", "", ""]
    with pytest.raises(ValueError):
        X.check_salt("short")


def test_document_hashing_any_depth(spark):
    df = spark.createDataFrame(
        [({"email": " A@B.C ", "phone": "8 (999) 123-45-67", "name": "x"},
          [{"email": "d@e.f", "phone": None}], 5)],
        "m struct<email:string, phone:string, name:string>, lst array<struct<email:string, phone:string>>, email int")
    doc = df.select(F.struct("m", "lst", "email").alias("doc"))
    out = pii.hash_document(doc, "doc", SALT).first()["doc"]
    assert out["m"]["email"] == hashlib.sha256(f"{SALT}:a@b.c".encode()).hexdigest()
    assert out["m"]["phone"] == hashlib.sha256(f"{SALT}:+79991234567".encode()).hexdigest()
    assert out["m"]["name"] == "x"
    assert out["lst"][0]["email"] == hashlib.sha256(f"{SALT}:d@e.f".encode()).hexdigest()
    assert out["lst"][0]["phone"] is None          # NULL stays NULL
    assert out["email"] == 5                       # a number under a PII name is untouched


def test_unnormalized_report_has_no_number(spark):
    df = spark.createDataFrame([("c1", "call me"), ("c2", "+79991234567"), ("c3", None)], "id string, phone string")
    r = pii.phone_report(df, "customers", "id", "phone")
    assert r.columns == ["entity", "doc_id"] and [x["doc_id"] for x in r.collect()] == ["c1"]


def test_json_documents_unknown_fields_fail(spark):

    schema = DataType.fromDDL("customer_id string, email string, contacts array<struct<phone: string>>")
    ok = spark.createDataFrame([('{"customer_id": "c1", "email": " X@Y.Z ", "contacts": [{"phone": "89991234567"}]}',),
                                ('{"customer_id": "c2"}',)], "payload string")
    out = pii.hash_json_documents(ok, "payload", schema, SALT)
    rows = [r["payload"] for r in out.collect()]
    assert hashlib.sha256(f"{SALT}:x@y.z".encode()).hexdigest() in rows[0]
    assert hashlib.sha256(f"{SALT}:+79991234567".encode()).hexdigest() in rows[0]
    assert "X@Y" not in rows[0] and rows[1] == '{"customer_id":"c2"}'
    bad = spark.createDataFrame([('{"customer_id": "c3", "contacts": [{"phone": "1", "email2": "leak@x"}]}',)],
                                "payload string")
    with pytest.raises(pii.UnknownFieldsError) as ei:
        pii.hash_json_documents(bad, "payload", schema, SALT)
    assert "contacts[].email2" in str(ei.value) and "leak@x" not in str(ei.value)


def _brute(value):
    """The rule on a parsed document."""
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            if k == "email" and isinstance(v, str):
                v = v.strip().lower()
                out[k] = hashlib.sha256(f"{SALT}:{v}".encode()).hexdigest() if v else ""
            elif k == "phone" and isinstance(v, str):
                out[k] = ("phone", v)
            else:
                out[k] = _brute(v)
        return out
    return [_brute(v) for v in value] if isinstance(value, list) else value


def _random_value(rng, depth=0):
    kind = rng.randint(0, 9 if depth < 4 else 5)
    if kind < 4:
        return "".join(rng.choice(['a', "B", '"', "\\", ":", ",", " ", "é", "\n", "{", "]", "@", "/"]) for _ in range(rng.randint(0, 8)))
    if kind < 6:
        return rng.choice([None, True, 5, -0.5])
    if kind < 7:
        return [_random_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    names = rng.sample(["email", "phone", "Email", "e", 'x"email', "email\\", "emails", "", "m:"], rng.randint(0, 5))
    return {n: _random_value(rng, depth + 1) for n in names}


def test_any_json_is_hashed_without_a_schema(spark):
    import json
    import random
    rng = random.Random(4)
    docs = [_random_value(rng) for _ in range(400)]
    texts = [json.dumps(d, ensure_ascii=i % 2 == 0, indent=[None, 1][i % 3 == 0]) for i, d in enumerate(docs)]
    texts.append('{"e\\u006dail" : "A@B.C", "x": {"phone"\n:\t"8 (999) 123-45-67"}, "list": [{"email": "q@r.s"}], "n": {"email": ["z@z.z"]}}')
    docs.append(json.loads(texts[-1]))
    texts.append('{"t": "' + "y" * 300_000 + "\\\\" * 20_000 + '", "email": " L@M.N "}')
    docs.append(json.loads(texts[-1]))
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, payload string").withColumn("_json_parts", F.lit(1))
    rows = {r["i"]: r for r in pii.hash_any_json(df, "payload", SALT).collect()}
    assert rows[-1]["payload"] is None and rows[0]["_json_parts"] == 1
    phones, expected = {}, [_brute(d) for d in docs]

    def walk(e, g):
        if isinstance(e, tuple):
            phones.setdefault(e[1], g)
            assert phones[e[1]] == g and (g == "" or len(g) == 64)
        elif isinstance(e, dict):
            assert list(e) == list(g)
            for k in e:
                walk(e[k], g[k])
        elif isinstance(e, list):
            assert len(e) == len(g)
            for a, b in zip(e, g):
                walk(a, b)
        else:
            assert e == g

    for i, e in enumerate(expected):
        walk(e, json.loads(rows[i]["payload"]))
    probe = spark.createDataFrame([(p,) for p in phones], "p string").select("p", X.hash_value(X.normalize_phone("p").getField("value"), SALT).alias("h"))
    assert {r["p"]: r["h"] for r in probe.collect()} == phones and len(phones) > 20


@pytest.mark.parametrize("text", ["", "{", '{"email": "a@b.c"', '{"email": "a@b.c"} x', '{"a": "\x01"}', "[1]]", '{"email": "a@b.c",}'])
def test_text_that_is_no_json_fails_without_being_shown(spark, text):
    df = spark.createDataFrame([(text,)], "payload string")
    with pytest.raises(Exception) as e:
        pii.hash_any_json(df, "payload", SALT).collect()
    assert "no JSON value" in str(e.value) and "a@b" not in str(e.value).split("== SQL")[0].split("JVM stacktrace")[0]
