"""Tokens, chunks, redaction and scans against plain-Python expectations."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lorekeep.functions.rules import EXTENDED, REDACTOR, SCANNER, pick_rules, told_lines
from lorekeep.functions.tokens import token_count
from lorekeep.operators import chunking as ck
from lorekeep.operators import redaction as rd
from lorekeep.operators import scanning as sc
from lorekeep.operators import volume as vl

# Fake secrets are put together here, so that no scanner takes them for real ones.
SECRETS = {
    "email": "jane.roe" + "@" + "mail.example.com",
    "phone": "555-010-" + "1234",
    "api_key": "sk-" + "a1" * 12,
    "aws_key": "AKIA" + "Q7" * 8,
    "credit_card": "4111" + "1" * 12,
    "ssn": "000-12-" + "3456",
    "ip_address": "999.1.1.1",
    "bearer_token": "Bearer " + "abc.def",
    "slack_token": "xoxb-" + "1" * 11 + "-" + "2" * 11 + "-" + "x" * 24,
    "openai_key": "sk-" + "Z" * 48,
    "anthropic_key": "sk-ant-" + "z" * 95,
    "jwt_token": "eyJ" + "a" * 5 + ".eyJ" + "b" * 5 + "." + "c" * 5,
    "assigned": "api_key = '" + "k" * 20,
    "za_phone": "082 123 4567",
    "id_number": "19900101" + "1234567",
    "id_number_13": "900101" + "1234567",
    "token": 'token = "' + "ab" * 20 + '"',
    "intl": "+1 (555) 010-1234",
}


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def random_text(rng, words):
    pool = ["alpha", "béta", "x", "Bearer", "mail", "12", "sk-", "10.0.0.1", "\n", "000"] + list(SECRETS.values())
    return " ".join(rng.choice(pool) for _ in range(words))


def python_redact(text, rules):
    text = text or ""
    records = []
    for rule in rules:
        for hit in re.finditer(rule.pattern, text):
            records.append((rule.name, hit.start(), hit.end() - hit.start(), rule.marker))
        text = re.sub(rule.pattern, rule.marker, text)
    return text, records


def test_token_counts(spark):
    texts = [None, "", "  \n ", "one", " two  words ", "a b c", "tab\tand\nline"]
    rows = frame(spark, texts).select(
        token_count(F.col("text")).alias("ws"), token_count(F.col("text"), "chars4").alias("chars4")
    ).collect()
    assert [r.ws for r in rows] == [0, 0, 0, 1, 2, 3, 3]
    assert [r.chars4 for r in rows] == [0, 0, 1, 1, 3, 2, 3]
    with pytest.raises(ValueError):
        token_count(F.col("text"), "letters")


def test_chunk_edges(spark):
    sizes = [500, 501, 950, 951, 1]
    texts = [" ".join(f"w{i}" for i in range(n)) for n in sizes] + [None, "", " \t\n"]
    chunks = ck.chunk(frame(spark, texts)).collect()
    counts = {i: sum(1 for c in chunks if c.doc_id == i) for i in range(len(texts))}
    assert [counts[i] for i in range(8)] == [1, 2, 2, 3, 1, 0, 0, 0]
    assert {(c.start_token, c.end_token) for c in chunks if c.doc_id == 3} == {(0, 500), (450, 950), (900, 951)}
    for overlap in (-1, 500):
        with pytest.raises(ValueError):
            ck.chunk(frame(spark, texts), overlap=overlap)


@pytest.mark.parametrize("size,overlap,tokenizer", [(7, 3, "ws"), (5, 0, "ws"), (6, 2, "chars4")])
def test_chunks_cover_and_overlap(spark, size, overlap, tokenizer):
    rng = random.Random(5)
    texts = [random_text(rng, rng.randint(1, 60)) for _ in range(40)]
    docs = frame(spark, texts)
    by_doc = {}
    for row in ck.chunk(docs, size=size, overlap=overlap, tokenizer=tokenizer).collect():
        by_doc.setdefault(row.doc_id, []).append(row)
    for doc_id, text in enumerate(texts):
        rows = sorted(by_doc.get(doc_id, []), key=lambda r: r.chunk_index)
        if not text.strip():
            assert not rows
            continue
        pieces = text.split() if tokenizer == "ws" else [text[i : i + 4] for i in range(0, len(text), 4)]
        assert rows[0].start_token == 0 and rows[-1].end_token == len(pieces)
        for row in rows:
            assert row.total_chunks == len(rows)
            assert row.token_count == row.end_token - row.start_token <= size
            if len(rows) == 1:
                assert row.content == text
            else:
                joiner = " " if tokenizer == "ws" else ""
                assert row.content == joiner.join(pieces[row.start_token : row.end_token])
        assert all(a.end_token - b.start_token == overlap for a, b in zip(rows, rows[1:]))


def test_bpe_without_vocabulary_is_a_clear_error(spark):
    try:
        rows = frame(spark, ["some words"]).select(token_count(F.col("text"), "bpe").alias("n")).collect()
        assert rows[0].n > 0
    except RuntimeError as error:
        assert "vocabulary" in str(error)


def test_chunk_documents_extras_override(spark):
    docs = spark.createDataFrame(
        [("hello", "slack", "1", "ann", "2024-01-01", None, {"author": "bob", "channel": "c"}),
         ("bye", "slack", "2", "ann", "2024-01-01", None, {"author": None})],
        "content string, source string, source_id string, author string, timestamp string, url string, extra map<string,string>",
    )
    rows = {r.source_id: r for r in ck.chunk_documents(docs).collect()}
    assert rows["1"].author == "bob" and rows["1"].extra == {"channel": "c"}
    assert rows["2"].author == "ann" and rows["2"].extra == {}


@pytest.mark.parametrize("rules", ["redactor", "scanner", "extended"])
def test_redaction_equals_python(spark, rules):
    rng = random.Random(11)
    texts = [None, ""] + [random_text(rng, rng.randint(1, 30)) for _ in range(150)]
    chosen = pick_rules(rules)
    rows = rd.redact(frame(spark, texts), rules=rules, count_as="n").orderBy("doc_id").collect()
    for row in rows:
        text, records = python_redact(row.text, chosen)
        assert row.redacted == text
        assert row.n == len(records)
    again = rd.redact(spark.createDataFrame([(r.redacted,) for r in rows], "text string"), rules=rules)
    assert again.where("redacted != text").count() == 0


def test_redaction_records_and_order(spark):
    rng = random.Random(3)
    texts = [random_text(rng, 20) for _ in range(60)] + ["none"]
    found = {}
    for r in rd.redaction_records(frame(spark, texts), "doc_id").collect():
        found.setdefault(r.doc_id, []).append((r.type, r.position, r.length, r.replacement))
    for doc_id, text in enumerate(texts):
        assert sorted(found.get(doc_id, [])) == sorted(python_redact(text, REDACTOR)[1])


def test_texts_that_hold_the_fence_character(spark):
    text = f"\uffff {SECRETS['email']} \uffff\n{SECRETS['ssn']}\uffff"
    row = rd.redact(frame(spark, [text]), count_as="n").first()
    want, records = python_redact(text, REDACTOR)
    assert (row.redacted, row.n) == (want, 2)
    got = [(r.type, r.position, r.length, r.replacement) for r in rd.redaction_records(frame(spark, [text]), "doc_id").collect()]
    assert got == records
    assert [(r.type, r.line_number) for r in sc.scan_pii(frame(spark, [text]), "doc_id").collect()] == [("email", 1)]


def test_redact_switches(spark):
    text = f"{SECRETS['email']} {SECRETS['ssn']}"
    row = rd.redact(frame(spark, [text]), types=["ssn"]).first()
    assert row.redacted == f"{SECRETS['email']} [SSN_REDACTED]"
    assert rd.redact(frame(spark, [text]), enabled=False, count_as="n").first()[2:] == (text, 0)
    with pytest.raises(ValueError):
        rd.redact(frame(spark, [text]), types=["name"])


@pytest.mark.parametrize(
    "text,expected",
    [
        (SECRETS["ip_address"], "[IP_REDACTED]"),
        ("4111 1111 1111 1111", "4111 1111 1111 1111"),
        ("555 010 1234", "555 010 1234"),
        ("key-" + "a" * 19, "key-" + "a" * 19),
        (SECRETS["bearer_token"] + "==", "[BEARER_TOKEN_REDACTED]=="),
        ("é" + SECRETS["email"], "é[EMAIL_REDACTED]"),
    ],
)
def test_redactor_near_misses(spark, text, expected):
    got = rd.redact(frame(spark, [text])).first().redacted
    assert got == python_redact(text, REDACTOR)[0]
    if "é" not in text:
        assert got == expected


def test_extended_rules_catch_what_the_sets_miss(spark):
    texts = [SECRETS["token"], SECRETS["intl"], "id " + SECRETS["id_number_13"]]
    assert rd.redact(frame(spark, texts), rules="redactor", count_as="n").agg(F.sum("n")).first()[0] == 0
    assert [r.n for r in rd.redact(frame(spark, texts), rules="extended", count_as="n").orderBy("doc_id").collect()] == [1, 1, 1]
    assert len({rule.name for rule in EXTENDED}) == len(EXTENDED)


def test_pii_counts_only_present_types(spark):
    rows = frame(spark, [None, "nothing", f"{SECRETS['email']} {SECRETS['email']} {SECRETS['ssn']}"])
    got = [r[0] for r in rows.orderBy("doc_id").select(rd.pii_counts(F.col("text"))).collect()]
    assert got == [{}, {}, {"email": 2, "ssn": 1}]


def test_scan_matches_python(spark):
    rng = random.Random(8)
    texts = [random_text(rng, 25) for _ in range(60)] + [f"two\nlines {SECRETS['slack_token'].upper()}"]
    got = sorted(
        (r.doc_id, r.type, r.value, r.line_number) for r in sc.scan_pii(frame(spark, texts), "doc_id").collect()
    )
    want = sorted(
        (i, rule.name, hit.group(0), text[: hit.start()].count("\n") + 1)
        for i, text in enumerate(texts)
        for rule in SCANNER
        for hit in re.finditer(rule.pattern, text)
    )
    counted = {r.type: r.matches for r in sc.count_by_type(frame(spark, texts)).collect()}
    listed = {r.type: r.matches for r in sc.matches_by_type(sc.scan_pii(frame(spark, texts), "doc_id")).collect()}
    assert counted == listed
    assert got == want and {g[1] for g in got} >= {"phone", "slack_token", "jwt_token", "anthropic_key", "id_number"}


def test_many_matches_in_one_text(spark):
    text = "\n".join(f"ip 10.0.{i % 256}.1 é" for i in range(2500))
    got = sorted((r.line_number, r.value) for r in sc.scan_pii(frame(spark, [text]), "doc_id").collect())
    assert got == [(i + 1, f"10.0.{i % 256}.1") for i in range(2500)]
    positions = sorted(r.position for r in rd.redaction_records(frame(spark, [text]), "doc_id").collect())
    assert positions == [hit.start() for hit in re.finditer(r"10\.0\.\d+\.1", text)]


def test_nested_scan_paths_and_items(spark):
    schema = "k int, body struct<title:string,tags:array<string>,n:int>, props map<string,string>"
    df = spark.createDataFrame(
        [(1, (SECRETS["email"], ["x", SECRETS["aws_key"]], None), {"a": SECRETS["ip_address"]}), (2, None, None)], schema
    )
    hits = {(r.type, r.context) for r in sc.scan_nested(df, "k", "file").collect()}
    assert hits == {
        ("email", "file:[1].body.title"),
        ("aws_key", "file:[1].body.tags[1]"),
        ("ip_address", "file:[1].props.a"),
    }
    counts = sc.items_scanned(df).first()
    # two rows; row 1: k, two tags, null n; row 2: k, null body, null props
    assert (counts.rows_scanned, counts.items_scanned_compat) == (2, 2 + 4 + 3)


def test_gates(spark):
    rows = spark.createDataFrame(
        [("a", SECRETS["email"]), ("a", "clean"), ("b", SECRETS["credit_card"]), ("b", None)], "source string, text string"
    )
    gate = {r.source: r for r in sc.pii_gate_by(rows, "source").collect()}
    assert gate["a"].passed and gate["a"].recommendation == sc.APPROVED and gate["a"].warning is None
    assert not gate["b"].passed and gate["b"].warning == "Found 1 critical PII matches that must be removed"
    assert gate[None].rows_scanned == 4 and gate[None].matches_by_type == {"email": 1, "credit_card": 1}
    empty = sc.pii_gate(rows.where("false")).first()
    assert empty.passed and empty.pii_matches == 0
    masked = sc.masked(sc.scan_pii(rows, "source")).first()
    assert masked.masked_value.endswith("...") and "value" not in masked.asDict()


def test_gap_audit_finds_scanner_only_types(spark):
    left = {r.type: r.remaining for r in sc.gap_audit(frame(spark, list(SECRETS.values()))).collect()}
    assert "email" not in left and left["api_key"] == 1 and left["id_number"] == 1


def test_volume_and_decision(spark):
    docs = spark.createDataFrame([("a b c d", "t"), (None, "only title")], "text string, title string")
    stats = vl.sample_stats(docs)
    assert stats.first()[:3] == (2, 7, 3.5)
    assert vl.sample_stats(docs.where("false")).first().avg_tokens_per_item == 0
    drive = spark.createDataFrame([("words in preview", "file")], "content_preview string, name string")
    assert vl.sample_stats(drive).first().total_tokens == 4
    assert drive.select(vl.extract_text(drive, compat=True)).first()[0] == ""
    costs = vl.budget_check(vl.project_cost(vl.project(stats, per_week=10_000_000)), budget=10.0)
    row = vl.recommend(costs).first()
    assert not row.within_budget and len(row.recommendations) == 4
    assert vl.budget_check(vl.project_cost(vl.project(stats)), budget=0).first().utilization_percent is None
    gate = sc.pii_gate(docs)
    decision = vl.go_no_go(gate, vl.budget_check(vl.project_cost(vl.project(stats)))).first()
    assert decision.overall_status == vl.GO and decision.ready_for_pilot
    assert vl.go_no_go(gate, costs).first().overall_status == vl.NO_GO


def test_rules_see_unicode_as_python_does(spark):
    nbsp = "\u00a0"
    texts = [
        f"call 082{nbsp}123{nbsp}4567 now",
        f"Bearer{nbsp}abcdef.ghi",
        f"api_key:{nbsp}" + "k" * 24,
        "ssn ٠٠٠-١٢-٣٤٥٦ here",
        "éuser@example.org and userß@example.org",
        f"token{nbsp}={nbsp}" + "t" * 24,
        "phone ٠٨٢١٢٣٤٥٦٧",
        "id 19900101" + "٣" * 7,
    ]
    for rules in (REDACTOR, SCANNER, EXTENDED):
        got = rd.redact(frame(spark, texts), "text", "clean", rules=rules).orderBy("doc_id").collect()
        assert [r.clean for r in got] == [python_redact(t, rules)[0] for t in texts]


def test_heads_change_no_match(spark):
    """A rule finds with its head what it finds without, on edges of words and letters that fold beyond ASCII; and it counts null as null."""
    found = {
        "phone": ["555-010-1234", "(555)0101234", "+1.555.010.1234", "+27 82 123 4567", "0821234567", "0\n82123456 7"],
        "key": ["sk-" + "a" * 48, "\u017fk-" + "a" * 48, "s\u212a-ant-" + "b" * 95, "pk_" + "c" * 20, "\u017fecret_key = " + "d" * 20, "API KEY: " + "e" * 20, "apikey=" + "e" * 20],
        "other": ["A3T" + "Z" * 16, "a\u212aia" + "Z" * 16, "AKIA" + "Z" * 16, "4000000000000", "10.0.0.1", "Bearer\nabc=", "xoxb-1234567890-1234567890-" + "f" * 24, "199001011234567", "9001011234567"],
        "more": ["eyJa.eyJb.c", "EYJa.eyjb.c", "token = " + "g" * 20, "to\u212aen: " + "g" * 20, "000-12-1234", "+1 (555) 010-1234", "a@b.cd"],
    }
    edges = ["", " ", "a", "_", "0", "\u00e9", "\u0660", "\u2028", ".", "\U0001f600", "\u0301"]
    texts = [left + text + right for group in found.values() for text in group for left in edges for right in edges] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    rules = {rule.spark_pattern: rule for rule in (*REDACTOR, *SCANNER, *EXTENDED)}
    plain = {pattern: "(?U)" + rule.pattern for pattern, rule in rules.items()}
    values = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    same = [F.sum((~values(a).eqNullSafe(values(b))).cast("int")) for a, b in plain.items()]
    hits = [F.sum(F.size(values(a))) for a in plain]
    counted = df.agg(*same).first()
    assert not any(counted) and all(n > 0 for n in df.where("text IS NOT NULL").agg(*hits).first())
    assert sum(a != b for a, b in plain.items()) == 18


def test_lines_without_a_part_change_no_match(spark):
    """Matches across lines stay, none arises where a line between was left out, and lines keep their numbers."""
    rng = random.Random(5)
    bits = [
        "0", "27", "+27", "82 123", "4567", "8 2 1 2 3 4 5 6 7", "\u0661", "words only here", "", " \u2003 ", "#", "==", " : ", "api_key", "secret-\u212aey", "access token", "=",
        "'" + "d" * 20, "e" * 20 + "'", "a@b.cd", "eyJa.eyJb.c", "AKIA" + "Z" * 16, "10.0.0.1", "4000000000000", "sk-" + "a" * 48, "sk-ant-" + "b" * 95, "xoxb-1234567890-1234567890-" + "f" * 24,
    ]
    texts = ["".join(rng.choice(bits) + rng.choice(["\n", "\n", " ", "\r\n"]) for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "id int, text string")
    rules = {rule.spark_pattern: rule for rule in (*REDACTOR, *SCANNER, *EXTENDED) if rule.by_lines}
    values = lambda text, rule: F.regexp_extract_all(text, F.lit("(?U)" + rule.pattern), F.lit(0))
    told = df.withColumn("told", told_lines(F.col("text")))
    same = [F.sum((~values("text", rule).eqNullSafe(values("told", rule))).cast("int")) for rule in rules.values()]
    assert len(rules) >= 20 and not any(told.agg(*same).first())
    assert told.where("told <> text").count() > 500
    by_line = sc.scan_pii(df, "id").collect()
    for row in by_line[::50]:
        assert row.value.split("\n")[0] in texts[row.id].split("\n")[row.line_number - 1]
    want = {rule.name: sum(n[0] for n in df.select(F.size(values("text", rule))).collect() if n[0] and n[0] > 0) for rule in SCANNER}
    assert {r.type: r.matches for r in sc.count_by_type(df).collect()} == {name: n for name, n in want.items() if n}
    assert len(by_line) == sum(want.values()) and sc.scan_counts(df).where("id = -1 AND n_phone = 0").count() == 1


def test_lines_without_a_match_are_left_out_and_put_back(spark):
    """Matches over line ends, lines that are a number sign, and a token on the line after its bearer."""
    rng = random.Random(5)
    pool = [
        "#", "", "plain words", "a # b", "Bearer", "abc.def", "Bearer abc", "082 123", "4567", "api_key =", "k" * 20, "secret", "SECRET :", " " + "ab" * 12,
        "token", '= "' + "ab" * 12, "mail " + SECRETS["email"], SECRETS["aws_key"], "##", " \t", "\r", "ſecret", SECRETS["ip_address"],
    ]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(400)] + ["#", "\n", "#\n#", "\n#\n", ""]
    for rules in ("redactor", "scanner", "extended"):
        rows = rd.redact(rd.redact(frame(spark, texts), rules=rules, count_as="n"), out="plain", rules=rules).collect()
        for row in rows:
            text, records = python_redact(row.text, pick_rules(rules))
            assert (row.redacted, row.n, row.plain) == (text, len(records), text)
    seen = rd.redact(frame(spark, ["words\n" * 3 + SECRETS["email"]]), rules="extended")._jdf.queryExecution().optimizedPlan().toString()
    assert r"\n#(?=" in seen or "\n#(?=" in seen
