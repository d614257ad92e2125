"""Golden tables for the rules that hold whatever the data: proof, grounding, consent, budgets, deletes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.operators import audit as au
from parlance.operators import chunking, documents, feedback, glossary, research, scoring
from parlance.sources import files, sinks

NOW = dt.datetime(2024, 5, 1, 12, 0)


def minutes(n):
    return NOW + dt.timedelta(minutes=n)


def values(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in rows.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


# ------------------------------------------------------------------ text


def test_term_key_composes_before_it_drops_punctuation(spark):
    decomposed = "Thu Cúc, (Phú Thọ)!"
    assert values(spark, tx.term_key, decomposed, "  GIẢM  nghèo ", "…") == ["thu cúc phú thọ", "giảm nghèo", ""]


def test_normalised_text_drops_the_mark_and_carriage_returns(spark):
    assert values(spark, tx.normalise_text, "﻿a\r\nb\rc", "ệ") == ["a\nb\nc", "ệ"]


def test_the_letter_class_is_the_letter_list():
    import re

    lower = {c for c in map(chr, range(0x20, 0x1F00)) if c == c.lower()}
    assert {c for c in lower if re.match(f"[{tx.VIETNAMESE_CLASS}]", c)} == set(tx.VIETNAMESE_LETTERS)


def test_block_language(spark):
    got = values(spark, tx.block_language, "ngắn quá", "Dự án hỗ trợ người nghèo ở xã Thu Cúc", "The people of the commune are with the project and its aim",
                 "1234567890 1234567890 1234567890", "Das ist ein Satz ohne bekannte Wörter darin")
    assert got == ["unknown", "vi", "en", "unknown", "unknown"]


def test_sentences_and_plausible_lines(spark):
    assert values(spark, tx.sentences, "Xin chào. Đây là 3 câu! “Có” v.v. nhỏ")[0] == ["Xin chào.", "Đây là 3 câu!", "“Có” v.v. nhỏ"]
    assert values(spark, tx.is_plausible_line, "short", "A long enough line", "一二三 mixed garbage 丁丂七") == [False, True, False]


def test_speaking_time_and_counts(spark):
    row = spark.range(1).select(
        tx.speaking_seconds(F.lit("một hai ba bốn"), F.lit("vi")).alias("a"), tx.speaking_seconds(F.lit(""), F.lit("en")).alias("b"),
        tx.sentence_count(F.lit("no end")).alias("c"), tx.sentence_count(F.lit("One. Two! … ")).alias("d")).first()
    assert (float(row.a), float(row.b), row.c, row.d) == (1.1, 0.0, 1, 2)
    assert scoring.duration_bounds() == (24, 78)


# ------------------------------------------------------------------ files


def test_admission_names_the_first_reason(spark):
    df = spark.createDataFrame([("a.PDF", 10), ("b.exe", 0), ("c.txt", 0), ("d.md", 26 * 1024 * 1024), (".txt", 5), ("e.tar.docx", 1)], "filename string, size_bytes bigint")
    assert [(r.status, r.reason) for r in files.admit(df).collect()] == [
        ("admitted", None), ("error", "unsupported_extension"), ("error", "empty_file"), ("error", "too_large"),
        ("error", "unsupported_extension"), ("admitted", None)]


def test_paragraphs_are_numbered_without_blanks(spark):
    df = spark.createDataFrame([(1, "one\n\n \n\ntwo\nlines\n\n\n\nthree ")], "doc_id int, text string")
    assert [(r.text, r.locator) for r in files.paragraph_rows(df).orderBy("block_idx").collect()] == [
        ("one", "đoạn 1"), ("two\nlines", "đoạn 2"), ("three", "đoạn 3")]


def test_names_and_locators(spark):
    assert values(spark, files.safe_filename, 'a<b>:"/x?.txt', " .. ", "Kế hoạch.docx ") == ["a_b____x_.txt", "tai-lieu", "Kế hoạch.docx"]
    pairs = [("đoạn 3", "đoạn 3"), ("đoạn 3", "đoạn 7"), ("trang 2", "đoạn 7"), ("x", "y")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    assert [r.x for r in df.select("i", chunking.locator_range(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()] == [
        "đoạn 3", "đoạn 3–7", "trang 2 → đoạn 7", "x → y"]


def test_csv_export_starts_with_a_mark(spark, tmp_path):
    rows = [(1, 7, "giải ngân", "giải ngân", "disbursement", None, None, "tài chính", "machine_guess", "auto", "web", "u", 2),
            (2, 7, "bỏ", "bỏ", "drop", None, None, None, "machine_guess", "skipped", "web", "u", 1)]
    table = spark.createDataFrame(rows, "id int, workspace_id int, term_vi string, term_vi_norm string, term_en string, pronunciation string, definition string, "
                                        "category string, confidence string, status string, source_type string, source_ref string, frequency int")
    sinks.export_csv(glossary.export_table(table), str(tmp_path / "out"), "workspace_id")
    part = next((tmp_path / "out" / "workspace_id=7").glob("*.csv")).read_text(encoding="utf-8")
    assert part.splitlines() == [
        "﻿Thuật ngữ (VI),Thuật ngữ (EN),Cách đọc,Định nghĩa,Phân loại,Độ tin,Trạng thái,Loại nguồn,Nguồn,Tần suất",
        "giải ngân,disbursement,,,tài chính,máy suy đoán,tự nhận,web,u,2"]


def test_append_adds_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "workspace_id int, v string")
    for _ in range(2):
        sinks.append(df, str(tmp_path / "log"), "workspace_id")
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


# ------------------------------------------------------------------ verbatim proof

SPEECH = ("Allow me to thank the people of the commune and the province. In total the grant comes to nine hundred million dong, "
          "and it builds forty homes for families in need. We hope to go on together next year.")
PROOF = [
    ("the grant comes to nine hundred million dong", SPEECH, True),
    ("The GRANT  comes, to: nine hundred million", SPEECH, True),
    ("The families of the commune thank the province for the grant and the homes", SPEECH, False),
    ("nine hundred million dong comes to the grant", SPEECH, False),
    ("The province builds homes for the people of the commune in need", SPEECH * 50, False),
    ("", SPEECH, False), ("   ", SPEECH, False), ("anything", " \n", False),
    ("ant com", SPEECH, True),
]


def test_verbatim_table(spark):
    for candidate, text, expected in PROOF:
        found = scoring.verbatim(spark.createDataFrame([(1, candidate)], "candidate_id bigint, text string"),
                                 spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
        assert found.is_verbatim is expected, candidate


# ------------------------------------------------------------------ grounded facts


def test_only_proven_or_edited_facts_pass(spark):
    profiles = spark.createDataFrame([(1, 5, "acme", "client"), (2, 5, "acme", "client"), (3, 6, "idle", "partner")],
                                     "id bigint, workspace_id bigint, entity_id string, entity_role string")
    fields = spark.createDataFrame(
        [(1, 1, "old", "hidden", True, False), (2, 2, "budget", "9", True, False), (3, 2, "guess", "7", False, False), (4, 2, "motto", "x", False, True),
         (5, 3, "guess", "y", False, False), (6, 1, "boss", "kept", False, True)],
        "id bigint, profile_id bigint, field_key string, value string, has_source boolean, is_expert_edited boolean")
    text = research.profile_text(research.grounded_fields(profiles, fields)).collect()
    assert [(r.workspace_id, r.profile_text) for r in text] == [(5, "acme (Khách hàng):\n  - budget: 9\n  - motto: x")]
    carried = research.grounded_fields(profiles, fields, carry_edited=True).collect()
    assert sorted(r.field_key for r in carried) == ["boss", "budget", "motto"]


# ------------------------------------------------------------------ consent, budgets, resume

CALL = "id bigint, ts timestamp_ntz, workspace_id bigint, operation_id string, destination string, provider string, n_chars bigint, is_confidential boolean, provider_error string"
GRANT = "workspace_id bigint, operation_id string, destination string, provider string, granted_at timestamp_ntz, expires_at timestamp_ntz"
ALLOWED = "operation_id string, destination string, provider string, allowed_calls int"


def outcome(spark, calls, grants=(), allowed=(("op", "llm", "p", 99),)):
    rows = au.decide(spark.createDataFrame(list(calls), CALL), spark.createDataFrame(list(grants), GRANT), spark.createDataFrame(list(allowed), ALLOWED))
    return [(r.status, r.error_class) for r in rows.orderBy("id").collect()]


def call(i, op="op", provider="p", destination="llm", chars=10, secret=False, error=None, ws=1):
    return (i, minutes(i), ws, op, destination, provider, chars, secret, error)


OK = ("attempt_succeeded", None)


def test_gates_in_order(spark):
    assert outcome(spark, [call(1, op=None, chars=70_000, secret=True), call(2, chars=70_000, secret=True), call(3, secret=True), call(4, error="Timeout"), call(5)],
                   allowed=[("op", "llm", "p", 1)]) == [
        ("blocked", "NoActiveOperation"), ("blocked", "PayloadTooLarge"), ("blocked", "ConsentRequired"), ("attempt_failed", "Timeout"),
        ("blocked", "OperationBudgetExceeded")]


@pytest.mark.parametrize("grant, opens", [
    ((1, "op", "llm", "p"), True), ((1, None, "llm", "p"), True), ((1, "other", "llm", "p"), False), ((1, "op", "tts", "p"), False),
    ((1, "op", "llm", "q"), False), ((2, None, "llm", "p"), False)])
def test_what_a_grant_opens(spark, grant, opens):
    got = outcome(spark, [call(1, secret=True)], [(*grant, minutes(0), minutes(15))])
    assert got == [OK if opens else ("blocked", "ConsentRequired")]


def test_grants_end(spark):
    grants = [(1, None, "llm", "p", minutes(2), minutes(4))]
    assert outcome(spark, [call(i, secret=True) for i in (1, 2, 3, 4)], grants) == [
        ("blocked", "ConsentRequired"), OK, OK, ("blocked", "ConsentRequired")]


def test_budgets(spark):
    declared = spark.createDataFrame([("op", 0, "llm", "p", 2, 2)], "operation_id string, position int, destination string, provider string, unit_calls int, retries_each int")
    assert [r.allowed_calls for r in au.allowed_calls(declared).collect()] == [6]
    got = outcome(spark, [call(i) for i in range(1, 8)] + [call(8, provider="other")], allowed=[("op", "llm", "p", 6)])
    assert got == [OK] * 6 + [("blocked", "OperationBudgetExceeded")] * 2
    assert au.append_rows(au.decide(spark.createDataFrame([call(i) for i in range(13)], CALL), spark.createDataFrame([], GRANT),
                                    spark.createDataFrame([("op", "llm", "p", 13)], ALLOWED))).count() == 13


def test_resume_needs_every_match(spark):
    known = spark.createDataFrame(
        [("a", 1, "ask", "f", minutes(15), None), ("b", None, "ask", "f", minutes(15), None), ("c", 1, "ask", "f", minutes(15), NOW), ("d", 1, "ask", "f", NOW, None)],
        "operation_id string, workspace_id bigint, kind string, fingerprint string, expires_at timestamp_ntz, completed_at timestamp_ntz")
    asked = [("a", 1, "ask", "f", True), ("a", 1, "run", "f", False), ("a", 1, "ask", "g", False), ("a", 2, "ask", "f", False), ("a", None, "ask", "f", False),
             ("b", None, "ask", "f", True), ("c", 1, "ask", "f", False), ("d", 1, "ask", "f", False), ("z", 1, "ask", "f", False)]
    df = spark.createDataFrame([(i, *a[:4], minutes(1)) for i, a in enumerate(asked)],
                               "request_id int, resume_id string, workspace_id bigint, kind string, fingerprint string, ts timestamp_ntz")
    assert [r.resumed for r in au.resumable(df, known).orderBy("request_id").collect()] == [a[4] for a in asked]


def test_evolve_can_run_twice(spark):
    once = au.evolve(spark.createDataFrame([(1, True)], "id int, is_verified boolean"), {"provider": ("string", "")}, {"is_verified": "has_source"})
    twice = au.evolve(once, {"provider": ("string", "x")}, {"is_verified": "has_source"})
    assert twice.columns == ["id", "has_source", "provider"] and twice.first().provider == ""


# ------------------------------------------------------------------ deletes, scores, pronunciation


def test_cascade_leaves_other_workspaces_alone(spark):
    def frame(rows, schema):
        return spark.createDataFrame(rows, schema)

    left = documents.cascade_delete({
        "workspaces": frame([(1,), (2,)], "id int"), "documents": frame([(10, 1), (20, 2)], "id int, workspace_id int"),
        "document_chunks": frame([(100, 10), (200, 20), (201, 20)], "id int, document_id int"), "vectors": frame([(10,), (20,)], "document_id int"),
        "glossary": frame([(5, 1), (6, 2)], "id int, workspace_id int"), "glossary_conflicts": frame([(1, 5), (2, 6)], "id int, glossary_id int"),
    }, "workspaces", frame([(1,)], "id int"))
    assert {k: sorted(tuple(r) for r in v.collect()) for k, v in left.items()} == {
        "workspaces": [(2,)], "documents": [(20, 2)], "document_chunks": [(200, 20), (201, 20)], "vectors": [(20,)],
        "glossary": [(6, 2)], "glossary_conflicts": [(2, 6)]}


def test_pinned_terms_decide(spark):
    given = spark.createDataFrame([(1, "vốn", "capital", "capital", True), (1, "khác", "other", "", False)],
                                  "attempt_id bigint, term_vi string, expected string, used string, correct boolean")
    pinned = spark.createDataFrame([(1, "vốn", "funding", "en", "We give Money."), (1, "xã", "commune", "en", "We give Money."), (2, "xã", "commune", "vi", "Ở Xã này")],
                                   "attempt_id bigint, term_vi string, term_en string, target_lang string, user_translation string")
    verdicts = scoring.override_pinned(given, pinned)
    got = {(r.attempt_id, r.term_vi): (r.correct, r.overridden, r.added, r.used) for r in verdicts.collect()}
    assert got == {(1, "vốn"): (False, True, False, "capital"), (1, "khác"): (False, False, False, ""),
                   (1, "xã"): (False, False, True, ""), (2, "xã"): (True, False, True, "xã")}
    raw = spark.createDataFrame([(1, 11.0, 9.0, 8.26, -1.0), (2, 7.0, 7.0, 7.0, 7.0)],
                                "attempt_id bigint, score_meaning double, score_terminology double, score_completeness double, score_expression double")
    final = {r.attempt_id: (float(r.score_terminology), r.was_limited, float(r.score_overall)) for r in scoring.final_scores(raw, verdicts).collect()}
    assert final == {1: (5.0, True, 5.8), 2: (7.0, False, 7.0)}


def test_pronunciation_longest_first_whole_words(spark):
    mapping = spark.createDataFrame(
        [(1, "Saint Charities", "Xanh Cha-ri-ti", 1, 0), (1, "Charities", "Cha", 2, 0), (1, "ODA", "ô đê a", 3, 0), (1, "đê", "ĐÊ", 4, 0), (2, "ODA", "zzz", 5, 0)],
        "workspace_id bigint, surface string, hint string, first_id bigint, side int")
    texts = spark.createDataFrame(
        [(1, 1, "vi", "saint charities và Charities, MODA oda."), (1, 2, "en", "ODA"), (2, 3, "vi", "$ODA\\"), (1, 4, None, "ODA")],
        "workspace_id bigint, text_id bigint, lang string, text string")
    got = {r.text_id: (r.spoken, r.applied) for r in glossary.apply_pronunciation(texts, mapping).collect()}
    assert got == {1: ("Xanh Cha-ri-ti và Cha, MODA ô ĐÊ a.", ["Saint Charities", "Charities", "ODA", "đê"]), 2: ("ODA", []), 3: ("$zzz\\", ["ODA"]), 4: ("ODA", [])}


def test_contradiction_table(spark):
    rows = [(1, 1, "x", NOW, "a", 2.0), (2, 1, "x", minutes(1), "b", -1.5), (3, 1, "x", minutes(2), "", 2.0), (4, 1, "x", minutes(3), "c", 0.5)]
    df = spark.createDataFrame(rows, "verdict_id bigint, workspace_id bigint, category string, created_at timestamp_ntz, note string, direction double")
    got = feedback.contradictions(df, ["created_at"]).collect()
    assert [(r.verdict_id, r.old_verdict_id, r.old_direction) for r in got] == [(2, 1, "raised")]


def test_repaired_output(spark):
    raw = ['```json\n{"a": 1, "b": "x"}\n```', '{"a": null, "b": "x"}', "sorry", ' {"a": 2} ', "[1]"]
    df = spark.createDataFrame(list(enumerate(raw)), "output_id int, raw string")
    valid, rejected = scoring.repair_output(df, "a int, b string", ["a"])
    assert [(r.output_id, r.parsed.a, r.parsed.b) for r in valid.collect()] == [(0, 1, "x"), (3, 2, None)]
    assert [r.output_id for r in rejected.collect()] == [1, 2, 4]


def test_null_titles_and_snippets_use_up_no_budget(spark):
    rows = [(1, i, None, None) for i in range(1, 1201)] + [(1, 1201, "t", "s"), (2, 1, "t", None), (2, 2, None, "s")]
    results = spark.createDataFrame(rows, "run_id int, position int, title string, snippet string")
    got = sorted((r.run_id, r.position, r.block, r.running_chars) for r in glossary.within_budget(results, budget=60).collect())
    frames = [(1, i, f"[Nguồn {i}] \n", 11 * i) for i in range(1, 6)]
    assert got == [*frames, (2, 1, "[Nguồn 1] t\n", 12), (2, 2, "[Nguồn 2] \ns", 24)]
