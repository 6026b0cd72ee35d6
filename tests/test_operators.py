"""Hand-typed fixtures of the operators' rules."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.constants import THRESHOLDS
from millrace.functions import exprs, variants
from millrace.operators import audit, curate, evaluate, evidence, gate, match, prompt, select_rows, shapes, smoke, validate, windowing
from millrace.sources import jsonl
from millrace.streaming import captures


def one(spark, column, **values):
    """A column's value over one row of the given texts."""
    names = list(values) or ["x"]
    return spark.createDataFrame([tuple(values.get(n, "") for n in names)], ", ".join(f"{n} {'int' if isinstance(values.get(n), int) else 'string'}" for n in names)).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("text", "ok"),
    [('{"a":1}', True), ("{'a':1}", False), ("NaN", False), ('{"a":1} x', False), ("01", False), ("", False), ("[1,]", False), ('{"a":1,"a":2}', True), ("1,2", False), ('{"a":1}] [', False), ('{"a":1}} {', False), ('1,"b":2', False), ("null", True), (" 5 ", True)],
)
def test_strict_json(spark, text, ok):
    assert one(spark, variants.is_json(F.col("s")), s=text) is ok


@pytest.mark.parametrize(("text", "kind"), [("{}", "object"), ("[]", "array"), ('"s"', "string"), ("1.5", "number"), ("true", "boolean"), ("null", "null")])
def test_kind(spark, text, kind):
    assert one(spark, variants.kind(F.parse_json("s")), s=text) == kind


def test_integers_may_be_written_with_a_point(spark):
    assert one(spark, variants.whole(F.parse_json("s")), s="1.0") == 1
    assert one(spark, variants.whole(F.parse_json("s")), s="1.5") is None


def test_lengths_and_cuts(spark):
    assert one(spark, exprs.utf16_len(F.col("s")), s="a😀é") == 4
    assert one(spark, exprs.utf8_len(F.col("s")), s="a😀é") == 7
    for most in range(9):
        cut = one(spark, exprs.truncate_utf8(F.col("s"), most), s="a😀éb")
        assert len(cut.encode()) <= most
        assert "a😀éb".startswith(cut)
    assert one(spark, exprs.truncate_utf8(F.col("s"), 5), s="a😀éb") == "a😀"
    assert one(spark, exprs.compact_whitespace(F.col("s")), s="﻿ a  \t b ") == "a b"


def test_paths(spark):
    assert one(spark, exprs.normalize_path(F.col("s")), s=".//a\\b.py") == "a/b.py"
    for path, safe in (("a/b", True), ("../a", False), ("/a", False), ("", False), ("..", True), ("a/../../b", True)):
        assert one(spark, exprs.safe_relative_path(F.col("s")), s=path) is safe


def test_numbers(spark):
    def value(c):
        return spark.range(1).select(c.alias("r")).first()["r"]

    assert value(exprs.ratio(F.lit(1), F.lit(0))) == 0
    assert value(exprs.ratio_or_null(F.lit(1), F.lit(0))) is None
    assert value(exprs.f1(F.lit(0.5), F.lit(1.0))) == 0.666667
    assert value(exprs.ceil_divide(F.lit(258), F.lit(43))) == 6
    assert tuple(value(exprs.distribute_evenly(F.lit(258), F.lit(6)))) == (43, 43)
    assert tuple(value(exprs.distribute_evenly(F.lit(7), F.lit(3)))) == (2, 3)
    assert value(exprs.nullable_delta(F.lit(None).cast("double"), F.lit(1.0))) is None
    assert [tuple(r) for r in value(exprs.ranges_of(F.array(*[F.lit(i) for i in (5, 1, 2, 2, 7, 6)])))] == [(1, 2), (5, 7)]
    assert value(exprs.mask_labels(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(2))) == [-100, -100, 3]
    assert value(exprs.mask_labels(F.array(F.lit(1), F.lit(2)), F.lit(2))) == [-100, 2]
    assert value(exprs.first_json_object(F.lit('x {"a": {"b": 1}} y'))) == '{"a": {"b": 1}}'


def capture(**change):
    base = {
        "captureId": "c1", "captureRunId": "r", "operation": "review", "repo": ("click", "sha"), "provider": ("p", "m"), "status": "accepted",
        "validationStatus": "schema-valid-operation-valid", "redactionState": (False, False), "prompt": "hi", "acceptedJson": '{"findings":[]}', "n": 0,
    }
    return base | change


def frame(spark, rows):
    ddl = curate.CAPTURE.replace("acceptedOutput variant", "acceptedJson string") + ", n int"
    names = [c.split()[0] for c in "captureId captureRunId operation repo provider status validationStatus redactionState prompt acceptedJson n".split()]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ddl).withColumn("acceptedOutput", F.try_parse_json("acceptedJson"))


def test_first_failing_reason_wins(spark):
    rows = [
        capture(status="rejected", prompt=""), capture(validationStatus="x"), capture(redactionState=(False, True)), capture(prompt=""), capture(acceptedJson=None), capture(acceptedJson="null"), capture(),
    ]
    got = {r["reason"]: r["rows"] for r in curate.excluded_counts(frame(spark, rows)).collect()}
    assert got == {"non-accepted-status": 1, "not-schema-valid-operation-valid": 1, "metadata-only": 1, "missing-prompt": 1, "missing-accepted-output": 2}


def test_splits(spark):
    rows = [capture(captureId=f"r{i}", repo=("ripgrep", "s"), n=i) for i in range(5)]
    rows += [capture(captureId="m", repo=("ripgrep", "s"), operation="map", n=5), capture(captureId="k", n=6), capture(captureId="u", repo=("other", "s"), n=7)]
    got = curate.curated(frame(spark, rows), "n", "Return JSON.")
    splits = {r["id"]: r["split"] for r in got.select(F.col("metadata.captureId").alias("id"), "split").collect()}
    assert [splits[f"r{i}"] for i in range(5)] == ["validation", "test", "validation", "test", "validation"]
    assert (splits["m"], splits["k"], splits["u"]) == ("validation", "train", "test")
    assert curate.all_rows(got).count() == len(rows)
    assert [m["role"] for m in got.first()["messages"]] == ["system", "user", "assistant"]


def test_hard_boundary_caps_and_last_triage_row(spark):
    rows = [capture(captureId=f"c{i:02}", n=i) for i in range(10)] + [capture(captureId=f"n{i:02}", n=20 + i, acceptedJson='{"findings":[1]}') for i in range(20)]
    rows += [capture(captureId=f"m{i}", n=50 + i, operation="map", acceptedJson='{"features":[]}') for i in range(3)]
    chat = curate.curated(frame(spark, rows), "n", "s")
    triage = spark.createDataFrame([(r["captureId"], "kept", "me", f"note {k}", k) for k in (0, 1) for r in rows], "captureId string, triageStatus string, triageReviewerOrMethod string, triageNotes string, ordinal int")
    got = curate.hard_boundary(chat, triage).select("metadata.*").collect()
    kinds = [r["captureId"][0] for r in got]
    assert (kinds.count("c"), kinds.count("n"), kinds.count("m")) == (8, 18, 3)
    assert {r["triageNotes"] for r in got} == {"note 1"}
    assert all(r["evalKind"] == "hard_boundary" and r["expectedSchemaValid"] for r in got)


FILES = "Intro\nPrompt\nFiles:\n--- a.py (source)\n" + "\n".join(f"{i} | line {i} {'x' * 120}" for i in range(1, 41)) + "\n--- b.py (test)\n" + "\n".join(f"{i} | other {i} {'y' * 120}" for i in range(1, 21))


def test_file_blocks(spark):
    blocks = one(spark, prompt.file_blocks(F.col("s")), s=FILES)
    assert [(b["path"], b["descriptor"], len(b["lines"])) for b in blocks] == [("a.py", "source", 40), ("b.py", "test", 20)]
    assert blocks[0]["lines"][4]["n"] == 5
    assert one(spark, prompt.listed(F.col("s")), s="Valid evidence paths are exactly:\n- a\n- b\nend\n- c") == ["a", "b"]


def windowed(spark, text, evidence_rows):
    e = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(a).cast("long").alias("first"), F.lit(b).cast("long").alias("last")) for p, a, b in evidence_rows]) if evidence_rows else F.array().cast("array<struct<path:string,first:bigint,last:bigint>>")
    return one(spark, windowing.window_prompt(F.col("s"), e), s=text)


def test_windowing_keeps_lines_around_evidence(spark):
    w = windowed(spark, FILES, [("a.py", 25, 25), ("a.py", 3, 3), ("none.py", 1, 1)])
    assert w["strategy"] == "evidence-centered-file-window"
    assert w["blocks"] == 2
    assert len(w["prompt"].encode()) <= 4000
    assert "15 | line" in w["prompt"]
    assert "36 | line" not in w["prompt"]
    clean = windowed(spark, FILES, [])
    assert clean["strategy"] == "clean-review-head-file-window"
    same = windowed(spark, "é" * 4000, [])
    assert (same["strategy"], same["windowed"], same["blocks"]) == ("unchanged", False, -1)
    plain = windowed(spark, "z" * 5000, [])
    assert (plain["strategy"], plain["blocks"], len(plain["prompt"])) == ("prompt-clamp-no-files-section", 0, 4000)


def test_windowing_makes_blocks_once(spark, sf_dir):
    from millrace.plans import windows

    for q in (windows.q_window_rows, windows.q_window_strategies):
        plan = q(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        # one cut at headers, one at line ends, and each line is looked at once
        assert (plan.count("split("), plan.lower().count("rlike")) == (2, 2)


def test_windows_are_encoded_and_searched_once(spark, sf_dir):
    from millrace.plans import windows

    plan = windows.q_window_strategies(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    # omitted units aren't asked for, and the gates look into bytes and characters first
    assert (plan.count("encode("), plan.count("locate(")) == (2, 3)
    w = windowed(spark, "😀" * 2001, [])
    assert (w["strategy"], w["omitted"], w["windowed"]) == ("prompt-clamp-no-files-section", 2002, True)
    assert windowed(spark, "😀" * 2000, [])["strategy"] == "unchanged"
    assert [one(spark, exprs.exceeds_utf16(F.col("s"), 4), s=t) for t in ("abcd", "abcde", "éééé", "a😀é", "😀😀é")] == [False, True, False, False, True]
    marked = "é😀\nFiles:z\nFiles:\nx\nFiles:\ny"
    assert one(spark, windowing.split_files(F.col("s")), s=marked).asDict() == {"prelude": "é😀\nFiles:z\nFiles:\n", "files": "x\nFiles:\ny"}


def test_line_numbers_beyond_integers_are_in_no_window(spark):
    text = "p" * 4001 + "\nFiles:\n--- a.py (x)\n99999999999 | far\n5 | near\n30 | out"
    w = windowed(spark, text, [("a.py", 5, 5)])
    assert (w["blocks"], w["strategy"]) == (1, "evidence-centered-file-window")
    assert one(spark, windowing.evidence_snippets(prompt.file_blocks(F.lit(text)), F.expr("array(struct('a.py' AS path, 5L AS first, 5L AS last))"))) == ["--- a.py (x)\n5 | near"]


def test_clean_review_keeps_28_lines_in_all(spark):
    text = "p" * 4001 + "\nFiles:\n" + "--- a (x)\n" + "\n".join(f"{i} | a" for i in range(1, 21)) + "\n--- b (x)\n" + "\n".join(f"{i} | b" for i in range(1, 21))
    got = one(spark, windowing.head_snippets(prompt.file_blocks(F.col("s"))), s=text)
    assert [s.count(" | ") for s in got] == [20, 8]


def test_row_validator(spark):
    def codes(row):
        return sorted(one(spark, validate.row_issues(F.parse_json("s"), ["review"]), s=json.dumps(row)))

    def chat(content, op="review", cid="c"):
        return {"messages": [{"role": "system", "content": ""}, {"role": "user", "content": ""}, {"role": "assistant", "content": content}], "metadata": {"operation": op, "captureId": cid}}

    assert codes(chat('{"findings":[],"inspected":{}}')) == []
    assert codes(chat("[]")) == ["assistant_schema_type"]
    assert codes(chat("5")) == ["assistant_schema_type"]
    assert codes(chat("{bad")) == ["assistant_json_parse"]
    assert codes(chat(5)) == ["assistant_content_type"]
    assert codes(chat('{"findings":1}')) == ["assistant_schema_field_type", "assistant_schema_missing_field"]
    assert codes([]) == ["record_type"]
    assert codes({}) == ["assistant_message_count", "capture_id_missing", "messages_missing", "metadata_missing", "operation_missing"]


def test_consistency_counts_keys_and_rows(spark):
    rows = spark.createDataFrame([("d", "train", "a"), ("d", "test", "a"), ("d", "all", "a"), ("d", "all", "b"), ("d", "all", "b"), ("d", "hard_boundary", "z"), ("d", "test", "y")], "dataset string, split string, key string")
    got = validate.consistency(rows).first().asDict()
    assert got["regular_split_overlap"] == 1
    assert got["all_duplicate_rows"] == 1
    assert got["regular_split_extra_rows"] == 1
    assert got["regular_split_missing_rows"] == 2
    assert got["hard_boundary_extra_rows"] == 1


def test_plan_golden(spark):
    current = spark.createDataFrame([(242, 4, 4, 3, 160)], "review long, revalidate long, map long, known_repos long, nonempty long")
    p = audit.plan(spark, current).first()
    assert (p["gap_review"], p["gap_revalidate"], p["gap_map"]) == (258, 96, 21)
    assert (p["new_repos"], p["heavy_repos"], p["map_only_repos"]) == (21, 6, 15)
    assert (p["review_min"], p["review_max"], p["revalidate_min"], p["revalidate_max"], p["map_max"]) == (43, 43, 16, 16, 1)


def finding(**change):
    base = {
        "title": "Reader loses bytes", "category": "bug", "severity": "high", "confidence": "high", "evidence": [{"path": "a.py", "startLine": 2, "endLine": 3, "symbol": None, "quote": None}],
        "reasoning": "r", "reproduction": None, "recommendation": "r", "whyTestsDoNotAlreadyCoverThis": "w", "suggestedRegressionTest": None, "minimumFixScope": "m",
    }
    return base | change


def review(*findings):
    return {"findings": list(findings), "inspected": {"files": [], "symbols": [], "notes": []}}


def shape(spark, v):
    return sorted(x["code"] for x in one(spark, shapes.review_shape(F.parse_json("s")), s=json.dumps(v)))


def test_review_shape(spark):
    assert shape(spark, review(finding())) == []
    assert shape(spark, []) == ["review output is not an object"]
    assert shape(spark, {"findings": 1}) == ["schema.missing-findings-array", "schema.missing-inspected-object"]
    assert shape(spark, review(finding(category="x", extra=1))) == ["schema.invalid-category", "schema.unknown-key"]
    assert shape(spark, review(5)) == ["schema.finding-not-object"]
    bad = finding()
    del bad["reproduction"]
    assert shape(spark, review(bad)) == ["schema.invalid-reproduction"]


@pytest.mark.parametrize(("start", "end", "code"), [(0, 0, None), (5, None, "range-incomplete"), (-1, 3, "range-not-positive"), (9, 4, "range-inverted"), (3, 4, None), (1.5, 2, "range-incomplete")])
def test_line_range(spark, start, end, code):
    assert one(spark, evidence.line_range(F.parse_json("s"))["error"], s=json.dumps({"startLine": start, "endLine": end})) == code


def test_pair_scores(spark):
    def score(b):
        return spark.range(1).select(match.pair_score(F.lit(True), *[F.lit(x) for x in (10, 14, *b)]).alias("r")).first()["r"]

    assert [round(score(b), 6) for b in ((19, 25), (20, 25), (34, 40), (35, 40), (10, 14))] == [0.4, 0.25, 0.25, 0.2, 0.7]


def test_greedy(spark):
    c = F.array(*[F.struct(F.lit(s).alias("score"), F.lit(p).alias("p"), F.lit(r).alias("r")) for s, p, r in ((0.9, 1, 0), (0.9, 0, 0), (0.8, 0, 1), (0.7, 1, 1))])
    got = spark.range(1).select(match.greedy(c).alias("m")).first()["m"]
    assert [(m["r"], m["p"]) for m in got] == [(0, 0), (1, 1)]


def test_features(spark):
    def features(v):
        return variants.items(F.parse_json(F.lit(json.dumps(v))))

    ref = [{"featureId": "x", "ownedFiles": [{"path": "a"}]}, {"featureId": "", "ownedFiles": [{"path": "./b"}, {"path": "c"}]}, {"ownedFiles": [{"path": "d"}, {"path": "e"}]}]
    got = [{"featureId": "x", "ownedFiles": []}, {"ownedFiles": [{"path": "c"}, {"path": "b"}]}, {"ownedFiles": [{"path": "d"}, {"path": "f"}]}]
    m = spark.range(1).select(match.match_features(features(ref), features(got)).alias("m")).first()["m"]
    assert [(x["r"], x["p"]) for x in m["exact"]] == [(0, 0), (1, 1)]
    assert [(x["r"], x["p"]) for x in m["near"]] == [(2, 2)]
    outcomes = [spark.range(1).select(match.near_outcome(F.lit(a), F.lit(b)).alias("r")).first()["r"] for a, b in (("open", "uncertain"), ("fixed", "open"), ("fixed", "false-positive"))]
    assert outcomes == [True, False, True]


PROMPT = "Valid evidence paths are exactly:\n- a.py\nend\nFiles:\n--- a.py (source)\n1 | one\n2 | two\n3 | three\n"


def cases(spark, predictions):
    refs = [review(finding()), review(), review(finding(title="Another"))]
    rows = [(i, json.dumps({"messages": [{"role": "user", "content": PROMPT}, {"role": "assistant", "content": json.dumps(r)}], "metadata": {"operation": "review", "captureId": f"c{i}"}})) for i, r in enumerate(refs)]
    reference = evaluate.references(spark.createDataFrame(rows, "ordinal int, s string").withColumn("value", F.parse_json("s")))
    predicted = spark.createDataFrame(list(enumerate(predictions)), "ordinal int, s string").withColumn("value", variants.parse_strict(F.col("s")))
    return evaluate.review_cases(evaluate.by_ordinal(reference, predicted)).coalesce(1).cache()


def test_a_reference_scored_against_itself_is_perfect(spark):
    refs = [review(finding()), review(), review(finding(title="Another"))]
    c = cases(spark, [json.dumps({"content": json.dumps(r), "latencyMs": 5}) for r in refs])
    m = evaluate.review_metrics(c).first()
    assert (m["precision"], m["recall"], m["f1"], m["clean_accuracy"]) == (1, 1, 1, 1)
    assert (m["schema_valid_rows"], m["evidence_valid_rows"], m["latency_avg"]) == (3, 3, 5)
    assert gate.exit_code(gate.quality_gate(evaluate.review_metrics(c))) == 0


def test_missing_and_broken_predictions(spark):
    c = cases(spark, ["null", "{bad", "5"])
    codes = {r["code"]: r["issues"] for r in evaluate.issue_histogram(c).collect()}
    assert codes == {"prediction.missing-row": 2, "prediction.invalid-jsonl-row": 1, "prediction.output-json-parse": 3}
    m = evaluate.review_metrics(c)
    assert m.first()["clean_accuracy"] == 1
    assert gate.exit_code(gate.quality_gate(m)) == 1
    t = gate.triage(m, evaluate.issue_histogram(c)).first()
    assert (t["missed_items"], t["missed_rate"], t["unparseable_rows"]) == (2, 1, 3)


def test_evidence_rules(spark):
    outside = finding(evidence=[{"path": "a.py", "startLine": 2, "endLine": 9, "symbol": None, "quote": None}])
    quote = finding(evidence=[{"path": "./a.py", "startLine": None, "endLine": None, "symbol": None, "quote": "one\n  two"}])
    wrong = finding(evidence=[{"path": "b.py", "startLine": 3, "endLine": 1, "symbol": None, "quote": "x"}])
    both = finding(evidence=[{"path": "a.py", "startLine": 3, "endLine": 1, "symbol": None, "quote": "one"}])
    v = F.parse_json(F.lit(json.dumps(review(outside, quote, wrong, both, finding(evidence=[])))))
    blocks = prompt.file_blocks(F.lit(PROMPT))
    got = spark.range(1).select(evidence.review_evidence(v, F.array(F.lit("a.py")), blocks).alias("i")).first()["i"]
    by_finding = {k: sorted(x["code"][9:] for x in got if x["path"][1] == str(k)) for k in range(5)}
    assert by_finding == {0: ["range-outside-files-section"], 1: [], 2: ["path-not-allowed", "path-not-in-files-section", "range-inverted"], 3: ["quote-outside-files-section", "range-inverted"], 4: ["missing"]}


def test_unwrapping(spark):
    inner = {"findings": []}
    for row in [inner, {"prediction": inner}, {"text": json.dumps(inner)}, {"messages": [{"role": "assistant", "content": json.dumps(inner)}]}, {"choices": [{"message": {"content": json.dumps(inner)}}]}, {"choices": [{"text": json.dumps(inner)}]}]:
        got = one(spark, F.to_json(evaluate.unwrap(F.parse_json("s"))), s=json.dumps(row))
        assert json.loads(got) == inner
    assert one(spark, evaluate.unwrap(F.parse_json("s")).isNull(), s='{"content":"abc"}') is True


def test_interleave(spark):
    rows = spark.createDataFrame([("n1", 1), ("n2", 1), ("n3", 1), ("c1", 0)], "id string, k int")
    got = select_rows.interleave(rows, F.col("k") == 1, F.col("k") == 0, ["id"], 4).orderBy("place").collect()
    assert [r["id"] for r in got] == ["n1", "c1", "n2", "n3"]


def test_thresholds_are_checked(spark):
    with pytest.raises(ValueError, match="threshold"):
        gate.check_thresholds({"f1": 2})
    assert gate.check_thresholds({}) == THRESHOLDS
    with pytest.raises(ValueError, match="review metrics"):
        gate.quality_gate(spark.createDataFrame([(1, 0.5)], "rows int, f1 double"))


def test_json_lines(spark, tmp_path):
    path = tmp_path / "d" / "train.jsonl"
    path.parent.mkdir()
    path.write_text('{"a":1}\n\n  \n{bad\n{"a":2}\n')
    rows = jsonl.scan(spark, str(path)).orderBy("line").collect()
    assert [(r["line"], r["ordinal"], r["error"]) for r in rows] == [(1, 1, False), (4, 2, True), (5, 3, False)]
    assert jsonl.scan_large(spark, str(path)).count() == 3
    with pytest.raises(Exception, match="row 2"):
        jsonl.scan_strict(spark, str(path)).select(F.to_json("value")).collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:  # the same in many splits
        long = tmp_path / "long.jsonl"
        long.write_text("".join('{"a":%d}\r\n' % i if i % 5 else "\n" for i in range(300)))
        split = jsonl.scan(spark, str(long))
        assert spark.read.text(str(long)).rdd.getNumPartitions() > 1
        assert [(r["line"], r["ordinal"], r["a"]) for r in split.select("line", "ordinal", F.try_variant_get("value", "$.a", "int").alias("a")).orderBy("line").collect()] == [(i + 1, k + 1, i) for k, i in enumerate(i for i in range(300) if i % 5)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    long.unlink()
    found = jsonl.discover(spark, str(tmp_path)).collect()
    assert [(r["dataset"], r["split"], r["direct"]) for r in found] == [("d", "train", True)]
    grid = jsonl.expected_files(jsonl.discover(spark, str(tmp_path)), spark, [("d", "train"), ("d", "test")])
    assert {r["split"]: r["path"] is None for r in grid.collect()} == {"train": False, "test": True}
    assert jsonl.export_file(spark.createDataFrame([], "a int"), str(tmp_path / "e.jsonl"), [F.col("a")]) == 0
    assert (tmp_path / "e.jsonl").read_text() == "\n"
    assert jsonl.export_file(spark.createDataFrame([(2,), (1,)], "a int"), str(tmp_path / "f.jsonl"), [F.col("a")]) == 2
    assert (tmp_path / "f.jsonl").read_text() == '{"a":1}\n{"a":2}\n'


def test_redaction_and_key_order(spark):
    assert one(spark, select_rows.redact(F.col("s")), s='{"b":{"prompt":1,"x":[{"error":2,"y":1}]}}') == '{"b":{"x":[{"y":1}]}}'
    assert one(spark, select_rows.compact_json(F.col("s")), s='{"b": 1.0, "a": {}}') == '{"b":1,"a":{}}'


def test_stream_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"operation":"map","status":"accepted"}\n{bad\n{"operation":"map","status":"accepted"}\n')
    q = captures.status_counts(captures.read_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("counts").collect()] == [("map", "accepted", 2)]


def test_smoke_report(spark):
    rows = spark.createDataFrame([("accepted", "review", False, True), ("rejected", "revalidate", True, False)], "status string, operation string, redacted boolean, metadataOnly boolean")
    got = smoke.smoke_report(smoke.capture_summary(rows), [0, 0]).first()
    assert (got["rows"], got["accepted"], got["rejected"], got["revalidate"], got["passed"]) == (2, 1, 1, 1, True)
    assert smoke.smoke_report(smoke.capture_summary(rows), [0, 1]).first()["passed"] is False
    assert smoke.capture_summary(rows.where("false")).first()["rows"] == 0
    assert smoke.labeled_path("a=b/c.jsonl") == ("a", "b/c.jsonl")
    assert smoke.labeled_path("b/c.jsonl") == ("c", "b/c.jsonl")
    assert smoke.one_operation(rows.where("operation = 'review'")) == "review"
    with pytest.raises(ValueError, match="one operation"):
        smoke.one_operation(rows)
    with pytest.raises(ValueError, match="missing"):
        smoke.missing(["A"], {})


def test_windows_of_all_documents_equal_a_plain_version(spark, tmp_path):
    from collections import Counter
    from hashlib import md5

    from millrace.constants import NOTE_TRUNCATED
    from millrace.plans import texts

    def plain(t):
        if t is None or len(t.encode("utf-16-le")) // 2 <= 4000:
            return t, False, "unchanged"
        cut = t if len(t) <= 4000 else t[:4000] + NOTE_TRUNCATED
        cut = cut.encode()[:4000].decode(errors="ignore")
        return cut, cut != t, "prompt-clamp-no-files-section"

    docs = [None, "", "short", "é" * 3000, "a" * 4000, "a" * 4001, "aé" * 2500, "\U0001f600" * 1999, "\U0001f600" * 2001, "x" + "\u20ac" * 4500, "a" * 3999 + "é" + "b" * 50]
    rows = [(i, "de" if i % 2 else "en", t) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["prompt_md5"], r["windowed"], r["strategy"]) for r in texts.q_clamp_prelude(spark, str(tmp_path)).collect()}
    want = {i: plain(t) for i, _, t in rows}
    assert got == {i: (None if p is None else md5(p.encode()).hexdigest(), w, s) for i, (p, w, s) in want.items()}
    summary = {(r["lang"], r["strategy"]): (r["rows"], r["windowed_rows"], r["max_bytes"]) for r in texts.q_window_summary(spark, str(tmp_path)).collect()}
    keys = Counter((lang, want[i][2]) for i, lang, _ in rows)
    own = lambda k: [want[i] for i, lang, _ in rows if (lang, want[i][2]) == k]
    assert summary == {k: (n, sum(w for _, w, _ in own(k)), max(len((p or "").encode()) for p, _, _ in own(k))) for k, n in keys.items()}


def test_title_pairs_of_blocks_in_parts(spark, tmp_path):
    import duckdb

    from millrace.plans import registry, scoring

    names = ["red bolt", "red ring", "the ring of steel", "", None]
    rows = [(i // 2 if i < 4 else i, names[i % 5], "Brand#1" if i % 7 else None, ("SMALL", "LARGE")[i % 2], 1 if i % 11 else i % 3) for i in range(90)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    with duckdb.connect() as c:
        c.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
        want = sorted(c.execute(registry.SQL["q_title_jaccard"]).fetchall(), key=repr)
    found = scoring.q_title_jaccard(spark, str(tmp_path))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    # a score is made for two titles, below where their rows' pairs are written out
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Generate explode(kb") < plan.index("array_intersect")
    p = registry.table(spark, str(tmp_path), "part").withColumn("w", F.array_sort(exprs.title_tokens(F.concat("p_name", F.lit(" "), "p_type"))))
    for most in (1, 7, 50):
        small = match.pairs_in_blocks(p, "p_partkey", ["p_brand", "p_size"], "w", lambda a, b: F.round(exprs.jaccard(a, b), 6), most)
        assert sorted((tuple(r) for r in small.collect()), key=repr) == want


def test_title_pairs_of_a_brand_whatever_the_size(spark, tmp_path):
    import duckdb

    from millrace.plans import registry, scoring

    rows = [(1, "red bolt", "Brand#1", "SMALL", 1), (2, "red bolt", "Brand#1", "SMALL", 2), (3, "red ring", "Brand#1", "SMALL", 3), (4, "red bolt", "Brand#1", "SMALL", None), (5, "red bolt", "Brand#2", "SMALL", 1), (6, "red bolt", None, "SMALL", 1)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    want = [(1, 2, 1.0), (1, 3, 0.5), (1, 4, 1.0), (2, 3, 0.5), (2, 4, 1.0), (3, 4, 0.5)]
    assert sorted(tuple(r) for r in scoring.q_title_jaccard(spark, str(tmp_path)).collect()) == want
    with duckdb.connect() as c:
        c.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
        assert sorted(c.execute(registry.SQL["q_title_jaccard"]).fetchall()) == want
    p = registry.table(spark, str(tmp_path), "part").withColumn("w", F.array_sort(exprs.title_tokens(F.concat("p_name", F.lit(" "), "p_type"))))
    for most in (1, 2, 50):
        small = match.pairs_in_blocks(p, "p_partkey", ["p_brand"], "w", lambda a, b: F.round(exprs.jaccard(a, b), 6), most)
        assert sorted(tuple(r) for r in small.collect()) == want
