"""Hand cases of operators, guards, functions, readers and streams."""

import json
from difflib import SequenceMatcher

import pytest
from tests.support import SMALL
from pyspark.sql import functions as F

from folio.functions import hashing, numbers, pages, recover, text
from folio.operators import bindings, contracts, graph, guards, protocol, ranking, review, scoring
from folio.sources import scans, sinks
from folio.streaming import heartbeats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "pred,gold,want",
    [([1, 2], [1, 2], (1, 1, 1)), ([1, 2], [2, 3], (0.5, 0.5, 0.5)), ([1, 2, 3], [2], (1 / 3, 1, 0.5)), ([], [], (1, 1, 1)), ([], [2], (0, 0, 0)), ([2], [], (0, 0, 0)), ([1], [2], (0, 0, 0))],
)
def test_page_agreement(spark, pred, gold, want):
    array = lambda x: F.array(*map(F.lit, x)).cast("array<int>")
    got = one(spark, pages.page_agreement(array(gold), array(pred)))
    assert (got.precision, got.recall, got.f1) == pytest.approx(want)


def test_fixed_denominator_counts_missing_items(spark):
    items = spark.createDataFrame([(i, "t") for i in range(4)], "k long, task string")
    rows = spark.createDataFrame([(0, [1], [1]), (1, [1], [1, 2]), (2, [1], [1])], "k long, gold_pages array<int>, pred_pages array<int>")
    got = {r.task: r for r in scoring.fixed_denominator(scoring.score_items(items, rows, "k"), "task", 8).collect()}
    assert got["All"].n == 4 and got["All"].ex == 3  # the item without rows has two empty sets
    assert got["t"].er == pytest.approx(50.0)


def test_guards_fail_the_job(spark):
    a = spark.createDataFrame([(1,), (1,)], "k long")
    b = spark.createDataFrame([(1,), (2,)], "k long")
    for bad in (guards.require_unique(a, "k"), guards.require_known(b, a, "k"), guards.require_total(a, b, "k"), guards.union_disjoint({"x": a, "y": b}, "k")):
        with pytest.raises(Exception, match="duplicate|unknown|missing"):
            bad.collect()
    assert guards.require_unique(b, "k").count() == 2


def test_bind_predictions_fills_missing(spark):
    gold = spark.createDataFrame([("a",), ("b",)], "q string")
    got = guards.bind_predictions(gold, spark.createDataFrame([("a", "legal")], "q string, status string"), "q")
    assert dict(map(tuple, got.collect())) == {"a": "legal", "b": "missing"}


def test_match_two_level_drops_ambiguous(spark):
    gold = spark.createDataFrame([("p", "q1", 1), ("p", "q2", 2), ("r", "q2", 3)], "p string, q string, id int")
    refs = spark.createDataFrame([("p", "q2"), ("x", "q1"), ("x", "q2")], "p string, q string")
    got = {(r.p, r.q): (r.matched, r.level) for r in guards.match_two_level(refs, gold, ["p", "q"], ["q"], "id").collect()}
    assert got == {("p", "q2"): (2, "exact"), ("x", "q1"): (1, "loose"), ("x", "q2"): (None, "none")}


@pytest.mark.parametrize(
    "raw,want",
    [
        ('{"answer_pre": "a", "evidence_pages": [1, 2]}', []),
        ('{"answer_pre": "Unanswerable", "evidence_pages": []}', []),
        ("{", ["invalid_json"]),
        ("3", ["wrong_object_type"]),
        ('{"answer_pre": "a", "answer_pre": "b", "evidence_pages": [1]}', ["invalid_json"]),
        ('{"answer_pre": "a", "evidence_pages": [1], "x": 1}', ["wrong_fields"]),
        ('{"answer_pre": "N/A", "evidence_pages": [0, 9]}', ["page_nonpositive", "page_out_of_range", "noncanonical_refusal"]),
        ('{"answer_pre": "a", "evidence_pages": [1.5]}', ["page_type"]),
        ('{"answer_pre": "a", "evidence_pages": []}', ["answer_without_evidence"]),
    ],
)
def test_prediction_codes(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert contracts.with_prediction_codes(df, "raw", F.lit(5)).first().codes == want


@pytest.mark.parametrize("said,label", [("INCORRECT", "wrong"), ("It is Correct.", "correct"), ("partial, CORRECT", "partial"), ("hm", None), (None, None)])
def test_judge_label(spark, said, label):
    assert one(spark, text.judge_label(F.lit(said))) == label


@pytest.mark.parametrize("said,want", [("1,234.5 km", (1234.5, "km")), ("-3", (-3.0, "")), (".5%", (0.5, "%")), ("3 to 4", None), ("about 3", None), ("5 a b c d", None)])
def test_quantity(spark, said, want):
    got = one(spark, numbers.quantity(F.lit(said)))
    assert (tuple(got) if got else None) == want


def test_text_functions(spark):
    assert one(spark, text.squash_space(F.lit(" a \t b "))) == "a b"
    assert one(spark, text.loose_text(F.lit("“A” — [b], c."))) == "a - b c"
    assert one(spark, text.strip_code_fence(F.lit("```json\n{}\n```"))) == "{}"
    assert one(spark, text.content_text(F.lit("É-x, y!"))) == "é x y"
    assert one(spark, pages.pages_in_text(F.lit("Page 3, PAGE_7 and 12 v2.5"))) == [3, 7, 12]
    assert one(spark, text.answer_is_concatenation(F.lit("red fox and blue whale"), F.array(F.lit("red fox"), F.lit("blue whale"))))
    assert sorted(["b10", "b9", "a2"], key=lambda x: one(spark, text.natural_key(F.lit(x)))) == ["a2", "b9", "b10"]


def test_wilson_without_cases(spark):
    assert tuple(one(spark, F.struct(*numbers.wilson(F.lit(0), F.lit(0))))) == (0.0, 0.0)
    low, high = one(spark, F.struct(*numbers.wilson(F.lit(8), F.lit(10))))
    assert (low, high) == pytest.approx((0.4901625, 0.9433178), abs=1e-6)


@pytest.mark.parametrize(
    "item,want",
    [
        ({"answer_pre": '```json\n{"answer_pre": "A  B"}\n```'}, ("A B", "json", "answer_pre")),
        ({"answer": "gold", "evidence_pages": [1]}, ("", "missing", "")),
        ({"response": {"choices": [{"message": {"content": "x"}}]}}, ("x", "choices.message:content:raw_text", "response")),
        ({"output": [{"type": "text", "text": "p"}, {"type": "text", "text": "q"}]}, ("p q", "content_blocks", "output")),
        ({"prediction": 5}, ("5", "scalar", "prediction")),
        ({"raw_output": 'oops "answer_pre": "a \\"b\\" c'}, ('a "b" c', "field_scan", "raw_output")),
        ({"answer_pre": "", "completion": "z"}, ("z", "raw_text", "completion")),
    ],
)
def test_recovered_answer(spark, item, want):
    got = one(spark, recover.recovered_answer(F.lit(json.dumps(item))))
    assert tuple(got) == want
    assert one(spark, recover.recovered_answer(F.lit(None).cast("string"))).status == "missing"


def test_numbers_in_text():
    assert recover.numbers_in("1/4 of 1,200 is twenty five percent, 50%") == [0.25, 1.0, 4.0, 1200.0, 50.0, 0.5, 25.0, 5.0]
    assert recover.numbers_in("two hundred and five") == [205.0, 105.0, 5.0]
    assert recover.numbers_in(r"the first of \frac{1}{2}, -3/4") == [0.5, -0.75, 1.0, 2.0, -3.0, 4.0]
    assert recover.answer_in_text('{"answer_pre": "", "evidence_pages": [1') == ("", "field_scan")
    assert recover.numbers_in(None) == []


def test_scans(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"p1": {"QA": {"q1": {"answer": "x"}, "q2": 3}}, "p2": {"QA": []}, "__meta": 1}))
    values = scans.read_json_values(spark, str(tmp_path / "a.json"))
    assert [(r.unit_id, r.qa_id) for r in scans.dataset_items(values).select("unit_id", "qa_id").collect()] == [("p1", "q1")]
    (tmp_path / "b.json").write_text('{"qa_id": "a", "answer_pre": "x", "evidence_pages": [2]}\n{"qa_id": "b", "answer_pre": "y", "evidence_pages": []} {"z": 1}')
    values = scans.read_json_values(spark, str(tmp_path / "b.json"))
    assert [r.qa_id for r in scans.flat_items(values).orderBy("qa_id").collect()] == ["2", "a", "b"]
    (tmp_path / "s.json").write_text('[{"qa_id": "a", "answer_pre": "x", "evidence_pages": [2]}]')
    gold = spark.createDataFrame([("a",), ("b",)], "qa_id string")
    got = {r.qa_id: (r.status, r.answer, r.pages) for r in scans.read_submission(spark, str(tmp_path / "s.json"), gold).collect()}
    assert got == {"a": ("legal", "x", [2]), "b": ("missing", None, None)}
    assert scans.file_inventory(spark, str(tmp_path), "*.json").count() == 3


def test_ledger_last_line_wins(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"b": "1", "q": "x", "v": 1}\n{"b": "1", "q": "x", "v": 2}')
    rows = scans.read_ledger(spark, str(tmp_path / "l.json"), ["b", "q"]).collect()
    assert len(rows) == 1 and json.loads(rows[0].value)["v"] == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 0.5, 1), ("a", 0.25, 2)], "k string, hit_rate double, n int")
    sinks.write_jsonl(df, str(tmp_path / "o"), "k", files=1)
    assert [r.k for r in spark.read.json(str(tmp_path / "o")).collect()] == ["a", "b"]
    assert sinks.percent_columns(df).first().hit_rate == "50.00%"
    assert sinks.table_text(df).first().line == "b\t0.5\t1"
    merged = sinks.merge_shards({"x": df, "y": df.where("k = 'a'").withColumn("n", F.lit(9))}, "k")
    assert {r.k: r.n for r in merged.collect()} == {"a": 9, "b": 1}
    assert json.loads(sinks.extra_fields(df, ["k"]).first().extra) == {"hit_rate": 0.5, "n": 1}


def test_ratio_pairs_equal_difflib(spark):
    said = ["what is the capital of spain", "what is the capital city of spain", "what is the capitol of spain", "who wrote it", "é" * 9, "é" * 8 + "x", ""]
    got = {(r.a, r.b): r.ratio for r in graph.ratio_pairs(spark.createDataFrame(list(enumerate(said)), "id long, q string"), "id", "q", 0.82).collect()}
    want = {(a, b): SequenceMatcher(None, said[a], said[b]).ratio() for a in range(len(said)) for b in range(a) if said[a] and said[b] and SequenceMatcher(None, said[a], said[b]).ratio() >= 0.82}
    assert got == pytest.approx(want)


def test_keep_first_is_sequential(spark):
    items = spark.createDataFrame([(i,) for i in range(6)], "id long")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (4, 5)], "a long, b long")
    assert sorted(r.id for r in graph.keep_first(items, pairs, "id", F.col("id")).collect()) == [0, 2, 4]


def test_greedy_reuse_gives_disjoint_triples(spark):
    rows = [(a, b, c, 1.0) for a in range(6) for b in range(a + 1, 6) for c in range(b + 1, 6)]
    ranked = spark.createDataFrame(rows, "a int, b int, c int, score double")
    got = graph.greedy_reuse(ranked, ["a", "b", "c"], 5, 1, F.desc("score"), F.col("a"), F.col("b"), F.col("c"))
    assert [x[:3] for x in got] == [(0, 1, 2), (3, 4, 5)]


def test_recommended_keeps_all_new(spark):
    rows = spark.createDataFrame([(1, 5, True), (2, 9, False), (3, 7, False), (4, 8, False)], "id int, score int, fresh boolean")
    assert sorted(r.id for r in ranking.recommended(rows, "id", "fresh", "score", 3).collect()) == [1, 2, 4]


def test_memoized_conflict_fails(spark):
    requests = spark.createDataFrame([("k",)], "key string")
    cache = spark.createDataFrame([("k", "a"), ("k", "b")], "key string, verdict string")
    with pytest.raises(Exception, match="conflicting"):
        review.memoized(requests, cache, "key", "verdict").collect()


def test_stream_equals_batch(spark):
    events = heartbeats.read_events(spark, SMALL)
    got = heartbeats.run_to_table(heartbeats.sessions(events), "append")
    total = heartbeats.run_to_table(heartbeats.deduplicated(events).select("event_id"), "append")
    assert got.count() > 0 and total.count() == spark.read.parquet(f"{SMALL}/events.parquet").count()


def test_bounded_ratio_equals_the_ratio():
    import random
    from difflib import SequenceMatcher

    from folio.operators.graph import bounded_ratio

    rng = random.Random(4)
    for n in (0, 5, 60, 400, 1500):
        for _ in range(20):
            a = "".join(rng.choices("abcdefghij klmnoé0", k=n))
            b = "".join(c if rng.random() > 0.06 else rng.choice(["", "x", "yz"]) for c in a) if rng.random() < 0.7 else "".join(rng.choices("abcdef ", k=n))
            true = SequenceMatcher(None, a, b).ratio()
            assert bounded_ratio(a, b, 0.88) == (true if true >= 0.88 else 0.0) or (true < 0.88 and bounded_ratio(a, b, 0.88) < 0.88)


def test_bindings_fail_the_job(spark):
    run = {"protocol_fingerprint": "f", "qa_source_sha256": "s", "input_mode": "pdf"}
    rows = spark.createDataFrame([("p", "1", "f", "s", "pdf", "c"), ("__x", "1", "", "", "", "d")], "paper string, qa string, protocol_fingerprint string, qa_source_sha256 string, input_mode string, pdf_corpus_sha256 string")
    assert bindings.judge_values(rows, "paper", "qa", run).count() == 1
    for wrong in ({**run, "input_mode": "other"}, {**run, "qa_source_sha256": "t"}):
        with pytest.raises(Exception, match="inference row"):
            bindings.judge_values(rows, "paper", "qa", wrong).collect()
    with pytest.raises(ValueError):
        bindings.judge_values(rows, "paper", "qa", {**run, "input_mode": " "})
    mixed = rows.union(rows.withColumn("pdf_corpus_sha256", F.lit(None).cast("string")))
    with pytest.raises(Exception, match="mixed pdf_corpus_sha256"):
        bindings.judge_values(mixed, "paper", "qa", run).collect()
    papers, hashes = spark.createDataFrame([("p",), ("q",)], "paper string"), spark.createDataFrame([("p", "h")], "paper string, pdf_sha256 string")
    with pytest.raises(Exception, match="missing paper"):
        bindings.inference_values(papers, hashes, "paper", run, True).collect()
    assert {r.pdf_sha256 for r in bindings.inference_values(papers, hashes, "paper", run, False).collect()} == {None}
    with pytest.raises(Exception, match="changed_pdf_sha256"):
        bindings.pinned(hashes, hashes.withColumn("pdf_sha256", F.lit(None).cast("string")), "paper", "pdf_sha256").collect()
    with pytest.raises(Exception, match="no provider"):
        one(spark, bindings.provider_name(F.lit(None).cast("string"), F.lit("m"), {"n": "x"}))
    with pytest.raises(Exception, match="accepted=3/5"):
        one(spark, bindings.search_complete(F.lit(3), F.lit(5), F.lit("search_space_exhausted"), F.lit(2), F.lit(2)))


def test_responses_that_are_no_responses(spark):
    rows = [("a", None), ("b", "no json"), ("c", '{"id":"c","items":[1,{"question":"Q","answer":"x"},{"question":" q ","answer":"y"},{"question":"r"}]}'), ("d", '{"id":"d","items":[{"question":"q","answer":"z"}]}'), ("e", '{"id":"e","items":[]}')]
    got = bindings.response_codes(spark.createDataFrame(rows, "key string, body string"), "key", "body", "id").collect()
    found = {(r.key, r.item_index): r.codes for r in got}
    assert found[("a", None)] == found[("b", None)] == ["id_mismatch", "items_not_list"] and found[("e", None)] == []
    assert found[("c", 0)] == ["item_not_object"] and found[("c", 1)] == [] and found[("c", 3)] == ["empty_question_or_answer"]
    assert found[("c", 2)] == found[("d", 0)] == ["duplicate_question"]
    assert one(spark, bindings.response_shape(F.lit(None).cast("string"), F.lit("b"))).response is None


def test_drivers_readers(spark, tmp_path):
    assert [r.value for r in scans.read_json_or(spark, str(tmp_path / "none.json"), "{}").collect()] == ["{}"]
    (tmp_path / "a.json").write_text('[{"id":1,"x":2},{"id":"1","x":3}]')
    values = scans.read_json_or(spark, str(tmp_path / "a.json"), "{}")
    assert [(r.id, json.loads(r.row)["x"]) for r in scans.manifest_rows(values).collect()] == [("1", 3)]
    with pytest.raises(Exception, match="must be a list"):
        scans.manifest_rows(scans.read_json_or(spark, str(tmp_path / "none.json"), "{}")).collect()
    (tmp_path / "log").write_bytes("aéb".encode())
    assert [scans.tail_text(spark, str(tmp_path / "log"), n).first().tail for n in (1, 2, 3, 9)] == ["b", "�b", "éb", "aéb"]
    assert [(r.place, r.official) for r in scans.processing_order(scans.mapping_rows(spark, {"b": ("s", "L"), "a": ("t", "L")})).collect()] == [(0, "b"), (1, "a")]
    assert protocol.refuse_locked(["--", "--a=1"], {"--b"}) == ["--a=1"]
    with pytest.raises(ValueError):
        protocol.refuse_locked(["--b=1"], {"--b"})
    assert hashing.run_fingerprint({"a": 1, "b": 2}, {}) == hashing.run_fingerprint({"b": 2, "a": 1}, {}) != hashing.run_fingerprint({"a": 1}, {})


def test_candidates_and_references(spark):
    sources = spark.createDataFrame([("b", d, 10 * d - 9, 10 * d) for d in (1, 2, 3)], "bundle string, doc_number int, merged_start int, merged_end int")
    schema = "bundle string, candidate_id string, question string, answer string, conclusion string, failures array<string>, pages array<int>, support array<struct<doc_number:int,page:int,fact:string>>"
    good = [(1, 1, "f"), (2, 11, "f"), (3, 21, "f"), (3, 11, "f"), (1, 2, "f"), (1, 1, " ")]
    rows = [("b", str(i), "q", "a", "c", ["x"] * 3, [21, 1, 11, 1], good) for i in range(7)]
    rows[1] = (*rows[1][:5], ["x", "y"], *rows[1][6:])
    rows[2] = (*rows[2][:6], [1, 11], good)
    rows[3] = (*rows[3][:7], good[:2])
    rows[4] = ("z", *rows[4][1:])
    rows[5] = (*rows[5][:6], None, None)
    rows[6] = (rows[6][0], " ", *rows[6][2:])
    got = bindings.challenge_candidates(spark.createDataFrame(rows, schema), sources, "both").collect()
    assert [(r.candidate_id, r.pages, [tuple(s) for s in r.support]) for r in got] == [("0", [1, 11, 21], good[:3])]
    with pytest.raises(Exception, match="unmapped_page"):
        bindings.evidence_page_sources(spark.createDataFrame([("b", ["table"], [31])], "bundle string, modalities array<string>, pages array<int>"), sources).collect()
    none = F.lit(None).cast("string")
    case = lambda path, aliases, sha=none, sent=F.lit(False): one(spark, bindings.rescorable(F.lit("q"), F.lit("q"), F.array(sent), F.lit(path), aliases, F.lit(None).cast("int"), F.lit(3), sha, F.lit("h")))
    alias = F.array(F.lit("d/a.pdf"))
    assert case("d/a.pdf", alias) and case("x/d/a.pdf", alias, F.lit("h")) and not case("xd/a.pdf", alias)
    assert not (case("d/a.pdf", alias, F.lit("g")) or case("d/a.pdf", F.lit(None).cast("array<string>")) or case("d/a.pdf", alias, none, F.lit(None).cast("boolean")))
