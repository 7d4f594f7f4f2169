"""Near-duplicate vectors, components, chat, and the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folio.llm import chat, neardup, scratch, toxicity
from folio.llm.components import star_components
from folio.llm.registry import ORACLE, QUERIES
from tests.support import SMALL, same_rows

from .test_jaccard import brute
from .test_words import shingles


@pytest.mark.parametrize("local", [1_000_000, 60, 0])
def test_components_equal_union_find(spark, local):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(400, j) for j in range(401, 450)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.id: r.root for r in star_components(spark.createDataFrame(edges, "a long, b long"), local_links=local).collect()}
    assert got == {x: find(x) for x in root}
    assert star_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name", ["op6_embedding_near_dedup"])
def test_query_equals_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SMALL), duck, ORACLE[name])


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 40)  # several blocks in the large group
    monkeypatch.setattr(neardup, "WINDOW", 16)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((260, 24))
    x[100:200] = x[100] + 0.12 * rng.standard_normal((100, 24))
    x[210:230] = x[209] + 0.3 * rng.standard_normal((20, 24))
    x[250] = x[3] * 5
    x[251] = x[3]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 24), (903, [None] + [1.0] * 23), (904, [float("nan")] * 24), (905, [float("inf")] + [0.0] * 23), (906, [1.0, 2.0]), (907, [2.0, 4.0])]
    got = {r.vec_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"), "vec_id", "embedding").collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.minimum(label, np.where(near, label[None], len(x)).min(axis=1))
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), label[i], label[i] == i)
    for i in range(900, 906):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[907].n_links, got[907].component_id) == (1, 906)


def test_full_lists_hide_no_links(spark, monkeypatch):
    """Two tight families, linked only with one another beyond their own kind: a list of any fixed length is too short."""
    monkeypatch.setattr(neardup, "audit", lambda members, *_: (1.0, members.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)))
    rng = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = []
    for _ in range(30):
        a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
        for center in (a, 0.95 * a + np.sqrt(1 - 0.95**2) * b):
            x.append(unit(center + 0.004 * rng.standard_normal((20, 64))))
    x = np.concatenate(x)
    near = x @ x.T >= 0.9
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = {r.vec_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding").collect()}
    assert [got[i].component_id for i in range(len(x))] == [i // 40 * 40 for i in range(len(x))]
    assert [got[i].n_links for i in range(len(x))] == (near.sum(axis=1) - 1).tolist()


def test_audit_takes_a_remainder_each_round_and_counts_a_group_once(spark, monkeypatch):
    turn = lambda d: np.array([np.cos(d), np.sin(d)])
    at = lambda plane, d: np.concatenate([np.zeros(2 * plane), turn(d), np.zeros(2 * (7 - plane))])
    rows = [(i, 0, at(0, i / 1000)) for i in range(60)]  # one joined group
    rows += [(100 + 2 * p + i, 100 + 2 * p, at(p, i / 1000)) for p in range(1, 6) for i in range(2)]  # joined pairs
    rows += [(200 + i, 200 + i, at(6, i / 1000)) for i in range(2)]  # a missed pair
    members = spark.createDataFrame([(a, a, r, bytearray(x.tobytes())) for a, r, x in rows], "node long, first long, root long, unit binary")
    for size in (8 << 20, 600):  # one block of queries, many blocks
        monkeypatch.setattr(neardup, "AUDIT_BYTES", size)
        monkeypatch.setattr(neardup, "AUDIT_STEP", 1)
        recall, missed = neardup.audit(members, 0.9, 0)
        assert recall == pytest.approx(6 / 8)
        assert sorted(map(tuple, missed.collect())) == [(200, 201), (201, 200)]
        monkeypatch.setattr(neardup, "AUDIT_STEP", 20)
        assert neardup.audit(members, 0.9, 0)[0] == pytest.approx(1 / 2)  # 0, 20, 40 of the group; 200
        assert neardup.audit(members, 0.9, 2)[0] == 1.0


def test_rounds_that_never_reach_the_target_fail(spark, monkeypatch):
    monkeypatch.setattr(neardup, "audit", lambda members, *_: (0.5, members.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)))
    df = spark.createDataFrame([(i, [float(i == j) for j in range(6)]) for i in range(6)], "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError, match="recall 0.5"):
        neardup.near_duplicates(df, "vec_id", "embedding").collect()


def test_no_vectors(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding").count() == 0


def test_repeated_vectors_count_as_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id) for r in neardup.near_duplicates(df, "vec_id", "embedding").collect())
    assert got == [(-1, 0, None), (1, 2, 1), (1, 2, 1), (2, 2, 1)]


def test_partitions_decode_alike(spark, monkeypatch):
    """A chain over many partitions has the states of the chain in one."""
    df = spark.read.parquet(f"{SMALL}/conversations.parquet").withColumn("role", F.when(F.xxhash64("conv_id", "turn") % 2 == 0, F.col("role")))
    one = df.withColumn("turn", F.col("conv_id") * 100 + F.col("turn")).withColumn("conv_id", F.lit(1))
    for table in (df, one):
        found = []
        for rows in (20_000, 3):
            monkeypatch.setattr(chat, "RANGE_ROWS", rows)
            found.append(sorted(tuple(r) for r in chat.format_conversations(table, "conv_id", "turn", "role", "text").select("record.conv_id", "record.turn", "found_role").collect()))
        assert found[0] == found[1]


def test_known_roles_stay_in_rare_orders(spark):
    usual, rare = ["system", "user", "assistant"], [["user", "user", "assistant"], ["user", "assistant", "assistant", "user"]]
    rows = [(c, i, r, "so it is.") for c, rs in enumerate([usual] * 2000 + rare) for i, r in enumerate(rs)]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "conv_id", "turn", "role", "text").where("record.role <> found_role")
    assert got.count() == 0


def test_hidden_roles_are_recovered(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    hidden = df.withColumn("told", F.when(F.xxhash64("conv_id", "turn") % 2 == 0, F.col("role")))
    got = chat.format_conversations(hidden, "conv_id", "turn", "told", "text").select("record.role", "record.told", "found_role").toPandas()
    assert (got[got.told.notna()].role == got[got.told.notna()].found_role).all()
    assert (got[got.told.isna()].role == got[got.told.isna()].found_role).mean() > 0.95


def test_query_equals_brute_force_and_finds_held_out_roles(spark):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    got = {(r.conv_id, r.turn): (r.held_out, r.role, r.rendered_sha256) for r in QUERIES["op3_chat_format"](spark, sf).collect()}
    said = {}
    for r in sorted(table.collect(), key=lambda r: (r.conv_id, r.turn)):
        said.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    held = {c: zlib.crc32(str(c).encode()) % 5 == 0 for c in said}
    start, follow, kinds, lines, turns = np.zeros(3), np.zeros((3, 3)), np.zeros((3, chat.N_FEATURES)), 0, 0
    for c, rows in said.items():
        if not held[c]:
            roles = [chat.ROLES.index(r) for _, r, _ in rows]
            start[roles[0]] += 1
            for a, b in zip(roles, roles[1:]):
                follow[a, b] += 1
            for role, (_, _, text) in zip(roles, rows):
                turns += 1
                for i, line in enumerate(text.split("\n")):
                    kinds[role, chat.line_feature(line, i)] += 1
                    lines += 1
    norm = lambda x: np.log((x + 1) / (x + 1).sum(axis=-1, keepdims=True))
    start, follow, kinds, stay = norm(start), norm(follow), norm(kinds), 1 - turns / lines
    right = []
    for c, rows in said.items():
        score, path = None, []
        for _, _, text in rows:  # a turn's score by role: its lines, and a step for each
            body = text.split("\n")
            emit = np.array([sum(kinds[r, chat.line_feature(x, i)] for i, x in enumerate(body)) for r in range(3)])
            step = start if score is None else score[:, None] + follow
            path.append(step.argmax(axis=0) if score is not None else None)
            score = (step if score is None else step.max(axis=0)) + emit
        role = int(score.argmax())
        for (turn, known, text), back in reversed(list(zip(rows, path))):
            found = chat.ROLES[role]
            rendered = f"<|{found}|>\n{text}\n<|end|>\n"
            assert got[c, turn] == (held[c], found, hashlib.sha256(rendered.encode()).hexdigest())
            if held[c]:
                right.append(found == known)
            role = int(back[role]) if back is not None else role
    assert 0 < stay < 1 and len(got) == sum(map(len, said.values()))
    assert np.mean(right) >= 0.95


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(2)
    model = chat.ChatModel(np.array([3, 5, 1]), rng.integers(0, 9, (3, 3)), rng.integers(0, 9, (3, chat.N_FEATURES)), 0.5)
    emit = chat.emissions(np.array([1, -1, 2, -1]), np.array([0, 3, 5, 7]), model.kinds)

    def score(p):
        return model.first[p[0]] + emit[0, p[0]] + sum(model.next[a, b] + emit[i, b] for i, (a, b) in enumerate(itertools.pairwise(p), 1))

    best = max(itertools.product(range(6), repeat=4), key=score)
    assert score(chat.viterbi(emit, model.first, model.next)) == pytest.approx(score(best))


def test_raw_transcripts(spark):
    said = [(1, "User: hi\nhow?\nAssistant: fine.\nThanks\n\nHuman: ok"), (2, "### System: be nice\n<|user|> hello\n**Assistant:** yes\nno"), (3, None), (4, " "), (5, "just a line")]
    got = [(r.id, r.role) for r in chat.parse_transcripts(spark.createDataFrame(said, "id int, text string"), "id", "text").orderBy("id", "turn").collect()]
    assert got == [(1, "user"), (1, "assistant"), (1, "user"), (2, "system"), (2, "user"), (2, "assistant"), (5, "user")]


def test_odd_turns(spark):
    rows = [(None, None, None, None, "x"), (-1, 0, "user", "q", "x"), (1, 0, "user", "hi", None), (1, 0, "user", "hi", "y"), (1, 1, "robot", "", "z"), (1, None, "Assistant", "a\n" * 3000, "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, record string")
    got = chat.format_conversations(df, "conv_id", "turn", "role", "text").collect()
    assert len(got) == 6 and all(r.found_role in chat.ROLES and r.rendered.endswith("<|end|>\n") for r in got)
    assert chat.format_conversations(df.limit(0), "conv_id", "turn", "role", "text").count() == 0


def brute_pipeline(spark, sf):
    """The stages after toxicity, by plain Python over all rows."""
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    bad = {r.doc_id for r in toxicity.score_documents(spark.read.parquet(f"{sf}/documents.parquet"), labels).where("score >= 0.5").collect()}
    docs = sorted(d for d in docs if d[0] not in bad)
    sites, first = {}, {}
    for key, text, site in docs:
        for i, line in enumerate((text or "").split("\n")):
            if line.strip():
                sites.setdefault(line, set()).add(site)
                first.setdefault(line, (key, i))
    clean = [(k, "\n".join(x for i, x in enumerate(t.split("\n")) if not (x.strip() and len(sites[x]) >= 10 and first[x] != (k, i)))) for k, t, _ in docs]
    found = brute(clean)
    clean = [(k, t) for k, t in clean if found[k][1] == k]
    items = [set(shingles(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    return {k: t for k, t in clean if not any(100 * len(s & set(shingles(t))) >= 80 * len(s) for s in items if s)}


def test_pipeline_equals_brute_force(spark):
    import hashlib

    want = brute_pipeline(spark, SMALL)
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id: r.decoded_sha256 for r in got} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in want.items()}
    assert len(got) == len(want)


def test_stages_survive_odd_rows(spark, odd, none, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    for table, least in ((odd, 1), (none, 0)):
        docs = table
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == list(corpus_pipeline.COLUMNS)
                assert dict(out.dtypes)["n_chars"] == "bigint"
                docs = scratch.materialize(out.withColumn("score", F.lit("x")).withColumn("h", F.lit("y")), f"test-{name}")
        assert out.count() >= least


def test_five_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard", "decontaminate", "byte_bpe"]
    assert corpus_pipeline.ORACLE_SQL is None
