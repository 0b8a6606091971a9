import itertools
import math
import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millwright.llm import common, registry, segment
from millwright.llm.lattice import PieceTable, load_pieces

SF = "/root/testdata/sf0.001"
NAMES = load_pieces(segment.MODEL_FILE)
TABLE, WEIGHTS, RANK = PieceTable.of(NAMES), segment.weights(NAMES), {p: i for i, p in enumerate(NAMES)}


def all_segmentations(text):
    chunks, order, _ = segment.chunked(pa.array([text]))
    each = []
    for c in (chunks[i] for i in order):
        found = {}

        def walk(at, mask, weight, c=c, found=found):
            if at == len(c):
                found[mask] = weight
            for length in range(1, len(c) - at + 1):
                piece = c[at : at + length]
                if piece.replace(" ", "▁") in RANK and "▁" not in piece:
                    walk(at + length, mask | 1 << (at + length - 1), weight + WEIGHTS[RANK[piece.replace(" ", "▁")]])
                elif length == 1:
                    walk(at + 1, mask | 1 << at, weight + WEIGHTS[-1] * len(piece.encode()))

        walk(0, 0, 0.0)
        z = np.logaddexp.reduce(list(found.values()))
        each.append({m: w - z for m, w in found.items()})
    return {tuple(m for m, _ in combo): sum(w for _, w in combo) for combo in itertools.product(*(e.items() for e in each))}


@pytest.mark.parametrize("text", ["to be", "abcdefghij", "é▁☃"])
def test_samples_follow_the_law_without_replacement(text):
    law, n, k = all_segmentations(text), 6000, 3
    paths = segment.Paths(pa.array([text] * n), [str(i) for i in range(n)], segment.Lattices(TABLE, WEIGHTS), k, 1)
    drawn = {}
    for _, texts, mask, logp, perturbed in paths.masks():
        rows = mask.reshape(n, -1)
        for i, t in enumerate(texts):
            drawn.setdefault(t, []).append((tuple(int(m) for m in rows[t]), logp[i], perturbed[i]))
    most = min(k, len(law))
    for d in drawn.values():
        assert len({m for m, _, _ in d}) == len(d) and all(a[2] > b[2] for a, b in zip(d, d[1:])) and all(abs(law[m] - p) < 1e-3 for m, p, _ in d)
    assert np.mean([len(d) for d in drawn.values()]) > most - 0.2
    p = {m: math.exp(v) for m, v in law.items()}
    top = sorted(p, key=p.get)[-4:]
    first = Counter(d[0][0] for d in drawn.values())
    second = Counter((d[0][0], d[1][0]) for d in drawn.values() if len(d) > 1)
    for a in top:
        assert first[a] / n == pytest.approx(p[a], abs=4 * math.sqrt(p[a] / n) + 1e-3)
        for b in top:
            if a != b:
                want = p[a] * p[b] / (1 - p[a])
                assert second[(a, b)] / n == pytest.approx(want, abs=4 * math.sqrt(want / n) + 2e-3)


def test_round_trip_of_odd_texts(spark):
    texts = [None, "", " ", "\n\n", "a  b \n c", "▁ literal ▁", "☃𝒳é", "x" * 200, "tail ", " head", "The quick brown fox.\nJumps.", "\x00\x1f"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "to be"), (None, "to be")], "doc_id long, text string").withColumn("sample", F.lit("clash"))
    rows = segment.sample(df, pieces=True).collect()
    known = set(NAMES)
    for r in rows:
        if r["doc_id"] is None:
            continue
        assert segment.decode(r["pieces"]) == (texts[r["doc_id"]] or "") and len(r["pieces"]) >= r["n_pieces"] >= 0
        assert all(p in known or p.startswith("<0x") for p in r["pieces"]) and 0 <= r["inclusion"] <= 1
    by = Counter(r["doc_id"] for r in rows)
    assert by[0] == by[1] == 1 and by[10] == segment.SAMPLES
    twins = [tuple(r["pieces"]) for r in rows if r["doc_id"] is None]
    assert Counter(Counter(twins).values()) == Counter({2: len(set(twins))})
    alone = segment.sample(df.where("doc_id = 10")).collect()
    assert {r["digest"] for r in alone} == {r["digest"] for r in rows if r["doc_id"] == 10}
    assert segment.sample(df.limit(0)).count() == 0


def test_speller_equals_spelling_one_by_one():
    chunks = [" the", "☃𝒳a", "▁x", " a"]
    order, mask = np.array([0, 1, 2, 0, 3, 1]), np.array([8, 7, 3, 9, 3, 7], np.uint64)
    speller = segment.Speller(NAMES)
    numbers, ends = speller.spell(chunks, order, mask, np.array([0, 2, 2, 6]))
    got = speller.names.take(pa.array(numbers)).to_pylist()
    want = [segment.spelled(chunks[c], int(m), set(NAMES)) for c, m in zip(order, mask)]
    assert got == sum(want, []) and ends.tolist() == [0, len(want[0] + want[1]), len(want[0] + want[1]), len(got)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_query_and_stage_write_the_pieces(spark):
    import corpus_pipeline as pipeline

    texts = {r["doc_id"]: r["text"] or "" for r in common.read(spark, SF, "documents").select("doc_id", "text").collect()}
    odd = {1: "漢字 ☃𝒳", 2: "plain words", 3: ""}
    df = spark.createDataFrame(list(odd.items()), "doc_id long, text string")
    for rows, of in ((segment.query(spark, SF).collect(), texts), (pipeline.encoded(spark, df, SF).collect(), odd)):
        assert {r["doc_id"] for r in rows} == set(of)
        for r in rows:
            assert segment.decode(r["pieces"]) == of[r["doc_id"]] and r["n_pieces"] == len(r["pieces"])
        assert len({(r["doc_id"], r["digest"]) for r in rows}) == len({(r["doc_id"], tuple(r["pieces"])) for r in rows}) == len(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = registry.queries()[name](spark, SF)
    found = c.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    fix = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted((tuple(fix(r[n]) for n in names) for r in df.collect()), key=repr)
    assert got == sorted((tuple(map(fix, r)) for r in found.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_pipeline_stages_each_do_their_part(spark):
    import corpus_pipeline as pipeline

    docs = common.read(spark, SF, "documents")
    extra = spark.createDataFrame([(90_000, "12345 67890", None, "src0", 11), (90_001, None, None, None, None)], docs.schema)
    now = docs.unionByName(extra)
    seen = {}
    for name, stage in pipeline.STAGES:
        now = common.table(stage(spark, now, SF), name)
        seen[name] = now
        if name != "segmentation":
            assert now.columns == docs.columns
    assert seen["language_id"].where("doc_id >= 90000").count() == 0 and seen["language_id"].count() == docs.count()
    from millwright.llm import dedup

    assert dedup.near_duplicates(seen["near_dedup"], words=5).where("doc <> component").count() == 0
    assert seen["personal_data"].count() == seen["near_dedup"].count()
    assert seen["personal_data"].where(F.col("text").rlike(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|@mail")).count() == 0
    words = lambda df: df.agg(F.sum(common.word_count(F.col("text")))).first()[0]
    assert words(seen["mixing"]) == pytest.approx(1.5 * words(seen["personal_data"]), rel=0.1)
    assert seen["segmentation"].select("doc_id").distinct().count() == seen["mixing"].select("doc_id").distinct().count()
    assert pipeline.run(spark, SF).columns[0] == "doc_id"


def test_frequent_chunks_keep_their_lattices(monkeypatch):
    monkeypatch.setattr(segment, "HELD", 3)
    monkeypatch.setattr(segment, "MOST", 8, raising=False)
    made, add = [], segment.Lattices._add
    monkeypatch.setattr(segment.Lattices, "_add", lambda self, chunks: made.extend(chunks) or add(self, chunks))
    table, often = PieceTable.of(NAMES), [" everywhere", " throughout"]
    held = segment.Lattices(table, WEIGHTS)
    state = np.arange(2, dtype=np.uint64) * np.uint64(77)
    fresh = segment.Lattices(table, WEIGHTS)
    want = fresh.sample(fresh.numbers(often), state, 2)
    made.clear()
    for i in range(12):
        numbers = held.numbers([f" a{i}", f" b{i}", f" c{i}", *often])
        got = held.sample(numbers[3:], state, 2)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
        assert len(held.chunks) <= 8 + 5 and [held.chunks[n] for n in numbers[3:]] == often
    assert all(made.count(c) == 1 for c in often)


def test_only_long_chunks_are_cut_in_runs():
    long = "x" * 50 + "y" * 48
    chunks, order, per_text = segment.chunked(pa.array([f"ab {long} ab", "ab", f"{long} cd", ""]))
    assert len(set(chunks)) == len(chunks) and max(map(len, chunks)) == 48
    assert ["".join(chunks[i] for i in order[a:b]) for a, b in zip(per_text, per_text[1:])] == [f" ab {long} ab", " ab", f" {long} cd", ""]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("stage", ["language", "encoded"])
def test_python_stages_of_the_pipeline_take_few_whole_texts_at_once(spark, stage):
    import corpus_pipeline as pipeline

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        getattr(pipeline, stage)(spark, common.read(spark, SF, "documents"), SF)
        seen = [r["n"] for r in spark.range(5000).coalesce(1).mapInArrow(sizes, "n long").collect()]
        assert sum(seen) == 5000 and max(seen) <= 2000
    finally:
        spark.conf.set(key, before)


def test_small_batches_are_bounded_in_bytes_too(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    wide = spark.range(0, 600, 1, 1).select(F.repeat(F.lit("x"), 50_000).alias("text"))
    before = [spark.conf.get(k) for k in common.BATCH_SETTINGS]
    with common.small_batches(spark, 1000):
        seen = wide.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r["n"] for r in seen) == 600 and max(r["bytes"] for r in seen) < 6 << 20
    assert sum(r["n"] > 1 for r in seen) > 1 and [spark.conf.get(k) for k in common.BATCH_SETTINGS] == before
    assert [common._smaller(x, 4 << 20) for x in ("67108864b", "64m", "1k", "0", "-1")] == ["4194304", "4194304", "1024", "4194304", "4194304"]


def test_a_worker_gives_memory_back_when_its_task_ends():
    held = lambda: int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGESIZE") / 1e6
    pinned, seen = [], []

    def run(batches):
        blocks = [np.ones(12_000) for _ in range(2_000)]  # each too small for a mapping of its own
        pinned.append(blocks[-1])  # the heap's end stays in use, so nothing goes back by itself
        seen.append(held())
        del blocks
        yield from batches

    assert list(common.lean(run)(iter([1, 2]))) == [1, 2]
    assert held() < seen[0] - 120


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_executors_give_heap_back_before_a_stage_of_the_pipeline(spark):
    import corpus_pipeline as pipeline

    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    whole = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = whole()
    pipeline.mixed(spark, common.read(spark, SF, "documents"), SF)
    assert whole() > before


def test_samples_are_spelled_together_and_digests_follow_from_the_pieces(monkeypatch):
    texts = ["to be or not", "漢字 ☃ ab", "", "x" * 60, "to be"]
    paths = segment.Paths(pa.array(texts), list("abcde"), segment.Lattices(TABLE, WEIGHTS), 4, 1)
    (whole,) = segment._together(paths)
    monkeypatch.setattr(segment, "GROUP", 1)
    assert [[g[0] for g in x] for x in segment._together(paths)] == [[0], [1], [2], [3]] and [g[0] for g in whole] == [0, 1, 2, 3]
    speller, size = segment.Speller(NAMES), np.diff(paths.offsets)
    orders = [paths.own_order if g[5] is None else paths.own_order[g[5]] for g in whole]
    ends = np.cumsum(np.concatenate([[0], *(size[g[1]] for g in whole)]))
    numbers, cuts, digest = speller.digested(paths.own, np.concatenate(orders), np.concatenate([g[2] for g in whole]), ends, np.arange(len(speller.names)))
    assert len(digest) == len(cuts) - 1 == sum(len(g[1]) for g in whole) and sum(len(g[1]) == 4 for g in whole) == 3
    for i, text in enumerate(np.concatenate([g[1] for g in whole]).tolist()):
        own = numbers[cuts[i] : cuts[i + 1]]
        assert segment.decode(speller.names.take(pa.array(own)).to_pylist()) == texts[text]
        assert int(digest[i]) == sum(int(speller.code[n]) * place for place, n in enumerate(own.tolist(), 1)) % (1 << 64)


def test_lattices_hold_edges_of_pieces_alone_with_their_probabilities():
    chunks = [" everywhere", " thé☃x▁tail", "abcdefghijklmnop", " to", " a x b c d e f"]
    held = segment.Lattices(TABLE, WEIGHTS)
    numbers = held.numbers(chunks)
    edges = 0
    for c, number in zip(chunks, numbers.tolist()):
        n, weight = len(c), {}
        for a, b in itertools.combinations(range(n + 1), 2):
            piece = c[a:b]
            if piece.replace(" ", "▁") in RANK and "▁" not in piece:
                weight[a, b] = math.exp(WEIGHTS[RANK[piece.replace(" ", "▁")]])
            elif b == a + 1:
                weight[a, b] = math.exp(WEIGHTS[-1] * len(piece.encode()))
        rest = [0.0] * n + [1.0]
        for a in reversed(range(n)):
            rest[a] = sum(w * rest[y] for (x, y), w in weight.items() if x == a)
        if n <= segment.SHORT:
            edges += 1 << n - 1
            continue
        edges += len(weight)
        for a, b in weight:
            assert held._rest(number, a, [b - a]) == pytest.approx(weight[a, b] * rest[b] / rest[a], rel=1e-5)
    assert held.used == edges
    # dropped chunks make room, and those that stay keep theirs
    before = [held._own(i) for i in numbers.tolist() if held.n[i] > segment.SHORT]
    held.numbers([" elsewhere", " nothing", *chunks])
    segment.HELD, most = len(chunks), segment.HELD
    try:
        held._drop()
    finally:
        segment.HELD = most
    numbers = held.numbers(chunks)
    assert held.used == edges and [held._own(i) for i in numbers.tolist() if held.n[i] > segment.SHORT] == before
