"""Every query of the training-data operators over its whole small table, against plain Python."""

import collections
import hashlib
import math
import os
import zlib

import numpy as np
import pytest
from test_texts import WORD, base_spans, lower

from millwright.llm import common, registry

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in common.read(spark, SF, "documents").collect()}


def rows_of(spark, name):
    return registry.queries()[name](spark, SF).collect()


def remainder(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_nearest_vectors(spark):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in common.read(spark, SF, "embeddings").collect() if r["embedding"] is not None}
    good = {k: v for k, v in vectors.items() if len(v) and np.isfinite(v).all() and v.any()}
    ids = np.array(sorted(good))
    matrix = np.stack([good[i] for i in ids])
    found = collections.defaultdict(list)
    for r in rows_of(spark, "op1_nearest_vectors"):
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in (i for i in ids if i % 100 == 0):
        d = np.sqrt(((matrix - good[q]) ** 2).sum(axis=1))
        order = [k for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        got = sorted(found[q])
        assert [x[0] for x in got] == list(range(1, len(order) + 1)) and all(x[2] == pytest.approx(np.linalg.norm(good[x[1]] - good[q])) for x in got)
        hits += len({x[1] for x in got} & set(ids[order].tolist()))
        total += len(order)
    assert total and hits >= 0.9 * total


def test_probing_some_cells_finds_nine_tenths(spark):
    from pyspark.sql import functions as F

    from millwright.llm import ann

    rng = np.random.default_rng(11)
    centres = rng.normal(0, 1, (80, 16))
    x = centres[rng.integers(0, 80, 30_000)] + rng.normal(0, 0.6, (30_000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(set)
    for r in ann.search(df, F.col("vec_id") % 300 == 0, probe=40).collect():
        got[r["query_id"]].add(r["vec_id"])
    x = x.astype(np.float32).astype(float)
    hits = 0
    for q in got:
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argpartition(d, 10)[:10].tolist()))
    assert len(got) == 100 and hits >= 900


def test_languages(spark, texts):
    langs = {r["doc_id"]: r["lang"] for r in common.read(spark, SF, "documents").collect()}
    found = rows_of(spark, "op3_language_id")
    assert {r["doc_id"] for r in found} == set(texts) and all(r["held_out"] == (remainder(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in found)
    lettered = {i for i, t in texts.items() if any(c.isalpha() for c in t)}
    assert all((r["lang_pred"] == "und") == (r["doc_id"] not in lettered) for r in found)
    judged = [r["lang_pred"] == langs[r["doc_id"]] for r in found if r["held_out"] and r["doc_id"] in lettered and langs[r["doc_id"]] is not None]
    assert np.mean(judged) > 0.9


def test_stored_payloads(spark, texts):
    for r in rows_of(spark, "op5_transport_streams"):
        raw = texts[r["doc_id"]].encode("utf-8", "surrogatepass")
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_personal_data(spark, texts):
    kinds = ("email", "ip", "card", "phone")
    for r in rows_of(spark, "op7_personal_data"):
        base = sorted(base_spans(texts[r["doc_id"]]), key=lambda s: (kinds.index(s[0]), s[1]))
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        counts = collections.Counter(s[0] for s in base)
        assert tuple(r[f"n_{k}"] for k in kinds) == tuple(counts[k] for k in kinds) and r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_language_model(spark, texts):
    words = {i: WORD.findall(lower(t)) for i, t in texts.items()}
    learned = [i for i in texts if remainder(i, 10)]
    counts = collections.Counter(w for i in learned for w in words[i])
    ends, n = len(learned), sum(counts.values()) + len(learned)
    base = lambda c: math.log10((c + 0.1) / (n + 0.1 * (len(counts) + 2)))
    found = rows_of(spark, "op9_language_model")
    assert {r["doc_id"] for r in found} == set(texts)
    for r in found:
        w = words[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (remainder(r["doc_id"], 10) == 0, len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n)
        assert r["base_score"] == pytest.approx(sum(base(counts[x]) for x in w) + base(ends)) and math.isfinite(r["score"]) and r["score"] < 0
    # the model tells more than the counts do, on texts it has not seen
    assert sum(r["score"] for r in found if r["held_out"]) > sum(r["base_score"] for r in found if r["held_out"])


def test_quality(spark, texts):
    labels = {r["doc_id"]: r["quality"] for r in common.read(spark, SF, "labels").collect()}
    found = rows_of(spark, "op10_quality")
    assert {r["doc_id"] for r in found} == set(texts)
    assert all(r["held_out"] == (remainder(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    held = [(r["score"], labels[r["doc_id"]]) for r in found if r["held_out"] and labels.get(r["doc_id"]) is not None]
    up, down = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    if up and down:
        assert np.mean([(a > b) + (a == b) / 2 for a in up for b in down]) > 0.6
