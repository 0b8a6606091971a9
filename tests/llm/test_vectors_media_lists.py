import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwright.llm import ann, mpegts, urls


def brute(rows, k=10):
    good = {i: np.asarray(v, float) for i, v in rows if v is not None and i is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q in sorted(i for i in good if i % 100 == 0):
        near = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q)
        out[q] = near[:k]
    return out


def test_search_equals_brute_force_where_all_cells_are_visited(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(0, 1, 16).tolist()) for i in range(1200)]
    hot = rng.normal(0, 1, 16).tolist()
    rows += [(2000 + i, hot) for i in range(400)]  # copies, a quarter of all rows
    rows += [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [None] * 16), (None, hot), (100, rows[100][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit("clash"))
    got = ann.search(df, F.col("vec_id") % 100 == 0).collect()
    want = brute(rows[:-2])
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert set(found) == set(want)
    hits = sum(len({i for _, i in found[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.97 * 10 * len(want)
    for q in (2000, 2100):
        assert [i for _, i in found[q]] == [i for _, i in want[q]]
    assert all(len(v) == 10 for v in found.values())


def test_search_of_few_or_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.search(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], schema)
    rows = ann.search(few, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in rows] == [(1, 2), (2, 1)] and rows[0]["score"] == 1.0
    alone = ann.search(few.limit(1), F.lit(True))
    assert alone.count() == 0


def test_bounds_hold_and_estimates_are_unbiased():
    rng = np.random.default_rng(1)
    d = 64
    x, q = rng.normal(0, 1, (2000, d)), rng.normal(0, 1, (20, d))
    turn = ann.rotation(d)
    assert np.allclose(turn @ turn.T, np.eye(d))
    low, high = ann.estimate(q, *ann.encode(x, turn), turn)
    exact = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    assert ((low <= exact) & (exact <= high)).mean() > 0.99
    assert abs(((low + high) / 2 - exact).mean()) < 0.5


def test_streams_round_trip():
    rng = np.random.default_rng(2)
    for n in [0, 1, 63, 64, 128, *range(150, 190), 340, 355, 8191, 8192, 8193, 70_000, 1_000_003]:
        payload = rng.bytes(n)
        media = mpegts.mux_bytes(payload)
        got = mpegts.demux_bytes(media)
        assert len(media) % 188 == 0 and got["payload"] == payload and not got["faults"]
        assert [u["bytes"] for u in got["units"]] == [len(payload[i : i + mpegts.UNIT_BYTES]) for i in range(0, max(n, 1), mpegts.UNIT_BYTES)]
        assert [u["pts"] for u in got["units"]] == [i * mpegts.TICKS for i in range(len(got["units"]))]
        assert got["units"][0]["random_access"] and got["programs"] == got["streams"] == 1


def test_faults_are_reported():
    media = mpegts.mux_bytes(bytes(range(256)) * 40)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    assert mpegts.crc32_mpeg(b"123456789") == 0x0376E6E7
    lost = b"".join(packets[:10] + packets[11:])
    assert "continuity" in mpegts.demux_bytes(lost)["faults"]
    twice = b"".join(packets[:10] + [packets[9]] + packets[10:])
    assert mpegts.demux_bytes(twice)["payload"] == bytes(range(256)) * 40
    broken = bytearray(media)
    broken[12] ^= 1
    assert "table checksum" in mpegts.demux_bytes(bytes(broken))["faults"]
    assert mpegts.demux_bytes(media[:-1])["faults"] and mpegts.demux_bytes(b"") ["payload"] == b"" and "lost sync" in mpegts.demux_bytes(b"x" * 188)["faults"]


def test_media_columns(spark):
    rows = [(1, b"abc"), (2, None), (3, b""), (3, b""), (4, os.urandom(100_000))]
    df = spark.createDataFrame(rows, "doc_id long, p binary").withColumn("media", F.lit(1))
    back = mpegts.demux(mpegts.mux(df, "p", keep=["doc_id"]), keep=["doc_id"]).collect()
    assert sorted((r["doc_id"], bytes(r["read"]["payload"])) for r in back) == sorted((i, p or b"") for i, p in rows)
    assert mpegts.mux(df.limit(0), "p", keep=["doc_id"]).count() == 0


def test_path_rules_keep_their_case(spark):
    entries = spark.createDataFrame([("X.org/Wiki", "2024-01-01", "add"), ("Host.ORG", "2024-01-01", "add"), (None, "2024-01-01", "add")], "rule string, day string, action string")
    rows = ["http://x.org/Wiki/1", "http://X.ORG/Wiki", "http://x.org/wiki/1", "http://host.org/Any"]
    df = spark.createDataFrame([(i, u, "2024-01-02") for i, u in enumerate(rows)], "id int, url string, fetched string")
    got = {r["id"]: r["rule"] for r in urls.judge(df, entries, keep=["id"]).collect()}
    assert got == {0: "x.org/Wiki", 1: "x.org/Wiki", 2: None, 3: "host.org"}


def test_list_as_of(spark):
    entries = spark.createDataFrame([("bad.com", "2024-01-10", "add"), ("bad.com", "2024-01-20", "remove"), ("bad.com", "2024-02-01", "add"), ("x.bad.com/news", "2024-01-15", "add"), (None, "2024-01-01", "add"), ("z.com", None, "add"), ("tie.com", "2024-01-01", "add"), ("tie.com", "2024-01-01", "remove")], "rule string, day string, action string")
    days = ["2024-01-09", "2024-01-10", "2024-01-19", "2024-01-20", "2024-02-05"]
    rows = [(f"http://u:p@X.bad.com:80/news/1?q#f", d) for d in days] + [("https://notbad.com/", "2024-01-12"), (None, "2024-01-12"), ("junk", "2024-01-12"), ("http://bad.com", None), ("http://tie.com/a", "2024-03-01"), ("http://bad.com/", "2024-01-12"), ("http://bad.com/", "2024-01-12")]
    df = spark.createDataFrame([(i, u, d) for i, (u, d) in enumerate(rows)], "id int, url string, fetched string").withColumn("rule", F.lit("clash"))
    got = {r["id"]: (r["blocked"], r["rule"], r["n_active"]) for r in urls.judge(df, entries, keep=["id"]).collect()}
    assert got[0] == (False, None, 0) and got[1] == (True, "bad.com", 1) and got[2] == (True, "x.bad.com/news", 2)
    assert got[3] == (True, "x.bad.com/news", 1) and got[4] == (True, "x.bad.com/news", 2)
    assert not any(got[i][0] for i in (5, 6, 7, 8)) and got[9][0] and got[10] == got[11] == (True, "bad.com", 1)
    assert urls.judge(df, entries.limit(0), keep=["id"]).where("blocked").count() == 0 and urls.judge(df.limit(0), entries, keep=["id"]).count() == 0
