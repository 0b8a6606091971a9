import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millwright.llm import common, dedup, graph, langid, lblm, mixing, pii, quality

#: nulls, empty and blank texts, a very long one, copies, and odd characters
ODD = [None, "", " \n\t", "a", "naïve café ▁ ☃ 𝒳", "x" * 5000, "to be or not to be", "to be or not to be", "the quick brown fox " * 3000, "1 2 3 4", "\x1c\x85 　sep"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s") for i, t in enumerate(ODD)] + [(None, "no id here at all", "en", "s"), (3, "a", "en", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("_mix_block", F.lit("clash"))


def lower(t):
    return (t or "").translate(str.maketrans(common.UPPER, common.UPPER.lower()))


def shingle_set(t):
    w = WORD.findall(lower(t))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def links(texts):
    ids = sorted(texts)
    sets = {i: shingle_set(texts[i]) for i in ids}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\té\x1c　", max_size=12), max_size=6))
def test_words_are_cut_at_ascii_space_only(texts):
    data, offsets = common.text_bytes(pa.array(texts, pa.string()))
    words, order, per_text = common.words_of(data, offsets)
    words = words.to_pylist()
    got = [[words[k].decode() for k in order[a:b]] for a, b in zip(per_text[:-1], per_text[1:])]
    assert got == [WORD.findall(t) for t in texts]


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocabulary, n).tolist() for n in (12, 40, 90, 200)]
    texts = {}
    for i in range(260):
        words = list(base[i % 4])
        for _ in range(int(rng.integers(0, 1 + len(words) // 12))):
            words[int(rng.integers(len(words)))] = "New" + str(rng.integers(50))
        texts[i] = " ".join(words)
    # a crowd of near copies, more than one region holds with all its pairs
    for i in range(300, 480):
        words = list(base[2])
        for _ in range(3):
            words[int(rng.integers(len(words)))] = f"v{rng.integers(500)}"
        texts[i] = " ".join(words)
    texts |= {500: None, 501: "", 502: "one two", 503: "ONE two", 504: "one two three", 505: "\n"}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, n int")
    got = {r["doc"]: (r["n"], r["component"]) for r in dedup.near_duplicates(df).collect()}
    assert got == links(texts)


def test_near_duplicates_by_the_number_of_words(spark):
    words = [f"w{i}" for i in range(98)]
    # one word changed of 98, and two far apart: linked at four words and at five
    near = words[:40] + ["x"] + words[41:]
    far = words[:30] + ["y"] + words[31:60] + ["z"] + words[61:]
    short, cut = [f"v{i}" for i in range(46)], [f"v{i}" for i in range(46)]
    cut[20] = "n"  # 39 of 47 four-word shingles are shared, 37 of 47 of five words
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(short)), (5, " ".join(cut))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    four = {r["doc"]: r["component"] for r in dedup.near_duplicates(docs).collect()}
    assert four == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    five = {r["doc"]: r["component"] for r in dedup.near_duplicates(docs, words=5).collect()}
    assert five == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_near_duplicates_of_odd_rows(spark, odd):
    rows = dedup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {(r["doc"], r["n"]): r["component"] for r in rows}
    assert by[(7, 3)] == 6 and by[(0, 0)] == 0 and all(r["component"] is None for r in rows if r["doc"] is None)
    assert dedup.near_duplicates(odd.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(0, 150)] + [(200, int(x)) for x in rng.integers(201, 260, 40)] + [(300, 300)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(151)) and all(v == 200 for k, v in got.items() if k >= 200) and 300 not in got


def test_language_is_learned_from_marked_rows_only(spark, odd):
    rng = np.random.default_rng(2)
    words = {"xx": ["thing", "with", "there", "this"], "yy": ["schaft", "nicht", "durch", "keit"]}
    rows = [(i, " ".join(rng.choice(words["xy"[i % 2] * 2], 30)), "xy"[i % 2] * 2) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = common.id_remainder(F.col("doc_id"), 4) == 2
    lied = docs.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang")))
    model = langid.fit(lied, ~held)
    assert model.languages == ["xx", "yy"]
    out = {r["doc_id"]: r for r in langid.predict(lied, model).collect()}
    assert all(out[i]["lang_pred"] == lang and out[i]["score"] > 0.9 for i, _, lang in rows)
    strange = langid.predict(odd, model).collect()
    assert len(strange) == odd.count() and {r["lang_pred"] for r in strange if r["doc_id"] in (0, 1, 2, 9)} == {"und"}
    assert langid.predict(odd, langid.fit(odd.limit(0), F.lit(True))).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(odd.limit(0), model).count() == 0


def test_word_probability_sums_over_all_segmentations():
    table = langid.PieceTable.of(["▁", "a", "b", "ab", "▁a"])
    p = np.array([[0.2], [0.3], [0.1], [0.25], [0.15], [1e-6]])
    want = 0.2 * 0.3 * 0.1 + 0.2 * 0.25 + 0.15 * 0.1
    assert langid.word_scores(["ab"], table, p)[0, 0] == pytest.approx(math.log(want))
    assert langid.word_scores(["☃"], table, p)[0, 0] == pytest.approx(math.log(0.2e-6))
    long = "ab" * 40
    assert np.isfinite(langid.word_scores([long], table, p)).all()


def test_mix_meets_targets_and_repeats_itself(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 30))), ["a", "b", "c", "d", None][int(rng.integers(5)) if i % 3 else 0]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes, plan = mixing.plan(docs)
    got = mixing.assign(sizes, plan).select("_mix_id", "_mix_source", "_mix_size", "_mix_source_size", "_mix_target", F.size("_mix_draws").alias("k")).collect()
    total = collections.Counter()
    for _, t, s in rows:
        total[s] += len(WORD.findall(t))
    order = sorted(s for s in total if s) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(total.values())
    while True:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 2 * total[s]}
        if not over:
            target |= {s: share * weight[s] for s in free}
            break
        target |= {s: 2.0 * total[s] for s in over}
        left -= sum(2 * total[s] for s in over)
        free -= over
    taken = collections.Counter()
    for r in got:
        assert r["_mix_target"] == pytest.approx(target[r["_mix_source"]]) and r["_mix_source_size"] == total[r["_mix_source"]] and 0 <= r["k"] <= 2
        taken[r["_mix_source"]] += r["k"] * r["_mix_size"]
    assert all(abs(taken[s] - target[s]) <= 31 for s in order)
    mixed = mixing.mix(docs.repartition(5))
    again = mixing.mix(docs)
    key = lambda df: sorted((r["doc_id"], r["mix_copy"], r["mix_shard"]) for r in df.collect())
    assert key(mixed) == key(again)
    by = {r["mix_shard"]: r["count"] for r in mixed.groupBy("mix_shard").count().collect()}
    assert set(by) <= set(range(mixing.SHARDS)) and len(by) == mixing.SHARDS and max(by.values()) < 2 * min(by.values())


def test_splitting_tree_keeps_quotas_and_varies_by_the_law(spark):
    plan = spark.createDataFrame([(1, 100), (2, 30), (3, 0)], "_mix_rank int, _mix_drawn long")
    cuts = {r["_mix_rank_of"]: r["_mix_cuts"] for r in mixing.split(plan, 4, 1).collect()}
    assert all(c == sorted(c) and len(c) == 4 for c in cuts.values()) and cuts[1][-1] == 100 and cuts[2][-1] == 30 and cuts[3] == [0, 0, 0, 0]
    assert cuts[1][1] + cuts[2][1] == 65
    draws = spark.range(1, 3001).select(F.col("id").alias("node"), F.explode(F.sequence(F.lit(0), F.lit(129))).alias("number")).withColumn("rank", F.when(F.col("number") < 100, 1).otherwise(2))
    many = mixing.halve(draws, 1).withColumn("left", 1 - F.col("node") % 2).groupBy(F.floor(F.col("node") / 2)).agg(*(F.sum(F.when(F.col("rank") == k, F.col("left"))) for k in (1, 2)))
    x = np.array([tuple(r)[1:] for r in many.collect()])
    # hypergeometric: mean 15, deviation sqrt(65 * 30/130 * 100/130 * 65/129) = 2.41
    assert (x.sum(axis=1) == 65).all() and abs(x[:, 1].mean() - 15) < 0.2 and abs(x[:, 1].std() - 2.41) < 0.15
    with pytest.raises(ValueError):
        mixing.split(plan, 3)


def test_mix_of_odd_rows(spark, odd):
    assert mixing.mix(odd).columns == [*odd.columns, "mix_copy", "mix_shard", "mix_order"]
    assert mixing.mix(odd).count() > 0 and mixing.mix(odd.limit(0)).count() == 0
    assert mixing.mix(odd.where("text = ''")).count() >= 0
    sizes = {r["_mix_id"]: r["_mix_size"] for r in mixing.sized(odd).collect()}
    assert sizes[10] == len(WORD.findall(ODD[10])) and sizes[0] == 0


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    t, out = t or "", []
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
    return out


def test_strict_spans_equal_plain_regular_expressions(spark):
    rng = np.random.default_rng(4)
    parts = ["a.b@c.de", "a@b.c_d@e.f", "x@y", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "001.002.003.004", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500000000000004", "+1 (555) 010-9999", "+4912", "+1+2 345 678 901", "é", "𝒳", "--", " ", "\n", "card", "mail", "9" * 40, "@", "+"]
    texts = ["".join(rng.choice(parts, int(rng.integers(1, 9)))) for _ in range(400)] + [" ".join(rng.choice(parts, 6)) for _ in range(200)] + ["a" * 50_000 + "@", "1" * 20_000 + ".", None, "", "1.2.3." * 3000, "@a.b" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["spans"] for r in pii.detect(df, keep=["doc_id"]).collect()}
    for i, t in enumerate(texts):
        strict = [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in out[i] if s["strict"]]
        assert strict == base_spans(t), t
        order = [(s["kind"], s["start"]) for s in out[i]]
        assert order == sorted(order)


def test_reliability_is_learned_and_spans_are_added(spark):
    rows = [(i, f"my card number 4111 1111 1111 1111 and mail jo.{i}@site.org from host 8.8.{i % 200}.8 call +1 555 010 9999") for i in range(200)]
    rows += [(1000, "write to jo [at] site [dot] org please"), (1001, "token 1234567890123"), (1002, None), (1003, "plain words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("votes", F.lit("clash"))
    spans = {r["doc_id"]: r["spans"] for r in pii.detect(df, keep=["doc_id"]).collect()}
    assert len(spans[0]) == 4 and spans[1002] == [] and spans[1003] == []
    found = pii.candidates(df, keep=["doc_id"])
    trust = {(r["kind"], tuple(r["votes"])): r["posterior"] for r in pii.estimate(found).collect()}
    strong = [v for (k, votes), v in trust.items() if votes[0] == 1]
    weak = [v for (k, votes), v in trust.items() if k == 2 and votes[0] == -1]
    assert min(strong) > 0.9 and max(weak, default=0) < 0.5
    text = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert text[0] == "my card number [card] and mail [email] from host [ip] call [phone]" and text[1002] is None and text[1003] == "plain words"
    assert pii.detect(df.limit(0), keep=["doc_id"]).count() == 0 and pii.redact(df.limit(0)).count() == 0


def test_cards_inside_a_longer_run_of_digits_are_found(spark):
    rows = [(i, f"my card number 4111-1111-1111-1111 is listed {i}") for i in range(200)]
    rows += [(1000, "card 4111 1111 1111 1111 5500 0000 0000 0004"), (1001, "card 4111 1111 1111 1111 05 27 end"), (1002, "card 4111-1111-1111-1111 123")]
    rows += [(2000 + i, f"card 4111/1111/1111/{i:04d} pay") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r[0]["doc_id"]: [(s["start"], s["end"]) for s in r[1] if s["kind"] == 2] for r in pii.candidates(df, keep=["doc_id"]).collect()}
    assert found[1000] == [(5, 24), (25, 44)] and found[1001] == [(5, 24)] and (5, 24) in found[1002] and len(found[0]) == 1
    spans = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == 2] for r in pii.detect(df, keep=["doc_id"]).collect()}
    assert spans[1000] == [(5, 24), (25, 44)] and spans[1001] == spans[1002] == [(5, 24)]
    text = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert text[1000] == "card [card] [card]" and text[1001] == "card [card] 05 27 end" and text[1002] == "card [card] 123"


def test_language_model_counts_and_normalises(spark, odd):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(str(w) for w in rng.choice(words, int(rng.integers(0, 40)), p=np.arange(1, 41) / 820))) for i in range(300)] + [(900, "never seen W1"), (901, None), (902, "w1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash"))
    learn = common.id_remainder(F.col("doc_id"), 10) != 0
    out = {r["doc_id"]: r for r in lblm.score(df, learn).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    counts, ends = collections.Counter(), 0
    for i, t in rows:
        if not held(i):
            counts.update(WORD.findall(lower(t)))
            ends += 1
    n = sum(counts.values()) + ends
    base = lambda c: math.log10((c + 0.1) / (n + 0.1 * (len(counts) + 2)))
    for i, t in rows:
        w = WORD.findall(lower(t))
        r = out[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["learned"]) == (len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n, not held(i))
        assert r["base_score"] == pytest.approx(sum(base(counts[x]) for x in w) + base(ends), abs=1e-9)
        assert math.isfinite(r["score"])
    assert lblm.score(odd, F.lit(True)).count() == odd.count() and lblm.score(odd.limit(0), F.lit(True)).count() == 0
    nothing = lblm.score(odd, F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in nothing)


def test_rare_words_fall_into_subclasses_that_grow(spark):
    made = lambda n: spark.createDataFrame([(int(i) * 7919 - 3000, 5 if i < 10 else 1) for i in range(n)], "word long, n long")
    few, many = lblm.vocabulary(made(110), 3, classes=10, heavy=60), lblm.vocabulary(made(910), 3, classes=10, heavy=60)
    assert (few.subclasses, many.subclasses) == (10, 30)
    names = np.array([i * 7919 - 3000 for i in range(910)])
    kind = many.class_of(names)
    assert len(set(kind[10:])) > 15 and kind[10:].min() >= many.other and many.end == 10 and len(many.unigram) == 41
    assert many.other_tokens.sum() == many.other_distinct.sum() == 900 and many.unigram.sum() == pytest.approx(1)
    # the words of each subclass share it wholly, but for the part of unseen ones
    for c in set(kind[10:]):
        own = (kind == c).sum()
        assert own * 10 ** many.share(1, c - many.other) == pytest.approx(1.1 * own / (own + 0.1 * (own + 1)))


def test_normalisers_and_training_improve_on_unigrams(spark):
    rng = np.random.default_rng(6)
    v = lblm.Vocabulary(np.arange(8), np.full(8, 100), np.arange(8), 50, 850, 8, 0, 0, np.append(np.full(8, 100.0), [50, 0.5]) / 850.5)
    # words follow each other in a ring
    tokens = (np.arange(4000) + rng.integers(0, 2, 4000) * 0) % 8
    trainer = lblm.Trainer(v)
    sequence = lblm.sequence(tokens, np.array([0, len(tokens)]), v)
    for _ in range(60):
        trainer.learn(*sequence)
    z = lblm.normalisers(spark, trainer.p, 10)
    token, one, two = sequence
    scores = trainer.p.hidden(one, two) @ trainer.p.word.T + trainer.p.bias
    assert np.allclose(np.log(np.exp(scores).sum(axis=1)), z[one, two], atol=1e-3)
    logs = scores[np.arange(len(token)), token] - z[one, two]
    assert logs.mean() > np.log(v.unigram[token]).mean() + 0.5


def test_quality_separates_and_scores_everything(spark, odd):
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for i in range(400):
        good = i % 2
        words = ["".join(rng.choice(list("abcde"), 5)) for _ in range(60)]
        rows.append((i, " ".join(words).capitalize() + "." if good else "!! ".join(w.upper() for w in words)))
        labels.append((i, good, 0))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, learn=common.id_remainder(F.col("doc_id"), 5) != 0)
    out = {r["doc_id"]: r for r in quality.predict(docs, model).collect()}
    assert all(out[i]["predicted"] == i % 2 for i, _ in rows)
    strange = quality.predict(odd, model).collect()
    assert len(strange) == odd.count() and all(0 <= r["score"] <= 1 for r in strange)
    assert quality.predict(odd, quality.fit(docs, labels.limit(0))).first()["score"] == 0.5 and quality.predict(docs.limit(0), model).count() == 0
    x, y = rng.normal(0, 1, (300, 3)), np.repeat([0, 1], 150)
    x[y == 1] *= 3
    m = quality.fit_arrays(x, y, 0, 1e-9)
    z = (x - x.mean(0)) / (x.std(0) + 1e-3)
    dens = []
    for k in (0, 1):
        c, mu = np.cov(z[y == k].T, bias=True), z[y == k].mean(0)
        d = z - mu
        dens.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1])
    assert np.allclose(m.score(x), 1 / (1 + np.exp(dens[0] - dens[1])), atol=1e-5)


def test_digest_of_spans(spark):
    s = spark.sql("select array(named_struct('kind', 1, 'start', 2, 'end', 9)) s").select(pii.digest(F.col("s"))).first()[0]
    assert s == "ip:2:9" and hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_crowded_regions_are_searched_deeper_and_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    common_part = [f"c{i}" for i in range(60)]
    texts = {}
    # many documents share a passage; few of them are near copies of each other, one of them of no neighbour
    for i in range(90):
        own = [f"o{i // 3}_{j}" for j in range(40)]
        if i % 3:
            own[int(rng.integers(40))] = f"x{i}"
        texts[i] = " ".join(common_part + own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    seen = []
    deeper, blocks = dedup.deeper, dedup._blocks
    monkeypatch.setattr(dedup, "deeper", lambda nodes, level: seen.append(level) or deeper(nodes, level))
    monkeypatch.setattr(dedup, "_blocks", lambda rows, signed: seen.append("blocks") or blocks(rows, signed))
    monkeypatch.setattr(dedup, "FIRST", 0)
    monkeypatch.setattr(dedup, "CROWD", 1)
    monkeypatch.setattr(dedup, "LIKELY", dedup.HASHES + 1)
    got = {r["doc"]: (r["n"], r["component"]) for r in dedup.near_duplicates(df).collect()}
    assert seen == [] and got == links(texts)
    monkeypatch.setattr(dedup, "WIDE", 1)
    got = {r["doc"]: (r["n"], r["component"]) for r in dedup.near_duplicates(df).collect()}
    assert seen == [0, 1, 2, "blocks"] and got == links(texts)


def test_long_words_are_summed_whole():
    table = langid.PieceTable.of(["▁", "a", "b", "ab", "▁a", "ba", "bab"])
    rng = np.random.default_rng(9)
    p = rng.uniform(0.01, 0.3, (8, 2))
    word = "".join(rng.choice(list("ab☃"), 200, p=[0.5, 0.45, 0.05]))
    text = "▁" + word
    rank = {x: i for i, x in enumerate(table.pieces)}

    def brute(cut=None):
        alpha = [np.zeros(2)] + [np.full(2, -np.inf) for _ in text]
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - 3), end):
                i = rank.get(text[start:end], 7 if end - start == 1 else None)
                if i is not None and not (cut and start < cut < end):
                    alpha[end] = np.logaddexp(alpha[end], alpha[start] + np.log(p[i]))
        return alpha[-1]

    assert np.allclose(langid.word_scores([word], table, p)[0], brute()) and np.allclose(langid.word_scores([word[:40]], table, p)[0], langid._Long("▁" + word[:40], table).forward(np.log(p))[-1])
    lattice = langid._Long(text, table)
    cover = np.zeros((len(text), 2))
    for s, e, x in zip(lattice.start, lattice.end, lattice.expected(np.log(p))):
        cover[s:e] += x
    assert np.allclose(cover, 1)


def test_language_model_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(10)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.5, int(rng.integers(1, 60))) % 500)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    learn = common.id_remainder(F.col("doc_id"), 10) != 0
    few, many = ({r["doc_id"]: r["score"] for r in lblm.score(df.repartition(n), learn).collect()} for n in (2, 13))
    assert all(few[i] == pytest.approx(many[i], rel=1e-6) for i in few)
