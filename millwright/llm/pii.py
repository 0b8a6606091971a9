"""Personal data by weak supervision, in DataFrame expressions only.

Candidates come from patterns on the whole text. Labelers vote on each: the
strict pattern, gazetteers (public top-level domains, calling codes, card
prefixes, reserved networks), and words of the context before and after.
Expectation-maximisation over the table of vote patterns estimates how reliable
each labeler is and how likely a candidate is to be personal data; the
posteriors then train a final classifier of spans on features of their form,
which scores every candidate. Spans of the strict patterns are always kept; the
others are added if the classifier accepts them and they overlap no kept span
of the same kind.

EM runs as a fold inside one row: the vote table has at most 3 ** labelers
patterns for each kind, whatever the input. Nothing is collected.

A null or empty text has no spans. Repeated rows get equal results and count
once for each copy in the estimates. An empty table gives an empty result.
Very long texts are matched whole; the patterns are possessive and anchored at
the start of a run, so they take time in proportion to the text. Only the
columns asked for are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.llm import common

KINDS = ("email", "ip", "card", "phone")
#: Strict patterns. Leftmost matches start where a run of their first characters starts or the last match ended.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a run of digits is as long as it can be; those of 9 to 19 digits matter
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){8,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns for candidates that the strict ones miss.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\x20?\[\.\]\x20?[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}+(?:[.\x20/-][0-9]{4}+){3}(?![0-9])",
    "phone": r"(?<![0-9+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])",
}
#: A text without this character has no strict match, which is cheaper to see.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Matches that are placed one by one; longer lists are put together from parts of this size.
PART = 256
WIDE_NEEDS = {"email": r"[\[(](?:at|AT)[\])]", "ip": r"\[\.\]", "card": r"[0-9]{4}[.\x20/-][0-9]{4}", "phone": r"[0-9]{3}[-.\x20)]"}

#: Words that announce a kind, and words that announce something else.
CONTEXT = {
    "email": "mail|e-mail|email|contact|write|correo|courriel",
    "ip": "ip|host|server|address|adresse|login|client",
    "card": "card|visa|mastercard|amex|credit|tarjeta|carte|karte|pay",
    "phone": "phone|tel|call|mobile|cell|fax|telefon|teléfono|téléphone",
}
AGAINST = {"email": "example|noreply|token", "ip": "version|release|section|chapter", "card": "token|isbn|order|invoice|hash|id|sku", "phone": "token|isbn|order|version|id"}
#: Top-level domains, first digits of card numbers with their usual length, calling codes, reserved networks.
DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|mil|int|info|biz|name|pro|app|dev|xyz|online|site|shop|cloud|tech|store|mail|[a-z]{2})$"
CARDS = r"^(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})$"
CODES = r"^\+[\x20(]*(?:1|7|2(?:[07]|[1-6][0-9]|9[0-9])|3(?:[0-4679]|[58][0-9])|4(?:[013-9]|2[0-9])|5(?:[1-8]|[09][0-9])|6(?:[0-6]|[7-9][0-9])|8(?:[1246]|[058][0-9])|9(?:[0-58]|[679][0-9]))"
RESERVED = r"^(?:0|10|127|169\.254|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168|2(?:2[4-9]|[345][0-9]))\."

LABELERS = ("strict", "gazetteer", "before", "after", "shape")
ROUNDS = 15
ACCEPT = 0.5
NEAR = 24


_PLACES = "array<struct<start:int,end:int,value:string>>"


def _spans(text: Column, pattern: str, needed: Column) -> Column:
    """array<struct<start, end, value>> of the pattern's matches, in code points.

    The parts between the matches and the matches themselves come from one
    scanner each, so their lengths add up to positions. They are added up in
    parts, so that no long array grows by one element at a time.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    between = F.split(text, pattern, -1)
    none = F.array().cast(_PLACES)

    def step(s, m):
        start = s["at"] + m["between"]
        return F.struct((start + F.length(m["value"])).alias("at"), F.array_append(s["out"], F.struct(start.alias("start"), (start + F.length(m["value"])).alias("end"), m["value"].alias("value"))).alias("out"))

    def part(s, ms):
        # the one-element array has the inner fold evaluated once
        return F.transform(F.array(F.aggregate(ms, F.struct(s["at"].alias("at"), none.alias("out")), step)), lambda e: F.struct(e["at"].alias("at"), F.concat(s["out"], e["out"]).alias("out")))[0]

    pairs = F.zip_with(found, F.slice(F.transform(between, F.length), F.lit(1), F.size(found)), lambda v, b: F.struct(b.alias("between"), v.alias("value")))
    parts = F.transform(F.array(pairs), lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / PART).cast("int")), lambda i: F.slice(p, i * PART + 1, PART)))[0]
    return F.when(needed & (F.size(found) > 0), F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), part)["out"]).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, d: s + d) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.length(_digits(value))
    return n.between(9, 15) if kind == "phone" else n.between(13, 19) & luhn(_digits(value))


def candidates(docs: DataFrame, *, keep: list[str], text_col="text") -> DataFrame:
    """The ``keep`` columns as the struct ``_pii_row`` and ``_pii_spans``: candidates with their votes and features.

    The contexts are read from the text next to each span.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.struct(*keep or [F.lit(0).alias("none")]).alias("_pii_row"), text.alias("_pii_text"))
    for kind in KINDS:
        base = base.withColumn(f"_pii_{kind}", _spans(F.col("_pii_text"), STRICT[kind], F.contains("_pii_text", F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)))
    for kind in KINDS:
        base = base.withColumn(f"_pii_wide_{kind}", _spans(F.col("_pii_text"), WIDE[kind], F.col("_pii_text").rlike(WIDE_NEEDS[kind])))
    for kind in KINDS:
        base = base.withColumn(f"_pii_good_{kind}", F.filter(f"_pii_{kind}", lambda s: _valid(kind, s["value"])))
        # a strict match that fails its check stays a candidate, if it could be a span at all
        base = base.withColumn(f"_pii_failed_{kind}", F.filter(f"_pii_{kind}", lambda s: ~_valid(kind, s["value"]) & F.length(_digits(s["value"])).between(9, 19)))
    columns = []
    for kind in KINDS:
        good, failed = F.col(f"_pii_good_{kind}"), F.col(f"_pii_failed_{kind}")
        known = lambda s, strict: _known(kind, s, F.lit(strict))
        # one place is one candidate, whichever patterns match it; a failed strict match hides no narrower one inside it
        overlaps = lambda w: F.exists(good, lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"]))
        same = lambda w: F.exists(failed, lambda s: (s["start"] == w["start"]) & (s["end"] == w["end"]))
        wide = F.filter(f"_pii_wide_{kind}", lambda w: ~overlaps(w) & ~same(w))
        columns.append(F.concat(F.transform(good, lambda s: known(s, True)), F.transform(F.concat(failed, wide), lambda s: known(s, False))))
    return base.select("_pii_row", F.concat(*columns).alias("_pii_spans"))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0).cast("int")


def _known(kind: str, s: Column, strict: Column) -> Column:
    value, digits = s["value"], _digits(s["value"])
    text = F.col("_pii_text")
    before = F.lower(F.substring(text, F.greatest(F.lit(1), s["start"] + 1 - NEAR), F.least(F.lit(NEAR), s["start"])))
    after = F.lower(F.substring(text, s["end"] + 1, F.lit(NEAR)))
    listed = {
        "email": _vote(value.rlike(DOMAINS), ~value.rlike(r"[A-Za-z]{2,}$")),
        "ip": _vote(~value.rlike(RESERVED), value.rlike(RESERVED)),
        "card": _vote(digits.rlike(CARDS), ~digits.rlike("^[2-6]")),
        "phone": _vote(value.rlike(CODES), value.startswith("+") & ~value.rlike(CODES)),
    }[kind]
    shape = {
        "email": _vote(value.rlike(r"^[A-Za-z0-9][^@]{1,63}"), F.length(value) > 100),
        "ip": _vote(F.length(value) >= 9, value.rlike(r"^[0-9]\.[0-9]\.[0-9]\.[0-9]$")),
        "card": _vote(F.length(digits).isin(15, 16), F.length(digits) < 15),
        "phone": _vote(F.length(digits).between(10, 12), F.length(digits) > 13),
    }[kind]
    near = lambda words: rf"(?:^|[^\pL])(?:{words})(?:[^\pL]|$)"
    votes = F.array(
        _vote(strict, ~strict),
        listed,
        _vote(before.rlike(near(CONTEXT[kind])), before.rlike(near(AGAINST[kind]))),
        _vote(after.rlike(near(CONTEXT[kind])), after.rlike(near(AGAINST[kind]))),
        shape,
    )
    features = F.array(
        F.least(F.length(value), F.lit(40)) / F.lit(4),
        F.least(F.length(digits), F.lit(20)),
        F.least(F.length(F.regexp_replace(value, "[A-Za-z0-9]", "")), F.lit(20)),
        F.when(before.rlike(r"[\pL\pN]$"), 1).otherwise(0),
        F.when(after.rlike(r"^[\pL\pN]"), 1).otherwise(0),
        F.when(value.rlike("^[+(]"), 1).otherwise(0),
    )
    return F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), strict.alias("strict"), votes.alias("votes"), F.transform(features, lambda f: f.cast("int")).alias("features"))


def estimate(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, votes, posterior): EM over the counts of vote patterns, folded inside one row per kind.

    The state holds, for either class, a share and each labeler's probability
    of voting -1, 0 and 1. The start trusts the majority of the votes.
    """
    k = len(LABELERS)
    table = found.select(F.inline("_pii_spans")).groupBy("kind", "votes").agg(F.count("*").cast("double").alias("n"))
    rows = table.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("rows"))
    first = F.transform("rows", lambda r: 1 / (1 + F.exp(-1.5 * F.aggregate(r["votes"], F.lit(0), lambda a, v: a + v))))

    def maximise(posterior):
        weighted = F.zip_with(F.col("rows"), posterior, lambda r, p: F.struct(r["votes"].alias("votes"), (r["n"] * p).alias("yes"), (r["n"] * (1 - p)).alias("no")))
        sums = lambda pick: F.aggregate(weighted, F.lit(0.0), lambda a, w: a + pick(w))
        votes = F.array(*(F.array(*(F.struct(sums(lambda w: F.when(w["votes"][j] == v, w["yes"]).otherwise(0.0)).alias("yes"), sums(lambda w: F.when(w["votes"][j] == v, w["no"]).otherwise(0.0)).alias("no")) for v in (-1, 0, 1))) for j in range(k)))
        return F.struct(sums(lambda w: w["yes"]).alias("yes"), sums(lambda w: w["no"]).alias("no"), votes.alias("votes"))

    def expect(m):
        odds = lambda r: F.log((m["yes"] + 1) / (m["no"] + 1)) + F.aggregate(
            F.zip_with(m["votes"], r["votes"], lambda c, v: F.log(((c[v + 1]["yes"] + 0.5) / (m["yes"] + 1.5)) / ((c[v + 1]["no"] + 0.5) / (m["no"] + 1.5)))), F.lit(0.0), lambda a, x: a + x
        )
        return F.transform("rows", lambda r: 1 / (1 + F.exp(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), -odds(r))))))

    step = lambda p, _: F.transform(F.array(maximise(p)), expect)[0]
    fitted = rows.select("kind", "rows", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, step).alias("posterior"))
    return fitted.select("kind", F.inline(F.zip_with("rows", "posterior", lambda r, p: F.struct(r["votes"].alias("votes"), p.alias("posterior")))))


def classifier(found: DataFrame, posteriors: DataFrame) -> DataFrame:
    """(kind, prior, weights): a naive-Bayes classifier of span forms, trained on the posteriors as soft labels.

    ``weights`` maps "feature:value" to a log-ratio; its size is the number of
    distinct feature values, which the features bound.
    """
    spans = found.select(F.inline("_pii_spans")).groupBy("kind", "votes", "features").agg(F.count("*").cast("double").alias("n"))
    soft = spans.join(posteriors, ["kind", "votes"]).withColumn("yes", F.col("n") * F.col("posterior")).withColumn("no", F.col("n") * (1 - F.col("posterior")))
    total = soft.groupBy("kind").agg(F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"))
    seen = soft.select("kind", "yes", "no", F.posexplode("features").alias("feature", "value")).groupBy("kind", "feature", "value").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    weight = F.log(((F.col("yes") + 0.5) / (F.col("all_yes") + 5)) / ((F.col("no") + 0.5) / (F.col("all_no") + 5)))
    return (
        seen.join(total, "kind")
        .groupBy("kind", F.log((F.col("all_yes") + 1) / (F.col("all_no") + 1)).alias("prior"))
        .agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "feature", "value"), weight))).alias("weights"))
    )


_SPAN = "array<struct<kind:int,start:int,end:int,strict:boolean,score:double>>"


def fit(found: DataFrame) -> DataFrame:
    """The span classifier as one row: a map from each kind to its prior and weights. ``found`` is read twice."""
    forms = classifier(found, common.checkpoint(estimate(found)))
    one = forms.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("kind", F.struct("prior", "weights")))).alias("_pii_model"))
    return common.checkpoint(one)


def decide(found: DataFrame, model: DataFrame, accept=ACCEPT) -> DataFrame:
    """``found`` with ``_pii_taken``: array<struct<kind, start, end, strict, score>> in order of kind and start."""

    def score(s):
        of = F.try_element_at("_pii_model", s["kind"])
        terms = F.transform(s["features"], lambda f, i: F.coalesce(F.try_element_at(of["weights"], F.concat_ws(":", i, f)), F.lit(0.0)))
        return 1 / (1 + F.exp(-F.aggregate(terms, F.coalesce(of["prior"], F.lit(0.0)), lambda a, t: a + t)))

    scored = F.transform("_pii_spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["strict"].alias("strict"), score(s).alias("score")))
    strict = F.filter("_pii_scored", lambda s: s["strict"])
    more = F.array_sort(F.filter("_pii_scored", lambda s: ~s["strict"] & (s["score"] >= accept)))
    clear = lambda t, of: ~F.exists(of, lambda o: (o["kind"] == t["kind"]) & (o["start"] < t["end"]) & (t["start"] < o["end"]))
    # of added spans that overlap, the first in order of start stays
    free = F.filter(more, lambda s: clear(s, strict))
    added = F.aggregate(free, F.array().cast(_SPAN), lambda out, s: F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["kind"] == s["kind"]) & (F.try_element_at(out, F.lit(-1))["end"] > s["start"]), out).otherwise(F.array_append(out, s)))
    joined = found.join(F.broadcast(model), F.lit(True), "left")  # the model is one row
    return joined.withColumn("_pii_scored", scored).withColumn("_pii_taken", F.array_sort(F.concat(strict, added))).drop("_pii_scored", "_pii_spans", "_pii_model")


def detect(docs: DataFrame, *, keep: list[str], text_col="text", accept=ACCEPT) -> DataFrame:
    """The ``keep`` columns and ``spans``: array<struct<kind, start, end, strict, score>> in order of kind and start."""
    found = common.checkpoint(candidates(docs, keep=keep, text_col=text_col))
    return decide(found, fit(found), accept).select("_pii_row.*", F.col("_pii_taken").alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, *, text_col="text", accept=ACCEPT) -> DataFrame:
    """All columns of ``docs``, each span's text replaced by its kind in brackets; a null text stays null.

    The rows are written once with what was found in them, so that each text is
    matched once and none is shuffled.
    """
    found = common.checkpoint(candidates(docs, keep=docs.columns, text_col=text_col))
    found = decide(found, fit(found.select("_pii_spans")), accept)
    names, text = F.array(*map(F.lit, KINDS)), F.coalesce(F.col(f"_pii_row.{text_col}").cast("string"), F.lit(""))
    spans = F.array_sort(F.transform("_pii_taken", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda a, s: F.when(
        s["start"] >= a["at"],
        F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("["), F.element_at(names, s["kind"] + 1), F.lit("]")))).alias("out")),
    ).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))
    cut = F.transform(F.array(F.aggregate(spans, start, step)), lambda e: F.concat(F.array_join(e["out"], ""), F.substring(text, e["at"] + 1, F.length(text))))[0]
    new = F.when(F.size("_pii_taken") > 0, cut).otherwise(F.col(f"_pii_row.{text_col}"))
    return found.select(*(new.alias(c) if c == text_col else F.col(f"_pii_row.{c}").alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    found = detect(common.read(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    strict = F.filter("spans", lambda s: s["strict"])
    count = lambda k: F.size(F.filter(strict, lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)), F.sha2(digest(strict), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
