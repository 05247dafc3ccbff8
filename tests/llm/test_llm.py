"""Training-data operators against brute force, exact round trips and held-out accuracy."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.llm.logsketch import log_sketch, merge_sketches, percentiles
from strandline.llm.mixing import document_sizes, mix, mix_plan, mix_shares
from strandline.llm.packing import Pool, nnls, pack, plan_packing, strategies
from strandline.llm.residue import CHUNK, Training, encode, host_validation, score_residue, train, weak_label
from strandline.llm.runs import collapse_runs
from strandline.llm.sizes import byte_tokens


def brute_runs(rows):
    best = {}
    for e, i, s in rows:
        if e is not None and i is not None and s is not None:
            best[e, i] = max(s, best.get((e, i), s))
    out, prev = [], None
    for (e, i), s in sorted(best.items()):
        if prev and prev[0] == e and prev[3] + 1 == i and prev[1] == s:
            prev[3] = i
        else:
            prev = [e, s, i, i]
            out.append(prev)
    return sorted((e, s, a, b, b - a + 1) for e, s, a, b in out)


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_runs_against_brute_force(spark, block):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(60)]), rng.choice(["x", "x", "x", "y", None])) for _ in range(400)]
    seen = {}
    rows = [(e, i, seen.setdefault((e, i), s)) for e, i, s in rows]  # repeats agree
    df = spark.createDataFrame(rows, "e string, i long, s string").withColumn("start", F.lit("clash")).withColumn("n", F.create_map(F.lit(1), F.lit(2)))
    got = collapse_runs(df, ["e"], "i", "s", block=block).collect()
    assert sorted((r.e, r.s, r.start, r.end, r.n) for r in got) == brute_runs(rows)
    assert collapse_runs(df.limit(0), ["e"], "i", "s").count() == 0


def test_runs_carry_extras_across_blocks(spark):
    df = spark.createDataFrame([("a", i, "x" if i < 11 else "y", i * 10) for i in range(-3, 14) if i != 2] + [("a", 5, "x", 7)], "e string, i long, s string, v long")
    got = sorted((r.start, r.end, r.n, r.lo, r.hi, r.total) for r in collapse_runs(df, ["e"], "i", "s", {"lo": ("min", "v"), "hi": ("max", "v"), "total": ("sum", "v")}, block=3).collect())
    assert got == [(-3, 1, 5, -30, 10, -50), (3, 10, 8, 30, 100, 520), (11, 13, 3, 110, 130, 360)]


def test_repeats_that_disagree_take_the_largest_state(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 2, "y"), ("a", 3, None)], "e string, i long, s string")
    assert [(r.s, r.start, r.end) for r in collapse_runs(df, ["e"], "i", "s").collect()] == [("y", 1, 2)]


def test_percentiles_within_bound_and_mergeable(spark):
    rng = random.Random(6)
    vals = [rng.choice([0.0, -1.0, 1.0]) * math.exp(rng.uniform(-20, 20)) for _ in range(4000)] + [0.0] * 50
    rows = [(g, rng.randrange(3), v) for v in vals for g in ("a", None)] + [("a", 1, None), ("a", 1, float("nan")), ("a", 1, float("inf")), ("c", 1, None)]
    df = spark.createDataFrame(rows, "g string, day int, v double").withColumn("n", F.lit("clash"))
    qs, alpha = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0], 0.02
    parts = log_sketch(df.where("day < 2"), ["g", "day"], ["v"], alpha).unionByName(log_sketch(df.where("day >= 2"), ["g", "day"], ["v"], alpha))
    got = {(r.g, r.q): r for r in percentiles(parts, ["g"], qs, alpha).collect()}
    whole = merge_sketches(log_sketch(df, ["g"], ["v"], alpha), ["g"])
    assert sorted(map(str, whole.collect())) == sorted(map(str, merge_sketches(parts, ["g"]).select(*whole.columns).collect()))
    s = sorted(vals)
    for g in ("a", None):
        for q in qs:
            want = s[math.floor(q * (len(s) - 1))]
            assert abs(got[g, q].value - want) <= alpha * abs(want) * (1 + 1e-9)
            assert got[g, q].n == len(s)
    assert ("c", 0.5) not in got
    assert percentiles(log_sketch(df.limit(0), ["g"], ["v"]), ["g"], qs).count() == 0


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(0)
    for _ in range(5):
        a, b = rng.random((12, 20)), rng.random(12)
        x = nnls(a, b)
        grad = a.T @ (b - a @ x)
        assert (x >= 0).all() and (grad <= 1e-6).all() and np.abs(grad[x > 0]).max(initial=0) < 1e-6


def test_strategies_fill_the_window():
    s = strategies(12, 3)
    assert len(set(s)) == len(s) and all(sum(c) == 12 and len(c) <= 3 for c in s)
    assert len(s) == sum(1 for a in range(13) for b in range(a + 1) for c in range(b + 1) if a + b + c == 12)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.lists(st.tuples(st.integers(1, 300), st.integers(1, 40)), max_size=40))
def test_plan_places_every_item_once(capacity, items):
    hist = Counter()
    for n, c in items:
        if n <= capacity:
            hist[n] += c
    lengths, counts = np.array(sorted(hist), np.int64), np.array([hist[n] for n in sorted(hist)], np.int64)
    slots, n_containers = plan_packing(lengths, counts, capacity, classes=24)
    used, ranks = Counter(), {}
    for k, (n, first, base, q) in enumerate(slots.tolist()):
        last = slots[k + 1, 1] if k + 1 < len(slots) and slots[k + 1, 0] == n else hist[n]
        assert first == ranks.get(n, 0)
        for r in range(first, last):
            used[base + (r - first) // q] += n
        ranks[n] = last
    assert ranks == dict(hist)
    assert len(used) == n_containers and max(used.values(), default=0) <= capacity
    total = sum(n * c for n, c in hist.items())
    assert n_containers * capacity < 2 * total + capacity  # no two containers are half empty


def test_pack_documents(spark):
    rng = random.Random(7)
    texts = [(i, rng.choice([None, "", "é" * 10, "x" * rng.randint(1, 400), "y" * 5000])) for i in range(300)] + [(1, "dup"), (None, "z" * 50)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("container", F.lit("clash"))
    spec = spark.createDataFrame([("small", 128), ("large", 1000), (None, 5), ("none", None)], "pack_name string, capacity_tokens int")
    out = pack(docs.select("doc_id", "container", byte_tokens("text").alias("size")), spec, "doc_id", "size", salts=3).toPandas()
    sizes = sorted(len(t.encode()) + 1 for _, t in texts if t is not None)
    for name, cap in (("small", 128), ("large", 1000)):
        p = out[out.pack_name == name]
        assert sorted(p.groupby(["doc_id", "part", "first_token"], dropna=False).size()) is not None
        assert p.tokens.sum() == sum(sizes)
        assert p.groupby("container").tokens.sum().max() <= cap
        assert (p[p.n_parts > 1].doc_id.nunique()) == sum(1 for i, t in texts if t is not None and len(t.encode()) + 1 > cap)
        assert sum(sizes) / (p.container.nunique() * cap) > 0.8
    assert set(out.pack_name) == {"small", "large"}
    assert pack(docs.limit(0).select("doc_id", byte_tokens("text").alias("size")), spec, "doc_id", "size").count() == 0
    assert pack(docs.select("doc_id", byte_tokens("text").alias("size")), spec.limit(0), "doc_id", "size").count() == 0


def test_one_length_for_a_third_of_all(spark):
    docs = spark.createDataFrame([(i, 10 if i % 3 == 0 else 11 + i % 50) for i in range(3000)], "id long, size long")
    out = pack(docs, spark.createDataFrame([("p", 64)], "pack_name string, capacity_tokens int"), "id", "size").toPandas()
    assert len(out) == 3000 and out.id.is_unique and out.groupby("container").tokens.sum().max() <= 64
    rooms = []  # plain best fit, longest first
    for n in sorted(out.tokens, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(64 - n)
    assert out.container.nunique() <= len(rooms) * 1.02


def test_mix_shares_and_caps(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["A ", "a", "b-c", "B_C", "d", None]), "x" * rng.randint(0, 60)) for i in range(3000)] + [(9000, "small", "y" * 500), (9001, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("tokens", F.lit("clash"))
    targets = spark.createDataFrame([("m", "a", 0.5, 2), ("m", "b_c", 0.3, 1), ("m", "d", 0.2, 3), ("k", "small", 0.5, 4), ("k", "a", 0.5, 1), ("z", "nowhere", 1.0, 1), (None, "a", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    sizes = document_sizes(docs, "doc_id", byte_tokens("text"), "source")
    for c in (False, True):
        out = mix(sizes, targets, seed=3, calibrated=c)
        assert sorted(map(str, out.collect())) == sorted(map(str, mix(sizes.repartition(7), targets, seed=3, calibrated=c).collect()))
    caps = {(m, s): c for m, s, _, c, *_ in mix_plan(sizes, targets)}
    for r in out.groupBy("mix_name", "source", "doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("top")).collect():
        assert r.n == r.top <= caps[r.mix_name, r.source]
    for r in mix_shares(out, sizes, targets).collect():
        if r.mix_name in ("m", "k"):
            assert abs(r.actual_share - r.target_share) < 0.03
        else:
            assert r.n_docs == 0
    assert out.where("mix_name = 'k' and source = 'small'").count() == 4
    over = mix_shares(mix(sizes, targets, total_tokens=1e9), sizes, targets, 1e9).where("mix_name = 'm'").collect()
    assert all(r.rate == caps["m", r.source] for r in over)
    assert mix(sizes.limit(0), targets).count() == 0 and mix(sizes, targets.limit(0)).count() == 0


TEXTS = {
    1: ["Please enable JavaScript to view this page.", "Sample: {{sample_name}}", "404 Not Found", "TODO: describe the site here.", "Lorem ipsum dolus venit magem.", "Contact: [INSERT CONTACT]", "asdf asdf asdf asdf asdf asdf", "Depth: NaN.", "Request id 5fa09c"],
    0: ["The depth fell from 4.2 to 3.1 after masking.", "We found 404 tracts on chromosome 3.", "Notes on the burial mound", "", "Home | Tracts | Log in", "Write the pair as {AFR, NEA}."],
    -1: ['A colleague asked why the page said "Please enable JavaScript"; the cause was a blocked viewer.', "The template has a slot {{name}} that the writer fills, as explained in the manual."],
}


@pytest.mark.parametrize("label,text", [(k, t) for k, v in TEXTS.items() for t in v])
def test_weak_labels(label, text):
    assert weak_label(text) == label


def corpus(n=600, seed=0):
    rng = random.Random(seed)
    words = "the bin depth tract sample panel site map shows falls keeps after before near chromosome stable low read count library".split()
    rows = []
    for i in range(n):
        body = [" ".join(rng.choices(words, k=rng.randint(5, 14))).capitalize() + "." for _ in range(rng.randint(1, 8))]
        bad = i % 7 == 0
        if bad:
            body.insert(rng.randrange(len(body) + 1), rng.choice(TEXTS[1][:6]))
        elif i % 11 == 0:
            body.append(rng.choice(TEXTS[-1]))
        rows.append((i, f"host{i % 9}", "\n".join(body), bad))
    return rows


def test_residue_end_to_end(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, bad boolean").withColumn("score", F.lit("clash"))
    model = train(docs, cfg=Training(rounds=30))
    extra = [(-1, None), (-2, ""), (-3, " \n "), (-4, "The depth falls near the site. " * 40000 + "Please enable JavaScript to view this page."), (None, "404 Not Found"), (-5, "Venculis offiemem")]
    more = spark.createDataFrame(extra, "doc_id long, text string")
    got = {r.doc_id: r for r in score_residue(docs.select("doc_id", "text").unionByName(more), model).collect()}
    assert len(extra[3][1]) > 2 * CHUNK
    truth = {i: b for i, _, _, b in rows}
    assert sum(got[i].is_residue == b for i, b in truth.items()) / len(truth) > 0.98
    assert got[-1].score is None and not got[-1].is_residue and not got[-2].is_residue and not got[-3].is_residue
    assert got[-4].is_residue and got[None].is_residue
    assert score_residue(docs.limit(0), model).count() == 0
    assert score_residue(docs, train(docs.limit(0))).where("is_residue").count() == 0


def test_large_capacities_are_packed_and_bad_ones_an_error(spark):
    sizes = [10, 4_999_999, 5_000_000, 5_000_001, 12_000_000, *[1_250_000] * 9, *[3] * 50]
    docs = spark.createDataFrame(list(enumerate(sizes)), "id long, size long")
    spec = lambda *x: spark.createDataFrame(list(x), "pack_name string, capacity_tokens long")
    out = pack(docs, spec(("p", 5_000_000), ("q", 100), ("r", 3_000_000_000)), "id", "size").toPandas()
    for name, cap in (("p", 5_000_000), ("q", 100), ("r", 3_000_000_000)):
        own = out[out.pack_name == name]
        assert own.groupby("id").tokens.sum().tolist() == sizes
        assert own.groupby("container").tokens.sum().max() <= cap
        assert (own.n_parts == [-(-sizes[i] // cap) for i in own.id]).all()
    assert out[out.pack_name == "p"].container.nunique() <= 9 and out[out.pack_name == "r"].container.nunique() == 1
    for bad in ((("p", 0),), (("p", 64), ("p", 65))):
        with pytest.raises(ValueError):
            pack(docs, spec(*bad), "id", "size")


def test_plan_is_no_worse_than_best_fit():
    rng = np.random.default_rng(2)
    for _ in range(4):
        lengths, counts = np.unique(np.minimum(rng.lognormal(6, 1, 3000).astype(int) + 1, 2048), return_counts=True)
        pool = Pool(2048)
        for n, c in zip(lengths[::-1].tolist(), counts[::-1].tolist()):
            pool.place(n, c)
        assert plan_packing(lengths, counts, 2048)[1] <= pool.containers()


def test_bound_holds_for_tiny_and_huge_values_and_null_groups(spark):
    vals = [1e-13, 1e-13, 1e-13, -1e-300, 3e-310, 5e-324, 1.7e308, -1.7976931348623157e308, 0.0]
    df = spark.createDataFrame([(None, v) for v in vals] + [("a", 1e-13)], "g string, v double")
    for r in percentiles(log_sketch(df, ["g"], ["v"]), ["g"], [i / 8 for i in range(9)]).collect():
        own = sorted(vals) if r.g is None else [1e-13]
        want = own[math.floor(r.q * (len(own) - 1))]
        assert abs(r.value - want) <= 0.01 * abs(want) * (1 + 1e-9) and (r.value == 0) == (want == 0), (r, want)
    with pytest.raises(ValueError):
        log_sketch(df, ["g"], ["v"], 0.0)


def test_bernoulli_copies(spark):
    docs = spark.createDataFrame([(i, s, "x" * (i % 50)) for s in "ab" for i in range(s == "b", 4000 * (1 + (s == "b")), 1)], "doc_id long, source string, text string")
    sizes = document_sizes(docs.select((F.col("doc_id") * 2 + F.when(F.col("source") == "b", 1).otherwise(0)).alias("doc_id"), "source", "text"), "doc_id", byte_tokens("text"), "source")
    targets = spark.createDataFrame([("m", "a", 0.6, 2), ("m", "b", 0.4, 2)], "mix_name string, source string, target_share double, max_repeats int")
    rates = {s: r for _, s, *_, r in mix_plan(sizes, targets)}
    for r in mix(sizes, targets).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d"), F.max("copy").alias("top")).collect():
        total = 4000 if r.source == "a" else 7999
        assert abs(r.n / total - rates[r.source]) < 4 * (0.25 / total) ** 0.5 and r.top <= math.ceil(rates[r.source])
    twice = targets.unionByName(spark.createDataFrame([("m", " A", 0.1, 1)], targets.schema))
    with pytest.raises(ValueError):
        mix(sizes, twice)


def test_residue_on_unseen_hosts(spark):
    docs = spark.createDataFrame(corpus(400, 1), "doc_id long, source string, text string, bad boolean")
    for r in host_validation(docs, folds=2, cfg=Training(rounds=20)).collect():
        assert r.recall > 0.9 and r.precision > 0.9


def test_unseen_hosts_are_whole_hosts_under_the_rule_in_use(spark, monkeypatch):
    from strandline.llm import residue
    from strandline.llm.queries import QUERIES

    assert "p8_unseen_hosts" in QUERIES
    names = [(f"site-{i}", f" SITE_{i}") for i in range(12)]
    docs = spark.createDataFrame([(i, n, 'It said "404 Not Found" again.') for i, pair in enumerate(names) for n in pair], "doc_id long, source string, text string")
    trained = []
    weights = np.zeros((len(residue.GRAMS) << residue.BITS) + residue.EXTRA, np.float32)

    def train(d, *_):
        trained.append({canon for (canon,) in d.select(F.translate(F.lower(F.trim("source")), "-", "_")).distinct().collect()})
        return residue.Model(weights, 1.0)

    monkeypatch.setattr(residue, "train", train)
    got = host_validation(docs, folds=3).collect()
    assert sum(r.n for r in got) == len(docs.collect())
    # every text scores above the threshold but only mentions an error
    assert all(r.found == 0 and r.precision is None and r.recall is None for r in got)
    assert all(r.n == 2 * (len(names) - len(t)) for r, t in zip(got, trained))


def test_long_and_short_segments_are_scored_whole():
    from strandline.llm import residue

    # the model knows one notice, by its n-grams of 10 bytes
    notice = "please enable javascript"
    w = np.zeros((len(residue.GRAMS) << residue.BITS) + residue.EXTRA, np.float32)
    code = np.frombuffer(notice.encode(), np.uint8)
    at, h, ok = list(residue.gram_index(code, np.array([0])))[2]
    w[at + h[ok]] = 1.0
    four = np.frombuffer(b"TBD\n", np.uint8)
    at, h, ok = next(residue.gram_index(four, np.array([0])))
    w[at + h[ok]] = 9.0
    m = residue.Model(w, -3.0)
    whole = m.score_texts([notice])[0]
    for k in range(440, 560):
        long = ("depth falls near the site " * 30)[:k] + " " + notice + " " + "and so on " * 90
        assert m.score_texts([long])[0] >= whole - 1e-6, k
    b = residue.encode("ab1 " * 700)
    assert residue.spread(b, b) == residue.spread(b) and np.diff(np.r_[residue.cut(np.frombuffer(residue.spread(b), np.uint8)), len(residue.spread(b))]).max() <= residue.MAX_SEGMENT + 1
    assert m.score_texts(["The depth falls.\nTBD\n"])[0] > 0
    assert np.isneginf(m.score_texts([" \n \n"])[0])
    slot = [y for *_, y in residue.labelled_segments([("", "word " * 300 + "{{ name }} " + "word " * 10)])]
    assert 1 in slot and not residue.is_mention_only("word " * 300 + notice, m)


def test_examples_come_from_the_patterns():
    from strandline.llm import residue

    s = residue.seeds(["The depth of the sample fell after masking."])
    assert (s["kind"] == 1).sum() > 500 and (s["kind"] == 2).sum() > 200 and s["segment"].is_unique
    for kind, patterns in residue.ALL.items():
        for p, tree, anchor in zip(patterns, residue._PARSED[kind], (residue.anchors(t) for t in residue._PARSED[kind])):
            assert anchor, p
            made = [residue.example(tree, random.Random(i)) for i in range(40)]
            hits = [x for x in made if re.search(p, x, re.I if kind != "slot" else 0)]
            assert hits and all(any(a in x.lower() for a in anchor) for x in hits), p


def test_model_knows_residue_before_it_sees_any(spark):
    rows = [(i, "h", t, b) for i, (_, _, t, b) in enumerate(corpus(300, 2)) if not b]
    m = train(spark.createDataFrame(rows, "doc_id long, source string, text string, bad boolean"), cfg=Training(rounds=40))
    bad = ["Please enable JavaScript to view this page.", "404 Not Found", "Lorem ipsum dolor sit amet.", "The depth of {{sample_name}} fell near the site.", "Bitte aktivieren Sie JavaScript.", "Name: [your name]"]
    good = ["The depth falls near the site.", "Panel keeps low count.", "Home | Contact | Date"]
    assert (m.score_texts(bad) > 0).mean() > 0.8 and (m.score_texts(good) < 0).all()


def test_encoding_folds_digits_and_spaces():
    assert encode("a\xa01\r9é") == "a 0\n0é".encode()
