"""Properties of operators against plain loops."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.operators import dedup, quality, sampling, sequence
from corpusforge.operators.components import connected_components
from corpusforge.runtime import parted, scratch, small, table


def test_components_are_the_transitive_closure(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "i long, j long"), "i", "j").collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert connected_components(spark.createDataFrame([], "i long, j long"), "i", "j").count() == 0


@pytest.mark.parametrize("rest", [0, 20, 1000])
def test_first_wins_is_the_loop_in_order(spark, rest):
    r = random.Random(7)
    edges = {tuple(sorted(r.sample(range(80), 2))) for _ in range(120)} | {(i, i + 1) for i in range(100, 109)}
    accepted = []
    for x in range(110):
        if not any((a, x) in edges for a in accepted):
            accepted.append(x)
    got = dedup.accept_first(spark.range(110), spark.createDataFrame(sorted(edges), "i long, j long"), rest).filter("accepted").collect()
    assert sorted(x["id"] for x in got) == accepted
    assert dedup.accept_first(spark.range(3), spark.createDataFrame([], "i long, j long")).filter("accepted").count() == 3


def test_first_wins_of_a_long_chain(spark):
    edges = spark.range(5000).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    got = dedup.accept_first(spark.range(5001), edges).filter("accepted")
    assert sorted(x["id"] for x in got.collect()) == list(range(0, 5001, 2))


def test_first_wins_leaves_one_row_a_key(spark):
    rows = [(1, "a", "x"), (0, "a", "y"), (0, "b", None), (2, None, "z"), (1, None, "w"), (0, "a", "y")]
    got = dedup.first_wins(spark.createDataFrame(rows, "n long, k string, v string"), F.col("k"), "n").collect()
    assert sorted(tuple(x) for x in got if x["k"]) == [(0, "a", "y"), (0, "b", None)] and [x["v"] for x in got if x["k"] is None] == ["w"]


def test_positions(spark):
    df = spark.range(300).select(((F.col("id") * 37) % 101).alias("a"), "id").repartition(7)
    got = [(x["a"], x["id"]) for x in sampling.numbered(df, "a", "id").orderBy("position").collect()]
    assert got == sorted(got) and len(got) == 300
    assert [x["position"] for x in sampling.numbered(df, "a", "id").orderBy("position").collect()] == list(range(300))
    assert sampling.numbered(df.limit(0), "a", "id").count() == 0


def test_rows_parted_by_a_bit_map(spark):
    keys = table(spark.range(0, 3000, 3).select(F.xxhash64("id").alias("h")), "keys")
    maybe, no = parted(spark.range(3000), F.xxhash64("id"), keys)
    held = {x["id"] for x in maybe.collect()}
    assert held >= set(range(0, 3000, 3)) and len(held) < 1300 and held | {x["id"] for x in no.collect()} == set(range(3000)) and maybe.columns == no.columns == ["id"]
    assert parted(spark.range(5), F.col("id"), keys.limit(0))[1].count() == 5


def test_tables_of_a_scope_are_removed(spark, tmp_path):
    with scratch(spark):
        inside = table(spark.range(3), "inside")
        folder = inside.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
        assert os.path.isdir(folder)
    assert not os.path.exists(folder)


def test_broadcasts_are_bounded_in_bytes(spark):
    hinted = lambda df, **k: "broadcast" in small(df, **k)._jdf.queryExecution().logical().toString().lower()
    rows = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("t"), F.array(F.lit("y")).alias("a"))
    assert hinted(rows) and not hinted(rows, size=50_000) and not hinted(rows, rows=99)


def test_set_similarity_is_all_pairs(spark):
    r = random.Random(3)
    sets = {i: sorted({str(r.randrange(30)) for _ in range(r.randrange(1, 15))}) for i in range(120)}
    classes = spark.createDataFrame([(k, v) for k, v in sets.items()], "class_id long, tokens array<string>")
    for measure, bottom in (("jaccard", lambda a, b: len(a | b)), ("containment", lambda a, b: min(len(a), len(b)))):
        for t in (0.5, 0.8):
            want = {(i, j) for i in sets for j in sets if i < j and len(set(sets[i]) & set(sets[j])) / bottom(set(sets[i]), set(sets[j])) >= t}
            assert {(x["i"], x["j"]) for x in dedup.set_similarity_pairs(classes, t, measure).collect()} == want


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 7)
    for f in (lambda d: sampling.sample_n(d, 50, "id"), lambda d: sampling.balanced(d, 50, "g", "id"), lambda d: sampling.hard_biased(d, 50, "id", "id")):
        one, other = ({x["id"] for x in f(d).collect()} for d in (df, df.repartition(13)))
        assert one == other and len(one) == 50
    assert sampling.sample_n(df, 900, "id").count() == 500
    assert sampling.sample_n(df, 0, "id").count() == 0


def packs_in_order(sizes, limit):
    packs, used, number = [], 0, -1
    for n in sizes:
        if number < 0 or used + n > limit:
            number, used = number + 1, 0
        used += n
        packs.append(number)
    return packs


@pytest.mark.parametrize("shard_rows", [1, 3, 7, 1000])
def test_packs(spark, shard_rows):
    r = random.Random(shard_rows)
    sizes = [5, 5, 3, 20, 1, 1, 9, 10, 30, 2] + [r.choice((1, 2, 3, 9, 10, 11, 40)) for _ in range(60)]
    df = spark.createDataFrame([(i * 3, n) for i, n in enumerate(sizes)] + [(1, 0), (7, None)], "id long, n long")
    got = sequence.pack(df, "id", "n", 10, shard_rows).orderBy("ord").collect()
    assert [(x["ord"], x["n"], x["pack"]) for x in got] == [(i * 3, n, p) for i, (n, p) in enumerate(zip(sizes, packs_in_order(sizes, 10), strict=True))]
    assert sequence.pack(df.limit(0), "id", "n", 10).count() == 0
    texts = spark.createDataFrame([(i * 3, f"<{i}>") for i in range(len(sizes))], "id long, t string")
    joined = {x["pack"]: x["text"] for x in sequence.packed_texts(sequence.pack(df, "id", "n", 10, shard_rows), texts, "id", "t").collect()}
    assert joined == {p: "".join(f"<{i}>" for i, q in enumerate(packs_in_order(sizes, 10)) if q == p) for p in range(max(joined) + 1)}


def test_loss_mask_includes_the_marker(spark):
    df = spark.createDataFrame([([1, 2, 7, 3, 4, 8, 9, 1, 2, 6, 3, 4, 5],), ([],)], "ids array<int>")
    got = [list(x["labels"]) for x in df.select(sequence.loss_mask(F.col("ids"), [3, 4], [1, 2], 12).alias("m")).select("m.labels").collect()]
    assert got == [[-100, -100, -100, 3, 4, 8, 9, -100, -100, -100, 3, 4], []]


def test_turn_issues(spark):
    turns = {1: "user assistant", 2: "assistant user", 3: "system", 4: "user user assistant assistant", 5: "system human gpt"}
    rows = [(c, i, r) for c, line in turns.items() for i, r in enumerate(line.split())]
    got = dict(quality.turn_issues(spark.createDataFrame(rows, "c long, n long, role string"), "c", "n", "role").collect())
    assert got == {1: "valid", 2: "starts_with_assistant", 3: "empty", 4: "consecutive_user", 5: "valid"}


def test_first_wins_near_dedup_rejects_contained_texts(spark, tmp_path):
    from corpusforge.plans.catalogue import QUERIES

    long = " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60))
    texts = [long, " ".join(long.split()[10:40]), " ".join(reversed(long.split())), "\u4f60\u597d", "\u518d\u89c1", "\u4f60\u597d"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["accepted"] for r in QUERIES["first_wins_near_dedup"](spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(6)] == [True, False, True, True, True, False]


def test_minhash_recall_near_the_threshold(spark):
    from corpusforge.operators import dedup

    rows = []
    for i in range(60):  # 9 of 10 words shared each way: Jaccard 81 / 99
        words = [f"w{i}-{j}" for j in range(99)]
        rows += [(2 * i, words[:90]), (2 * i + 1, words[9:])]
    classes = spark.createDataFrame(rows, "class_id long, tokens array<string>")
    exact = {(r["i"], r["j"]) for r in dedup.set_similarity_pairs(classes, 0.8).collect()}
    found = {(r["i"], r["j"]) for r in dedup.minhash_pairs(classes, 0.8).collect()}
    assert len(exact) == 60 and found <= exact and len(found) >= 0.9 * len(exact)


@pytest.mark.parametrize("threshold", [0.6, 0.85])
def test_recall_of_random_planes(spark, threshold):
    r = np.random.default_rng(5)
    base = r.standard_normal((120, 32))
    noise = r.standard_normal((4, 120, 32)) * np.array([0.3, 0.5, 0.8, 1.1])[:, None, None]
    v = np.concatenate([base, *(base + n for n in noise), base[:5], np.zeros((2, 32))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(3)
    exact = {(x["i"], x["j"]) for x in dedup.cosine_pairs(df, "id", "v", threshold).collect()}
    rows = dedup.cosine_pairs_by_planes(df, "id", "v", threshold).collect()
    found = {(x["i"], x["j"]) for x in rows}
    assert len(rows) == len(found) and found <= exact and len(found) >= 0.97 * len(exact) > 100
    assert {(i, 600 + i) for i in range(5)} <= found
    assert dedup.cosine_pairs_by_planes(df.limit(0), "id", "v", threshold).count() == 0
    apart = {(x["i"], x["j"]) for x in dedup.cosine_pairs_by_planes(df, "id", "v", threshold, across_only=120).collect()}
    assert apart == {(i, j) for i, j in found if i // 120 != j // 120}


def test_planes_grow_with_rows():
    assert dedup.hyperplane_tables(0.85, 10**3)[0] < dedup.hyperplane_tables(0.85, 10**6)[0] < dedup.hyperplane_tables(0.85, 10**9)[0]
    for n in (10, 10**4, 10**9):
        bits, tables = dedup.hyperplane_tables(0.85, n)
        assert 1 - (1 - (1 - math.acos(0.85) / math.pi) ** bits) ** tables >= 0.99


def test_set_similarity_verifies_few_pairs_and_writes_no_ranked_tokens(spark, monkeypatch):
    written = {}

    def counted(df, label, *codec):
        written[label] = table(df, label, *codec)
        return written[label]

    table = dedup.table
    monkeypatch.setattr(dedup, "table", counted)
    r = random.Random(5)
    common = [f"common{i}" for i in range(40)]
    sets = [(i, r.sample(common, 20) + [f"w{i}-{x}" for x in range(20)]) for i in range(0, 200, 2)]
    sets += [(i + 1, t[:-2] + ["other"]) for i, t in sets]
    classes = spark.createDataFrame(sets, "class_id long, tokens array<string>")
    found = {(x["i"], x["j"]) for x in dedup.set_similarity_pairs(classes, 0.6).collect()}
    assert found == {(i, i + 1) for i in range(0, 200, 2)}
    assert "ranked-tokens" not in written and written["set-pairs"].count() < 2 * len(found)


def test_units_end_before_letters_beyond_ascii(spark):
    import duckdb

    from corpusforge.operators import score

    texts = ["EINÄ", "EIN_", "EINA", "EIN", "V²", "W\u0301", "molé", "moles", "o\u017fmo\u017fi\u017f mito\u017fi\u017f", "N1"]
    rows = [(t, name) for t in texts for name, *_ in score.SUBJECT_TERMS]
    got = spark.createDataFrame(rows, "t string, s string").select("t", "s", score.subject_reward(F.col("t"), F.col("s")).alias("r")).collect()
    terms = {name: pair for name, *pair in score.SUBJECT_TERMS}
    con = duckdb.connect()
    want = {(t, s): round(sum(0.1 for p in terms[s] if con.execute("select regexp_matches(?, ?)", [t, p]).fetchone()[0]), 4) for t, s in rows}
    assert {(r["t"], r["s"]): r["r"] for r in got} == want


def _alike(sets, threshold, contained):
    sim = lambda x, y: (len(x & y) / len(x | y), len(x & y) / min(len(x), len(y)))
    pairs = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j]]
    return {(i, j) for i, j in pairs if sim(sets[i], sets[j])[0] >= threshold or sim(sets[i], sets[j])[1] >= contained}


@pytest.mark.parametrize("grams", [1, 3])
def test_sets_are_joined_in_parts_and_sent_to_few_places(spark, monkeypatch, grams):
    """Of near copies, each set is sent to a few places and not for each pair; runs of tokens aren't written."""
    written = {}

    def kept(df, label, *codec):
        new = table(df, label, *codec)
        written.setdefault(label, []).append(new.count())
        return new

    table = dedup.table
    monkeypatch.setattr(dedup, "table", kept)
    monkeypatch.setattr(dedup, "MET_ROWS", 12_000)
    monkeypatch.setattr(dedup, "TOKENS_AT_ONCE", 2_000)
    r = random.Random(7)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(40):  # near copies
        w = list(base)
        w[r.randrange(60)] = f"own{i}"
        rows.append(w)
    for i in range(40):
        w = [f"{r.choice('abc')}{r.randrange(400)}" for _ in range(r.randint(1, 90))]
        rows += [w, w[r.randrange(3) : len(w) - r.randrange(3)], w[len(w) // 2 :]]
    rows += [["one"], ["one", "two"], ["b3", "b4"], []]
    sets = {i: dedup.runs(w, grams) for i, w in enumerate(rows)}
    classes = spark.createDataFrame([(i, list(dict.fromkeys(w)) if grams == 1 else w) for i, w in enumerate(rows)], "class_id long, tokens array<string>")
    got = [(x["i"], x["j"]) for x in dedup.set_similarity_pairs(classes, 0.8, grams=grams, contained=0.9).collect()]
    wanted = _alike(sets, 0.8, 0.9)
    assert len(got) == len(set(got)) and set(got) == wanted and len(wanted) > 700
    assert len(written["set-pairs"]) > 1
    assert written["larger-sets"][0] + written["partners"][0] < len(wanted) / 2
    if grams == 1:
        for measure, t in (("jaccard", 0.5), ("containment", 0.9)):
            got = {(x["i"], x["j"]) for x in dedup.set_similarity_pairs(classes, t, measure).collect()}
            assert got == _alike(sets, t if measure == "jaccard" else 2, t if measure == "containment" else 2)


def test_tokens_that_sets_share_are_counted_and_not_joined(spark, monkeypatch):
    """Sets of different sizes that share frequent tokens make rows only for pairs that may be similar; sets and tokens are dealt to several places."""
    monkeypatch.setattr(dedup, "HELD_TOKENS", 300)
    monkeypatch.setattr(dedup, "HELD_ROWS", 20)
    monkeypatch.setattr(dedup, "MET_AT_ONCE", 500)
    made, kind = [], type(spark.range(1))
    join = kind.join

    def counted(self, other, on=None, how=None):
        found = join(self, other, on, how)
        if on == "k":
            made.append(found.count())
        return found

    monkeypatch.setattr(kind, "join", counted)
    r = random.Random(11)
    sets = {}
    for i in range(0, 300, 3):
        w = r.sample([f"c{x}" for x in range(150)], r.randint(1, 60))
        sets |= {i: set(w), i + 1: set(w[: len(w) - len(w) // 12]), i + 2: set(w) | {f"c{x}" for x in range(r.randrange(8))}}
    classes = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "class_id long, tokens array<string>")
    for measure, t in (("jaccard", 0.6), ("containment", 0.9)):
        got = [(x["i"], x["j"]) for x in dedup.set_similarity_pairs(classes, t, measure).collect()]
        want = _alike(sets, t if measure == "jaccard" else 2, t if measure == "containment" else 2)
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert not made
