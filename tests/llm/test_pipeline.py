import base64
import hashlib
import os
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from corpusforge.llm import line_dedup, pipeline

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text2 string, r1 long, first boolean, `component_id` string"


def made(spark, seed=3):
    """Documents with every odd case, and the folder of a benchmark."""
    r = random.Random(seed)
    sounds = {"xa": ["ba", "ra", "lo", "ti", "é"], "xb": ["sch", "ung", "ein", "ver", "ß"]}
    word = lambda k: "".join(r.choices(sounds[k], k=r.randint(2, 4)))
    item = " ".join(word("xa") for _ in range(30))
    texts = []
    for i in range(40):
        k = ("xa", "xb")[i % 2]
        texts.append(("\n".join(" ".join(word(k) for _ in range(r.randint(3, 14))) for _ in range(r.randint(1, 5))), None if i % 5 == 0 else k))
    texts += [(f"{t} {word(k or 'xa')}", k) for t, k in texts[:8]] + texts[:6]
    texts += [(f"{word('xa')} {item}", "xa"), (f"{word('xa')} {item.upper()}", "xa"), (" ".join(item.split()[:12] + ["x"] + item.split()[13:]), "xa")]
    lines = texts[10][0].split("\n") + texts[11][0].split("\n")
    texts += [("\n".join(r.sample(lines, min(3, len(lines)))).replace("ba", "lo", 1), "xa") for _ in range(6)]
    texts += [(None, "xa"), ("", "xa"), (" \n", "xb"), ("12 !", None), (f"{'ba ra lo ' * 4000}", "xa")]
    ids = [*range(len(texts))]
    ids[3] = ids[7] = None
    ids[12] = ids[11]  # two texts of one id
    rows = [(i, t, k, "s", None, "clash", 7, True, "clash") for i, (t, k) in zip(ids, texts, strict=True)]
    rows += [rows[20], rows[20], rows[3]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), item


def key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0, r["text"] is not None, r["text"] or "")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_stages_against_brute_force(spark, tmp_path):
    docs, item = made(spark)
    bench = [item, None, ""]
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "simhash_dedup", "decontaminate", "byte_bpe"]

    def stage(name, given):
        out = stages[name](spark, spark.createDataFrame(given, docs.schema), str(tmp_path))
        assert name == "byte_bpe" or out.columns == docs.columns
        return out.collect()

    given = docs.collect()
    want = brute.languages([(r["text"], r["lang"]) for r in given], range(len(given)))
    got = stage("language_id", given)
    assert sorted((key(r), r["lang"]) for r in got) == sorted((key(r), k) for r, (k, s) in zip(given, want, strict=True) if k != "und" and s >= pipeline.LEAST_SCORE)
    assert 0 < len(got) < len(given)

    # Rows that share an id are ordered by a hash, so the brute force is told the rows of one place at a time.
    from corpusforge.llm.keys import row_key

    hashes = {(r["doc_id"], r["text"]): (r["r1"], r["r2"]) for r in spark.createDataFrame(got, docs.schema).select("doc_id", "text", *row_key(F.col("doc_id"), F.col("text"))).collect()}
    order = sorted({(r["doc_id"] is not None, r["doc_id"] or 0, *hashes[r["doc_id"], r["text"]], r["text"]) for r in got})
    left = brute.without_lines([o[-1] for o in order], 1, line_dedup.MIN_CHARS, 8)
    texts = {o[-3:-1]: x[0] for o, x in zip(order, left, strict=True)}
    lined = stage("line_dedup", got)
    assert sorted(key(r) for r in lined) == sorted((r["doc_id"] is None, r["doc_id"] or 0, True, texts[hashes[r["doc_id"], r["text"]]]) for r in got)
    assert all(r["n_chars"] == len(r["text"]) for r in lined) and any(x[1] for x in left) and any(x[2] for x in left)

    near = stage("simhash_dedup", lined)
    rows = sorted({key(r) for r in lined})
    root = brute.components([brute.fingerprint(x[-1]) for x in rows])
    assert len(near) == len(set(root)) and {key(r) for r in near} <= set(rows)
    assert {root[rows.index(key(r))] for r in near} == set(root)
    assert all(key(r)[:2] == rows[root[rows.index(key(r))]][:2] for r in near)

    clean = stage("decontaminate", near)
    judged = [brute.contamination(r["text"], bench) for r in near]
    assert sorted(key(r) for r in clean) == sorted(key(r) for r, (ws, hit, *_) in zip(near, judged, strict=True) if not (hit and 20 * len(hit) >= len(ws)))
    assert len(clean) < len(near)

    encoding = library()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], bytes(r["ids"]), r["ids_sha256"], r["decoded_sha256"]) for r in stage("byte_bpe", clean))
    assert got == sorted(
        (r["doc_id"] is None, r["doc_id"] or 0, len(ids := encoding.encode_ordinary(r["text"])), raw := b"".join(i.to_bytes(4, "little") for i in ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())
        for r in clean
    )


def test_wanted_languages_only(spark):
    docs, _ = made(spark)
    assert {r["lang"] for r in pipeline.language(spark, docs, "", wanted=("xb",)).collect()} == {"xb"}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(map(key, pipeline.language(spark, unlabelled, "").collect())) == sorted(key(r) for r in docs.collect() if r["text"] and any(c.isalpha() for c in r["text"]))


def test_stages_of_an_empty_table(spark, tmp_path):
    docs, item = made(spark)
    spark.createDataFrame([(1, item)], "item_id long, text string").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert pipeline.benchmarks(spark, docs, str(tmp_path)).count() == docs.count()


def test_pipeline_drops_a_line_with_one_word_replaced(spark):
    line = "The committee met on {} in the large hall of the old town and adjourned after two hours"
    docs = spark.createDataFrame([(1, line.format("2021-03-04")), (2, line.format("2022-11-28")), (3, line.format("Monday").replace("two", "seven"))], "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in pipeline.lines(spark, docs, "").collect()}
    assert [bool(kept[i]) for i in (1, 2, 3)] == [True, False, True]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0 < len(rows) <= docs.count() and len({r["doc_id"] for r in rows}) == len(rows)
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in rows)
