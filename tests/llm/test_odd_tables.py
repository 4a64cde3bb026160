"""Repeated rows, null ids, very long texts and clashing columns, for all operators."""

import hashlib
import random
import re

import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F

import brute
from corpusforge.llm import bpe, decontaminate, exact_dedup, language_id, licenses, line_dedup, secrets, simhash, token_counts, urls

CLASH = ("r1", "r2", "key", "fp", "t", "term", "item", "pos", "bucket", "keep_id", "found", "ids", "ends", "map", "gone", "place", "h", "k", "n", "x")
ITEM = " ".join(f"item{chr(97 + i)}" for i in range(20))
LONG = "\n".join(["alpha beta gamma delta " * 40] * 60) + "\n" + ITEM + " password=abcdefgh12345 " + "z" * 70_000
TEXTS = [None, "", "one two three four five six", "one two three four five six", f"x {ITEM} y", "token: abcdefghij\nReleased under the MIT License.", LONG, "İ ſ 🙂", " "]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i in (2, 4) else i, t, "en") for i, t in enumerate(TEXTS)]
    rows += [rows[6], rows[3], rows[3], rows[4], (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH]).repartition(3)


def results(df, docs, *columns):
    """Result by (id, text); rows that repeat both have to agree."""
    rows = df.collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(tuple(r[c] for c in columns))
    return {i: sorted(set(x), key=str) for i, x in by.items()}


def expected(docs, of):
    by = {}
    for r in docs.select("doc_id", "text").collect():
        by.setdefault(r["doc_id"], set()).add(of(r["text"]))
    return {i: sorted(x, key=str) for i, x in by.items()}


def test_licenses(docs):
    got = results(licenses.digests(licenses.license_scan(docs)), docs, "best_license")
    assert got == expected(docs, lambda t: ("MIT" if "MIT" in (t or "") else None,))


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, ITEM, "a"), (1, ITEM, "a"), (None, ITEM, "b"), (2, None, "c"), (3, "", "d")], "item_id long, text string, term string")

    def of(t):
        ws, hit, found, near = brute.contamination(t, [ITEM])
        return len(ws), len(hit), 2 * len(found), 2 * len(near)

    got = results(decontaminate.decontaminate(docs, bench), docs, "n_words", "n_hit", "n_items", "n_near")
    assert got == expected(docs, of) and got[6][0][1] == 20


def test_language(docs):
    got = results(language_id.identify(docs), docs, "lang_pred")
    assert got == expected(docs, lambda t: ("en" if t and any(c.isalpha() for c in t) else "und",))


@pytest.mark.parametrize("chunk", [1 << 16, 999])
def test_bpe(docs, chunk):
    encoding = bpe.ByteBPE(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = results(bpe.digests(bpe.encode_docs(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, chunk=chunk)), docs, "ids_sha256", "decoded_sha256")
    whole = lambda t: bpe.packed([i for p in encoding.find.findall(t) for i in encoding.merge(p.encode())])
    assert got == expected(docs, lambda t: (hashlib.sha256(whole(t or "")).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))


@pytest.mark.parametrize("chunk", [1 << 16, 500])
def test_token_counts(docs, chunk):
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = results(token_counts.token_counts(docs, P.path("piece_bpe_32k.model"), chunk=chunk), docs, "n_bytes", "n_tokens")
    assert got == expected(docs, lambda t: (len((t or "").encode()), len(model.encode(t or ""))))


def test_maps_of_chunks_without_blanks(spark):
    """Texts in which no place starts anew: the counts come from states alone, and those that break are counted whole."""
    r = random.Random(1)
    texts = ["a" * 9000, "ab" * 5000, "".join(r.choice("acgt") for _ in range(9000)), "".join(r.choice(["in", "ter", "nation", "al"]) for _ in range(3000)), "=-" * 4000, " " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = {i: len(model.encode(t)) for i, t in enumerate(texts)}
    count = lambda: {x["doc_id"]: x["n_tokens"] for x in token_counts.token_counts(docs, P.path("piece_bpe_32k.model"), chunk=100).collect()}
    assert count() == want
    machine = token_counts.Transducer(P.path("piece_bpe_32k.model"))
    assert not any(machine.chunk_maps("x", "a" * 100, "a").keys() & {"no such state"})
    assert token_counts.compose({"s": ("m", 3)}, {"m": ("e", 4), "o": ("e", 9)}) == {"s": ("e", 7)} and token_counts.compose({"s": ("m", 3)}, {"o": ("e", 9)}) == {}


def test_simhash(docs):
    got = results(simhash.simhash_dedup(docs), docs, "fingerprint")
    assert got == expected(docs, lambda t: (f"{brute.fingerprint(t):016x}",))
    of = results(simhash.simhash_dedup(docs), docs, "component_id")
    prints = {t: brute.fingerprint(t) for t in TEXTS}
    alike = {t: [i for i, u in enumerate(TEXTS) if i not in (2, 4) and (prints[t] ^ prints[u]).bit_count() <= 4] for t in TEXTS}
    assert of == expected(docs, lambda t: (min(alike[t]) if alike[t] else None,))


def test_lines(docs):
    rows = line_dedup.line_dedup(docs).collect()
    assert len(rows) == docs.count() and all(r["x"] == "clash" for r in rows)
    # Nulls come first, so what a null id has is first; of the others the smaller id.
    order = [t for i, t in enumerate(TEXTS) if i in (2, 4)] + [t for i, t in enumerate(TEXTS) if i not in (2, 4)]
    left = dict(zip(order[2:], (x for x, _, _ in brute.without_lines(order, 1, line_dedup.MIN_CHARS)[2:]), strict=True))
    for r in rows:
        if r["doc_id"] is not None:
            assert r["text"] == left[TEXTS[r["doc_id"]]]


def test_secrets(docs):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
    access, hexes = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")

    def of(t):
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t or "") if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in access.finditer(t or "") if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in hexes.finditer(t or "") if len(m[0]) >= 32]
        return (hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[n]}:{a}:{b}" for a, n, b in sorted(spans)).encode()).hexdigest(),)

    assert results(secrets.digests(secrets.secret_scan(docs)), docs, "base_sha256") == expected(docs, of)


def test_exact(docs):
    rows = docs.select("doc_id", "text").collect()

    def of(t):
        same = [r["doc_id"] for r in rows if (r["text"] or "") == (t or "")]
        ids = [i for i in same if i is not None]
        return max(ids) if ids else None, len(same)

    assert results(exact_dedup.exact_dedup(docs), docs, "keep_id", "group_size") == expected(docs, of)


def test_url_templates_against_brute_force(spark):
    r = random.Random(8)
    pages = []
    for i in range(1500):
        host = r.choice(("a.test", "A.test", "b.test"))
        path = "/".join([r.choice(("", "x", "news", "spam")), r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice("pqr"), *(r.choice(("p", "q", f"id{i}", "0123456789abcdef0")) for _ in range(r.randint(0, 4)))])
        pages.append((i, r.choice((None, "none", f"http://{host}/{path}?q", f"http://{host}/{path}", f"http://{host}/{path}", f"http://{host}/{path}"))))
    labels = {i: int("spam" in (u or "") and r.random() < 0.9 or "/ap" in (u or "")) for i, u in pages if r.random() < 0.6}
    rows = [(i, u, "c", "c", "c") for i, u in pages] + [(7, pages[7][1], "c", "c", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, shape string, template string, r string")
    marks = spark.createDataFrame([(i, 1 - b, b, "c") for i, b in labels.items()] + [(10**6, 1, 1, "c"), (None, 0, 1, "c"), (3, None, None, "c")], "doc_id long, quality int, toxic int, host string")
    s = urls.Settings(children=10, share=0.06)
    got = urls.url_filter(df, marks, rules=(), settings=s).collect()
    # A page that is there twice counts twice, with its label.
    want = brute.url_templates([*pages, (1500, pages[7][1])], labels | ({1500: labels[7]} if 7 in labels else {}), s)
    assert len(got) == len(rows)
    for x in got:
        template, share = want[x["page_id"]]
        assert (x["host"], x["path"]) == brute.url_parts(pages[x["page_id"]][1])
        assert x["template"] == template and abs(x["bad_share"] - share) < 1e-9
        assert x["verdict"] == ("block" if share >= s.reject else "allow")
    assert {x["verdict"] for x in got} == {"block", "allow"}
