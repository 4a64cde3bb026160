"""What the operators should give, in plain loops."""

import re

import numpy as np
import regex
import xxhash

from corpusforge.llm import language_id as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, bits=4):
    """For each fingerprint the smallest place that can be reached."""
    root, changed = list(range(len(prints))), True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= bits and root[j] > root[i]:
                    root[j], changed = root[i], True
    return root


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def one_word(a, b, least):
    a, b = a.split(" "), b.split(" ")
    return len(a) == len(b) >= least and sum(x != y for x, y in zip(a, b, strict=True)) <= 1


def without_lines(texts, k, chars, words=None):
    """Texts without repeated lines, and how many went as exact and as near copies."""
    seen, out = [], []
    for t in texts:
        kept, exact, near = [], 0, 0
        for line in (t or "").split("\n"):
            if not line.strip(" "):
                kept.append(line)
                continue
            alike = lambda x: len(x) >= chars and (abs(len(x) - len(line)) <= k and edits(x, line) <= k or words is not None and one_word(x, line, words))
            if line in seen:
                exact += 1
            elif len(line) >= chars and any(alike(x) for x in seen):
                near += 1
            else:
                kept.append(line)
            seen.append(line)
        out.append((None if t is None else "\n".join(kept), exact, near))
    return out


def contamination(text, items, window=13, slack=2, near_terms=11):
    """Words, places that are hit, and numbers of the items that are found exactly and nearly."""
    ws, hit, found, near = WORD.findall(low(text)), set(), set(), set()
    places = {}
    for p, w in enumerate(ws):
        places.setdefault(w, []).append(p)
    for k, item in enumerate(items):
        it = WORD.findall(low(item))
        n = min(window, len(it))
        for a in range(len(it) - n + 1 if it else 0):
            own = it[a : a + n]
            for b in range(len(ws) - n + 1):
                if ws[b : b + n] == own:
                    hit |= set(range(b, b + n))
                    found.add(k)
            for b in range(-n - slack, len(ws) + slack):
                if sum(any(abs(p - b - j) <= slack for p in places.get(w, ())) for j, w in enumerate(own)) >= min(near_terms, n):
                    near.add(k)
                    break
    return ws, hit, found, near


def language_vector(text):
    """The sum of bound trigram vectors of the words, each between blanks."""
    words = regex.findall(r"[\p{L}\p{M}]+", (text or "").lower())
    if not regex.search(r"\p{L}", text or ""):
        return None
    line, total = f" {' '.join(words)} ", np.zeros(L.DIMENSIONS)
    for i in range(len(line) - 2):
        bound = np.ones(L.DIMENSIONS)
        for place, c in enumerate(line[i : i + 3]):
            bound *= np.roll(L.letter_vector(ord(c)), place)
        total += bound
    return total / np.linalg.norm(total)


def languages(rows, learn_from):
    """Language and score of each (text, lang), learned from those that ``learn_from`` names."""
    vectors, sums = [language_vector(t) for t, _ in rows], {}
    for i in learn_from:
        if rows[i][1] is not None and vectors[i] is not None:
            sums[rows[i][1]] = sums.get(rows[i][1], 0) + vectors[i]
    names = sorted(sums)
    protos = np.array([sums[x] / np.linalg.norm(sums[x]) for x in names])
    common = protos.mean(axis=0)
    out = []
    for v in vectors:
        if v is None:
            out.append(("und", 0.0))
            continue
        v = v - common * (v @ common) / (common @ common)
        cosines = [(p - common) @ v / np.linalg.norm(p - common) / np.linalg.norm(v) for p in protos]
        best = int(np.argmax(cosines))
        out.append((names[best], min(1.0, max(0.0, cosines[best]))))
    return out


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.DOTALL).groups()
    return low(host), path


def url_templates(pages, labels, s):
    """By page id: template and smoothed share of bad pages, from a tree that is walked node by node."""
    shape = {i: re.sub("[0-9]+", "#", re.sub("(?i)[0-9a-f]{16,}", "#", url_parts(u)[1])) for i, u in pages}
    host = {i: url_parts(u)[0] for i, u in pages}
    leaves = {}
    for i, _ in pages:
        leaf = leaves.setdefault((host[i], shape[i]), {"t": shape[i].split("/"), "n": 0, "lab": 0, "bad": 0})
        leaf["n"] += 1
        leaf["lab"] += i in labels
        leaf["bad"] += labels.get(i, 0)

    def test(lab, bad, all_, all_bad, continuous):
        rest = all_ - lab
        if lab == 0 or rest == 0 or all_bad in (0, all_):
            return None
        p, per = all_bad / all_, 1 / lab + 1 / rest
        gap = abs(bad / lab - (all_bad - bad) / rest)
        gap = max(gap - per / 2, 0) if continuous else gap
        return gap * gap / (p * (1 - p) * per)

    def grouped(key, among=None):
        out = {}
        for (h, _), leaf in leaves.items():
            if among is None or among(leaf):
                g = out.setdefault((h, *key(leaf)), {"n": 0, "lab": 0, "bad": 0, "leaves": []})
                for c in ("n", "lab", "bad"):
                    g[c] += leaf[c]
                g["leaves"].append(leaf)
        return out

    deepest = max((len(x["t"]) for x in leaves.values()), default=0)
    for level in range(1, deepest):
        children = grouped(lambda x: (tuple(x["t"][:level]), x["t"][level]), lambda x: len(x["t"]) > level)  # noqa: B023
        nodes = {}
        for (h, above, _), c in children.items():
            nodes.setdefault((h, above), []).append(c)
        for of in nodes.values():
            if len(of) > s.children:
                whole = {c: sum(x[c] for x in of) for c in ("n", "lab", "bad")}
                for c in of:
                    chi2 = test(c["lab"], c["bad"], whole["lab"], whole["bad"], True)
                    if c["n"] < s.share * whole["n"] and not (c["lab"] >= s.apart and chi2 is not None and chi2 >= s.chi2):
                        for leaf in c["leaves"]:
                            leaf["new"] = [*leaf["t"][:level], "*", *leaf["t"][level + 1 :]]
        for leaf in leaves.values():
            leaf["t"] = leaf.pop("new", leaf["t"])
    for level in range(deepest - 1, 0, -1):
        branches = grouped(lambda x: (tuple(x["t"]),), lambda x: len(x["t"]) > level)  # noqa: B023
        families = {}
        for (h, t), b in branches.items():
            families.setdefault((h, (*t[:level], "~", *t[level + 1 :])), []).append(b)
        for (_, merged), of in families.items():
            whole = {c: sum(x[c] for x in of) for c in ("lab", "bad")}
            for b in of:
                chi2 = test(b["lab"], b["bad"], whole["lab"], whole["bad"], False)
                if len(of) > 1 and (chi2 is None or chi2 < s.chi2):
                    for leaf in b["leaves"]:
                        leaf["t"] = list(merged)
    overall = sum(x["bad"] for x in leaves.values()) / max(sum(x["lab"] for x in leaves.values()), 1)
    out = {}
    for (h, t), g in grouped(lambda x: (tuple(x["t"]),)).items():
        for leaf in g["leaves"]:
            leaf["share"] = (g["bad"] + s.strength * overall) / (g["lab"] + s.strength)
    for i, _ in pages:
        leaf = leaves[host[i], shape[i]]
        out[i] = "/".join(leaf["t"]), leaf["share"]
    return out
