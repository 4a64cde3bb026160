"""Line de-duplication: exact copies by digest, near copies by a segment-partition edit join.

A line is cut into ``edits + 1`` segments; any line within ``edits`` edits has one of them
as a substring, at a place and in a line length that differ by little. So the segments of
each distinct line are indexed by (line length, segment number, segment) and longer or
equal lines probe the index with the few substrings that can matter. Lines that meet are
verified with a banded bit-parallel edit distance.

Lines that differ in one replaced word (of any length) can count as near copies too: as the
number of words is the same, they agree on the first or the second half of their words, so
two more keys of each line find all of them.

A posting list of more than ``tile`` lines is not joined as it is. Without the segment that
they share, two lines of it are still within ``edits`` edits, so what remains of them is
cut into segments again, and so on, until lists are short or next to nothing is left to
cut; then all lines of a list are close to the first of them, and only that pair is verified.
So pairs, too, grow with the lines of a list and not with their square.

DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.keys import row_key
from corpusforge.runtime import small, table

#: Edits that make a near copy, and characters from which on lines are compared by edits (others only match exactly).
EDITS, MIN_CHARS = 1, 20
#: Words from which on a line with one of them replaced is a near copy, if that is asked for.
MIN_WORDS = 8
TILE = 32
_DOC = ["r1", "r2"]
#: Of two lines that are both indexed under a key, the pair is made once.
_ONCE = "(own and a < b) or (not own and a <> b)"


def edit_distance(left: Column, right: Column, edits: int) -> Column:
    """Edit distance of two strings if it's at most ``edits``, else ``edits + 1``.

    Column by column, the differences between neighbouring cells of the ``2 * edits + 1``
    diagonals are kept as bits, and one column follows from the other by a handful of bit
    operations. The longer string has to have more than ``edits`` characters.
    """
    width = 2 * edits + 1
    mask = (1 << width) - 1
    bit = lambda n: F.lit(n).cast("long")
    inverse = lambda x: x.bitwiseXOR(bit(mask))

    def over(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        m, n = F.size(a), F.size(b)

        def step(acc: Column, i: Column) -> Column:
            letter = F.get(b, i)
            same = [F.when(F.get(a, i + (edits - width + 1 + x)) == letter, bit(1 << x)).otherwise(bit(0)) for x in range(width)]
            equal = same[0]
            for s in same[1:]:
                equal = equal.bitwiseOR(s)
            start = F.struct(acc["vp"].alias("vp"), acc["vn"].alias("vn"), acc["d"].alias("d"), acc["h"].alias("h"), equal.alias("eq"))

            def diagonal(s: Column) -> Column:
                d0 = (s["eq"].bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(s["eq"]).bitwiseOR(s["vn"]).bitwiseAND(bit(mask))
                return F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["d"].alias("d"), s["h"].alias("h"), d0.alias("d0"))

            def advance(s: Column) -> Column:
                hp = s["vn"].bitwiseOR(inverse(s["d0"].bitwiseOR(s["vp"])))
                hn = s["d0"].bitwiseAND(s["vp"])
                down = F.shiftrightunsigned(s["d0"], 1)
                on = i < m - edits
                set_ = lambda x, y: F.when(x.bitwiseAND(y) != 0, F.lit(1)).otherwise(F.lit(0))
                d = s["d"] + F.when(on, 1 - set_(s["d0"], bit(1 << (width - 1)))).otherwise(set_(hp, s["h"]) - set_(hn, s["h"]))
                h = F.when(on, s["h"]).otherwise(F.shiftrightunsigned(s["h"], 1))
                return F.struct(hn.bitwiseOR(inverse(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), d.alias("d"), h.alias("h"))

            return F.transform(F.transform(F.array(start), diagonal), advance)[0]

        begin = F.struct(bit((mask << (width - edits - 1)) & mask).alias("vp"), bit(0).alias("vn"), F.lit(edits).alias("d"), bit(1 << (width - 2)).alias("h"))
        steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.when(m - n > edits, F.lit(edits + 1)).otherwise(F.least(F.aggregate(steps, begin, step)["d"], F.lit(edits + 1)))

    longer = F.char_length(left) >= F.char_length(right)
    chars = lambda s: F.split(s, "")
    pair = F.struct(chars(F.when(longer, left).otherwise(right)).alias("a"), chars(F.when(longer, right).otherwise(left)).alias("b"))
    return F.transform(F.array(pair), over)[0]


def _may_be_close(left: Column, right: Column, edits: int) -> Column:
    """False only if the distance is over ``edits``: of twice as many pieces as segments, at most one an edit is not in the longer line."""
    longer = F.char_length(left) >= F.char_length(right)
    a, b = F.when(longer, left).otherwise(right), F.when(longer, right).otherwise(left)
    pieces = segments(F.char_length(b), 2 * edits + 1)
    lacks = [F.when(F.contains(a, F.substring(b, x + 1, n)), 0).otherwise(1) for x, n in pieces]
    return reduce(lambda x, y: x + y, lacks) <= edits


def segments(length: Column, edits: int) -> list[tuple[Column, Column]]:
    """(begin, characters) of the segments of a line, the later ones longer by one where it doesn't divide."""
    parts = edits + 1
    short, extra = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    first_long = F.lit(parts) - extra
    return [(F.lit(i) * short + F.greatest(F.lit(0), F.lit(i) - first_long), short + F.when(F.lit(i) >= first_long, 1).otherwise(0)) for i in range(parts)]


@dataclass(frozen=True)
class Cut:
    """A segment: which one of lines of which size, where it begins in the line at hand, and its characters."""

    size: Column
    number: int
    begin: Column
    chars: Column
    inside: Column | None = None

    def key(self, line: Column, *above: Column) -> Column:
        found = F.xxhash64(*above, self.size, F.lit(self.number), F.substring(line, self.begin + 1, self.chars))
        return found if self.inside is None else F.when(self.inside, found)

    def rest(self, line: Column) -> Column:
        return F.concat(F.substring(line, F.lit(1), self.begin), F.substring(line, self.begin + self.chars + 1, F.char_length(line)))


def cuts(length: Column, edits: int) -> tuple[list[Cut], list[Cut]]:
    """Segments under which a line of a length is indexed, and the further substrings with which it probes.

    It probes lines of its own length and of up to ``edits`` characters less. A substring
    begins where the segment does, up to as many places off as edits may have come before
    it, and leaves as many as may come after it. Probes with the segments themselves are
    the same as the index keys and not repeated.
    """
    index = [Cut(length, i, a, n) for i, (a, n) in enumerate(segments(length, edits))]
    probes = []
    for less in range(edits + 1):
        size = length - less
        for i, (a, n) in enumerate(segments(size, edits)):
            low, high = max(-i, less - (edits - i)), min(i, less + (edits - i))
            probes += [Cut(size, i, a + shift, n, (a + shift >= 0) & (a + shift + n <= length)) for shift in range(low, high + 1) if less or shift]
    return index, probes


def n_words(line: Column) -> Column:
    """Words between single blanks."""
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def halves(line: Column, *above: Column) -> list[tuple[Column, Column]]:
    """(hash, other words) of each half of a line's words: of two lines that differ in one word, one hash is equal."""
    n = n_words(line)
    half = F.floor(n / 2).cast("int")
    first, second = (F.call_function("substring_index", line, F.lit(" "), count) for count in (half, half - n))
    return [(F.xxhash64(*above, F.lit(f"words {i}"), n, own), other) for i, (own, other) in enumerate(((first, second), (second, first)))]


def one_word_replaced(left: Column, right: Column) -> Column:
    """Do two arrays of words differ in one place at most?"""
    return (F.size(left) == F.size(right)) & (F.size(F.filter(F.zip_with(left, right, lambda x, y: x != y), lambda x: x)) <= 1)


def _lines(rows: DataFrame) -> DataFrame:
    return rows.select(*_DOC, "doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line")).filter(F.trim("line") != "").withColumn("id", F.unhex(F.md5("line")))


def _hot_pairs(held: DataFrame, edits: int, tile: int) -> DataFrame:
    """``(a, b)`` of lines that may be close, from long lists: (k, id, place, words, index, r).

    ``r`` is what remains of a line without what all lines of the list share; ``index`` tells the
    lines that are indexed, and probe too, from those that only probe.
    """
    pairs = []
    length = F.when(F.col("words"), n_words(F.col("r"))).otherwise(F.char_length("r"))
    while True:
        done = (F.col("left") <= edits) | (F.col("words") & (F.col("left") <= 1))
        lists = held.filter("index").groupBy("k", "words").agg(F.count("*").alias("n"), F.max(length).alias("left"))
        lists = table(lists.select("k", F.when(F.col("n") <= tile, "short").when(done, "ended").otherwise("more").alias("what")), "segment-lists")
        told = held.join(small(lists), "k")
        short, ended, more = (told.filter(F.col("what") == what) for what in ("short", "ended", "more"))

        meet = short.filter("index").select("k", F.col("id").alias("a")).join(short.select("k", F.col("id").alias("b"), F.col("index").alias("own")), "k")
        pairs.append(meet.filter(_ONCE).select("a", "b"))

        # Lines of one length that agree on all but so little are all close to the first of them.
        here, probing = ended.filter("index"), ended.filter("not index")
        first = here.groupBy("k").agg(F.min(F.struct("place", "id")).alias("f")).select("k", F.col("f.id").alias("b"))
        pairs.append(here.select("k", F.col("id").alias("a")).join(first, "k").select("a", "b").filter("a <> b"))
        others = probing.join(here.select("k", "id"), ["k", "id"], "left_anti").select("k", F.col("id").alias("b"), F.col("r").alias("ry"))
        near = here.select("k", F.col("id").alias("a"), F.col("r").alias("rx")).join(others, "k").filter(F.levenshtein("rx", "ry", edits) >= 0)
        pairs.append(near.select("a", "b"))

        r, k = F.col("r"), F.col("k")
        index, probes = cuts(F.char_length("r"), edits)
        child = lambda key, rest, own: F.struct(key.alias("k"), rest.alias("r"), own.alias("index"))
        own, further = ([child(c.key(r, k), c.rest(r), kind) for c in part] for part, kind in ((index, F.col("index")), (probes, F.lit(False))))
        children = F.when(F.col("words"), F.array(*[child(*h, F.col("index")) for h in halves(r, k)])).otherwise(F.array(*own, *further))
        held = more.select("id", "place", "words", F.explode(children).alias("c")).select("c.k", "id", "place", "words", "c.index", "c.r").filter("k is not null")
        held = table(held.distinct(), "segments")
        if held.isEmpty():
            return reduce(DataFrame.union, pairs)


def repeated_lines(rows: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, tile: int = TILE, min_words: int | None = None) -> DataFrame:
    """``r1, r2, ln, near`` of the lines to drop from ``rows`` (r1, r2, doc_id, text)."""
    lines = _lines(rows).withColumn("n", F.char_length("line"))
    line, long = F.col("line"), F.col("n") >= max(min_chars, edits + 1)
    index, probes = cuts(F.col("n"), edits)
    wordy = n_words(line) >= F.lit(min_words)
    by_words = [] if min_words is None else [F.when(wordy, k) for k, _ in halves(line)]
    keys = [c.key(line) for c in index] + by_words + [c.key(line) for c in probes]
    rests = [c.rest(line) for c in index] + [r for _, r in halves(line)[: len(by_words)]] + [c.rest(line) for c in probes]
    names, n_index = [f"k{x}" for x in range(len(keys))], len(index) + len(by_words)
    keyed = lines.select("id", F.struct("doc_id", *_DOC, "ln").alias("place"), *(F.when(long, c).alias(k) for k, c in zip(names, keys, strict=True)))
    distinct = keyed.groupBy("id").agg(F.min("place").alias("place"), F.count("*").alias("times"), *(F.min(k).alias(k) for k in names))
    distinct = table(distinct, "distinct-lines")

    def listed(of: list[str]) -> DataFrame:
        return distinct.select("id", F.posexplode(F.array(*of)).alias("j", "k")).filter("k is not null")

    indexed, probing = listed(names[:n_index]), listed(names)
    hot = table(indexed.groupBy("k").agg(F.count_distinct("id").alias("n")).filter(F.col("n") > tile).select("k"), "hot-segments")
    own = (F.col("j") < n_index).alias("own")
    cold_index, cold_probing = (x.join(small(hot), "k", "left_anti").select("id", "k", own) for x in (indexed, probing))  # repeated keys of a line only repeat pairs
    meet = cold_index.select("k", F.col("id").alias("a")).join(cold_probing.select("k", F.col("id").alias("b"), "own"), "k").filter(_ONCE)
    pair = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    cold = table(pair(meet), "line-pairs")
    in_hot = table(probing.join(small(hot), "k", "left_semi"), "lines-of-hot-segments")

    wanted = table(cold.select(F.col("a").alias("id")).union(cold.select(F.col("b").alias("id"))).union(in_hot.select("id")).distinct(), "lines-to-verify")
    texts = lines.select("id", *_DOC, "doc_id", "ln", "line").join(small(wanted), "id").groupBy("id").agg(F.min(F.struct("doc_id", *_DOC, "ln", "line")).alias("x"))
    texts = table(texts.select("id", F.struct("x.doc_id", "x.r1", "x.r2", "x.ln").alias("place"), "x.line"), "lines-verified")

    pairs = cold
    if not in_hot.isEmpty():
        rest = F.coalesce(*[F.when(F.col("j") == x, r) for x, r in enumerate(rests)])
        of_words = F.col("j").between(len(index), n_index - 1)
        held = in_hot.join(texts, "id").withColumn("n", F.char_length("line")).select("k", "id", "place", of_words.alias("words"), (F.col("j") < n_index).alias("index"), rest.alias("r"))
        pairs = table(pair(cold.union(_hot_pairs(table(held.distinct(), "segments"), edits, tile))), "line-pairs")

    side = lambda s: texts.select(F.col("id").alias(s), F.col("place").alias(f"place_{s}"), F.col("line").alias(f"line_{s}"))
    left, right = F.col("line_a"), F.col("line_b")
    alike = _may_be_close(left, right, edits) & (edit_distance(left, right, edits) <= edits)
    if min_words is not None:
        ws_a, ws_b = F.split("line_a", " "), F.split("line_b", " ")
        alike = ((F.size(ws_a) >= min_words) & one_word_replaced(ws_a, ws_b)) | alike
    close = pairs.join(side("a"), "a").join(side("b"), "b").filter(alike)
    later = close.select(F.when(F.col("place_a") > F.col("place_b"), F.col("a")).otherwise(F.col("b")).alias("id")).distinct().withColumn("near", F.lit(True))

    concerned = distinct.select("id", "place", "times").join(later, "id", "left").filter("times > 1 or near")
    concerned = table(concerned.select("id", F.col("place").alias("kept"), F.coalesce("near", F.lit(False)).alias("near")), "repeated-lines")
    found = _lines(rows).drop("line").join(small(concerned), "id")
    same = (F.col("kept.r1") == F.col("r1")) & (F.col("kept.r2") == F.col("r2")) & (F.col("kept.ln") == F.col("ln"))
    return found.filter(F.col("near") | ~same).select(*_DOC, "ln", (F.col("near") & same).alias("near"))


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS, tile: int = TILE, min_words: int | None = None
) -> DataFrame:
    """The rows and columns of ``docs`` with repeated lines taken out of the text, and a struct column ``line_dedup``.

    Lines are parted by ``\\n`` and ordered by id (nulls first), then by where they stand. A
    line goes if an equal one comes before it, or if it has at least ``min_chars`` characters
    and a line within ``edits`` edits, with as many, comes before it; so the first of any
    copies stays. With ``min_words``, a line of at least ``min_chars`` characters and so many
    words (parted by single blanks) also goes if one that differs from it in one replaced
    word comes before it. Blank lines always stay. The struct has ``n_lines``, ``n_exact`` and
    ``n_near``: lines before, and those that went as an exact copy or only as a near one.

    No row goes: a text all of whose lines went is empty. A null text stays null and has no
    lines; an empty one has one blank line. Rows that repeat a document (id and text) count
    as one and get the same text. Empty tables are allowed. Other columns stay as they are;
    a column called ``line_dedup`` is replaced.
    """
    key1, key2 = row_key(F.col(id_col), F.col(text_col))
    rows = docs.select(key1, key2, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    gone = repeated_lines(rows, edits, min_chars, tile, min_words).distinct().groupBy("r1", "r2").agg(
        F.collect_set("ln").alias("gone"), F.count_if(~F.col("near")).alias("exact"), F.count_if(F.col("near")).alias("near")
    )
    gone = table(gone.select(F.struct("r1", "r2").alias("__key"), "gone", "exact", "near"), "lines-gone")
    held = docs.drop("line_dedup").select(F.struct(*[F.col(c) for c in docs.drop("line_dedup").columns]).alias("__row"), F.struct(key1, key2).alias("__key"))
    joined = held.join(gone, "__key", "left")
    text = F.col("__row")[text_col]
    lines = F.split(text, "\n")
    left = F.filter(lines, lambda x, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i))
    new = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(left, "\n"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    info = F.struct(F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), count("exact").alias("n_exact"), count("near").alias("n_near"))
    columns = [new.alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in docs.drop("line_dedup").columns]
    return joined.select(*columns, info.alias("line_dedup"))


def digests(deduped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_exact, n_near, n_kept, text_sha256`` of the rows of :func:`line_dedup`; a null text counts as empty."""
    kept = (F.col("line_dedup.n_lines") - F.col("line_dedup.n_exact") - F.col("line_dedup.n_near")).alias("n_kept")
    return deduped.select(F.col(id_col).alias("doc_id"), "line_dedup.n_lines", "line_dedup.n_exact", "line_dedup.n_near", kept, F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("text_sha256"))
