"""Byte-level BPE encoding and decoding by a rank file.

A text is pre-tokenised by the pattern and each match is merged on its own. A text that
is longer than a chunk is cut into overlapping windows, which tasks pre-tokenise in
parallel. A window begins anywhere, so its first matches may be wrong, and its last ones
too, as what follows is unknown; but matching goes on from a boundary in one way only,
so from the first boundary that two neighbours share, the later window is right. There
the windows are stitched: each then knows the run of pre-tokens that is its own, and tasks
encode these runs. Of the runs of a text only their ids and bytes are put together. Where
two neighbours share no boundary (a match longer than the overlap), the text's windows go to one
task, which matches again from the last boundary that is sure.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.chunked import CHUNK, whole_and_windows
from corpusforge.runtime import small, table

#: Characters that neighbouring windows have in common on either side of a cut.
MARGIN = 256
#: No alternative of the pattern looks further than this beyond its match.
_LOOKAHEAD = 8
_CACHED_PIECES, _CACHED_BYTES, _NO_RANK = 120_000, 64, 1 << 30


class PairRanks:
    """Ranks of the tokens that two adjacent ones make, for arrays of ids; a hash table with open addressing."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {(a, b): r for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None}
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NO_RANK, np.int64)
        left = np.array([a << 32 | b for a, b in pairs], np.int64)
        values, at = np.fromiter(pairs.values(), np.int64, len(pairs)), self._slot(left)
        while left.size:
            free = self.keys[at] < 0
            self.keys[at[free]] = left[free]  # of several for a slot, the last one has it
            self.values[at[free]] = values[free]
            out = self.keys[at] != left
            left, values, at = left[out], values[out], (at[out] + 1) & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        wanted = a << 32 | b
        at, found = self._slot(wanted), np.full(len(wanted), _NO_RANK, np.int64)
        open_ = np.arange(len(wanted))
        while open_.size:
            there = self.keys[at]
            hit = there == wanted[open_]
            found[open_[hit]] = self.values[at[hit]]
            more = ~hit & (there >= 0)
            open_, at = open_[more], (at[more] + 1) & (1 << self.bits) - 1
        return found


class ByteBPE:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.find = regex.compile(pattern)
        self._known: dict[str, bytes] = {}
        self._pairs = PairRanks(self.ranks)
        self._of_byte = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the adjacent pair of the least rank is joined, leftmost first."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at i; 0: merged away
        heap = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (rank := ranks.get(piece[i : end[stop]])) is not None:
                    heappush(heap, (rank, i, end[stop]))
            if (b := before[i]) >= 0 and (rank := ranks.get(piece[b:stop])) is not None:
                heappush(heap, (rank, b, stop))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of many short pre-tokens: in each round, each of them has its best pair joined, as by :meth:`merge`."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        ids, owner = self._of_byte[np.frombuffer(b"".join(pieces), np.uint8)], np.repeat(np.arange(len(pieces)), sizes)
        last = np.empty(len(ids), bool)  # of its pre-token
        last[:-1], last[-1:] = owner[1:] != owner[:-1], True
        rank = np.full(len(ids), _NO_RANK, np.int64)  # of the pair that begins here
        inner = np.flatnonzero(~last)
        rank[inner] = self._pairs.of(ids[inner], ids[inner + 1])
        done_ids, done_owner = [], []
        while len(ids):
            starts = np.flatnonzero(np.concatenate(([True], last[:-1])))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), starts)
            going = best >> 32 < _NO_RANK
            at = best[going] & 0xFFFFFFFF
            whole = np.repeat(~going, np.diff(np.append(starts, len(ids))))
            done_ids.append(ids[whole])
            done_owner.append(owner[whole])
            ids[at], last[at] = rank[at], last[at + 1]
            stay = ~whole
            stay[at + 1] = False
            at = (np.cumsum(stay) - 1)[at]
            ids, owner, last, rank = ids[stay], owner[stay], last[stay], rank[stay]
            before = at[(at > 0) & ~last[at - 1]] - 1
            rank[before] = self._pairs.of(ids[before], ids[before + 1])
            rank[at] = _NO_RANK
            after = at[~last[at]]
            rank[after] = self._pairs.of(ids[after], ids[after + 1])
        owner = np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        raw = np.concatenate(done_ids)[order].astype("<u4").tobytes()
        stops = (4 * np.cumsum(np.bincount(owner, minlength=len(pieces)))).tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def encode_lists(self, lists: list[list[str]]) -> list[bytes]:
        """Packed ids of the pre-tokens of each list. What is not known yet is merged at once for all of them."""
        known = self._known
        new = {p for pieces in lists for p in pieces if p not in known}
        if len(known) + len(new) > _CACHED_PIECES:
            known.clear()
            new = {p for pieces in lists for p in pieces}
        raw = {p: p.encode() for p in new}
        short = [p for p, r in raw.items() if len(r) <= _CACHED_BYTES]
        found = dict(zip(short, self.merge_many([raw[p] for p in short]), strict=True)) if short else {}
        known.update(found)
        long = {p: packed(self.merge(r)) for p, r in raw.items() if p not in found}
        if not long:
            return [b"".join(map(known.__getitem__, pieces)) for pieces in lists]
        return [b"".join([long.get(p) or known[p] for p in pieces]) for pieces in lists]

    def encode_pieces(self, pieces: list[str]) -> bytes:
        return self.encode_lists([pieces])[0]

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts."""
        return self.encode_lists(list(map(self.find.findall, texts)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def ends(self, text: str, at: int = 0) -> list[int]:
        """Where the matches of a window end, as positions in the whole text."""
        return [at + m.end() for m in self.find.finditer(text)]

    def stitch(self, n: int, windows: list[tuple[int, str, list[int]]]) -> list[str]:
        """Pre-tokens of a text of ``n`` characters from (begin, text, ends) of windows in order."""
        at0, text, ends = windows[0]
        sure, whole_to = [e for e in ends if e <= at0 + len(text) - _LOOKAHEAD or at0 + len(text) == n], at0 + len(text)
        pieces_text = [text]
        for at, text, ends in windows[1:]:
            stop = at + len(text)
            pieces_text.append(text[whole_to - at :])
            limit = n if stop == n else stop - _LOOKAHEAD
            mine = [at, *ends]
            shared = next((p for p in sure[bisect_left(sure, at) :] if (i := bisect_left(mine, p)) < len(mine) and mine[i] == p), None)
            if shared is None:
                last = sure[-1] if sure else 0
                joined = "".join(pieces_text)
                sure += [e for e in self.ends(joined[last:stop], last) if e <= limit]
                pieces_text = [joined]
            else:
                del sure[bisect_right(sure, shared) :]
                sure += [e for e in ends[bisect_right(ends, shared) :] if e <= limit]
            whole_to = stop
        whole = "".join(pieces_text)
        return [whole[a:b] for a, b in zip([0, *sure], sure, strict=False)]


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


@lru_cache(maxsize=4)
def _loaded(ranks_path: str, pattern: str) -> ByteBPE:
    return ByteBPE(ranks_path, pattern)


def encode_docs(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, margin: int = MARGIN
) -> DataFrame:
    """One row per input row: ``doc_id, ids binary, decoded binary``.

    The ids are those of the text's pre-tokens in order, without special tokens, packed as
    little-endian unsigned 32-bit integers; ``decoded`` joins their bytes again. A null or empty text has no ids. Texts of any length are
    encoded whole. Repeated rows give repeated results; an empty table gives an empty one;
    other columns are not looked at. ``ranks_path`` has to exist on every executor.
    """
    short, windows = whole_and_windows(docs, id_col, text_col, chunk, margin)
    kind = short.schema["doc_id"].dataType.simpleString()
    schema, own = f"doc_id {kind}, ids binary, decoded binary", f"doc_id {kind}, h long, n int, times long, k int, at int, text string"

    def encode_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(ranks_path, pattern)
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                ids = bpe.encode_texts(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.binary())], ["doc_id", "ids", "decoded"])

    def find_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(ranks_path, pattern)
        for b in batches:
            ends = [bpe.ends(t, at) for t, at in zip(b.column("text").to_pylist(), b.column("at").to_pylist(), strict=True)]
            yield b.append_column("ends", pa.array(ends, pa.list_(pa.int32())))

    def encode_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(ranks_path, pattern)
        for b in batches:
            got = []
            for text, at, begin, stop, ends in zip(*(b.column(c).to_pylist() for c in ("text", "at", "begin", "stop", "ends")), strict=True):
                marks = [begin, *ends[bisect_right(ends, begin) : bisect_right(ends, stop)]]
                got.append(bpe.encode_pieces([text[x - at : y - at] for x, y in zip(marks, marks[1:], strict=False)]))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "h", "n", "times", "k")), pa.array(got, pa.binary()), pa.array(map(bpe.decode, got), pa.binary())],
                ["doc_id", "h", "n", "times", "k", "ids", "decoded"],
            )

    def put_together(group: pd.DataFrame) -> pd.DataFrame:
        runs, times = group.sort_values("k"), int(group["times"].iloc[0])
        row = {"doc_id": group["doc_id"].iloc[0], "ids": b"".join(runs["ids"]), "decoded": b"".join(runs["decoded"])}
        return pd.DataFrame([row] * times)

    def encode_long(group: pd.DataFrame) -> pd.DataFrame:
        bpe = _loaded(ranks_path, pattern)
        parts, times = group.sort_values("k"), int(group["times"].iloc[0])
        pieces = bpe.stitch(int(parts["n"].iloc[0]), [(int(a), t, list(e)) for a, t, e in zip(parts["at"], parts["text"], parts["ends"], strict=True)])
        ids = bpe.encode_pieces(pieces)
        return pd.DataFrame({"doc_id": [group["doc_id"].iloc[0]] * times, "ids": [ids] * times, "decoded": [bpe.decode(ids)] * times})

    ended = table(windows.mapInArrow(find_ends, f"{own}, ends array<int>"), "bpe-windows")  # of long texts only
    # The first boundary that a window, where it's sure, shares with the next one.
    text_key = [F.struct("doc_id").alias("d"), "h", "n"]
    next_at = (F.col("k") + 1) * chunk - margin
    sure = F.filter("ends", lambda e: (e >= next_at) & (e <= F.col("at") + F.char_length("text") - _LOOKAHEAD))
    before = ended.select(*text_key, (F.col("k") + 1).alias("k"), sure.alias("sure"))
    marks = F.concat(F.array("at"), F.filter("ends", lambda e: e <= F.col("at") + 2 * margin))
    heads = ended.filter("k > 0").select(*text_key, "k", marks.alias("marks"))
    shared = heads.join(before, ["d", "h", "n", "k"]).select("d", "h", "n", "k", F.array_min(F.array_intersect("sure", "marks")).alias("p"))
    shared = table(shared, "bpe-boundaries")
    odd = small(table(shared.filter("p is null").select("d", "h", "n").distinct(), "bpe-unstitched"))

    rows = ended.withColumn("d", F.struct("doc_id"))
    stitched, rest = rows.join(odd, ["d", "h", "n"], "left_anti"), rows.join(odd, ["d", "h", "n"], "left_semi")
    begins, stops = small(shared.withColumnRenamed("p", "begin")), small(shared.select("d", "h", "n", (F.col("k") - 1).alias("k"), F.col("p").alias("stop")))
    runs = stitched.join(begins, ["d", "h", "n", "k"], "left").join(stops, ["d", "h", "n", "k"], "left")
    runs = runs.select("doc_id", "h", "n", "times", "k", "at", "text", "ends", F.coalesce("begin", F.lit(0)).alias("begin"), F.coalesce("stop", "n").alias("stop"))
    encoded = runs.mapInArrow(encode_runs, f"doc_id {kind}, h long, n int, times long, k int, ids binary, decoded binary")
    long = encoded.groupBy("doc_id", "h", "n").applyInPandas(put_together, schema).union(rest.groupBy("doc_id", "h", "n").applyInPandas(encode_long, schema))
    return short.mapInArrow(encode_short, schema).union(long)


def digests(encoded: DataFrame, ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of the rows of :func:`encode_docs`; on request the ``ids`` too."""
    n = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return encoded.select("doc_id", n, *(["ids"] if ids else []), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
