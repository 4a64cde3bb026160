"""Token counts of a scored-merge (sentence-piece BPE) model by a compiled transducer.

Of two pieces that stand side by side in an encoding, the encoding of just their text is
those two; and a text has only one sequence of pieces of which all neighbours are so.
Hence the last piece of a prefix follows from the last pieces of shorter prefixes, of
which only those matter from which a longer piece can still come. What matters is a
state, and reading a character leads from it to one other state and changes the count by
a fixed number: a deterministic transducer, compiled as far as the texts need.

A long text is cut into chunks, which tasks map from states to states: for each state
that the chunk may be entered in, the state that it is left in and the change of the
count. Which states these can be follows from the characters before the chunk, by reading
them from every place among them. Maps of neighbours are composed, and the maps that come
of it, in a tree. Should a chunk be entered in a state that its map lacks, the text is
counted as a whole; so counts don't depend on what was expected.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.chunked import CHUNK, whole_and_windows
from corpusforge.runtime import small, table

BLANK = "▁"
_CACHED_UNITS, _CACHED_CHARS, _STATES, _BENEATH, _END = 400_000, 48, 100_000, 32, float("-inf")
#: Characters before a chunk that tell in which states it may be entered, and maps that are composed at once.
CONTEXT, FAN = 64, 64
_PROBE = "  a  b\t c ﬁ Å \n\r\n 中 "


class _Counts(dict[str, int]):
    """Counts of units; those that aren't there are counted and, unless long, kept for a while."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, unit: str) -> int:
        n = self.machine.count_unit(unit)
        if len(unit) <= _CACHED_CHARS:
            if len(self) >= _CACHED_UNITS:
                self.clear()
            self[unit] = n
        return n


class Transducer:
    """Counts the tokens of texts as the model's library does, without special tokens."""

    def __init__(self, model_path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        if model.normalize(_PROBE) != self.normalise(_PROBE):
            raise ValueError("only models that keep texts as they are, with a blank put in front, can be compiled")
        self.score: dict[str, float] = {}
        self.trie: list[dict[str, int]] = [{}]
        self.piece_at: dict[int, str] = {}
        for i in range(model.get_piece_size()):
            if model.is_byte(i) or model.is_control(i) or model.is_unknown(i):
                continue
            if model.is_unused(i):
                raise ValueError("models with unused pieces can't be compiled")
            self._add(model.id_to_piece(i), model.get_score(i))
        resets = not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.score)
        self.units = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+" if resets else "(?s).+")
        self.beneath: list[list[str] | None] = [[] for _ in self.trie]
        for piece in self.score:
            node = 0
            for c in piece:
                if self.beneath[node] is not None:
                    self.beneath[node].append(piece)
                    if len(self.beneath[node]) > _BENEATH:
                        self.beneath[node] = None
                node = self.trie[node][c]
        self.joined = {pair for p in self.score for pair in zip(p, p[1:], strict=False)}
        self._counts = _Counts(self)
        self._derived: dict[str, list[tuple[float, str, str]] | None] = {}
        self._forget()

    def _add(self, piece: str, score: float) -> None:
        self.score[piece], node = score, 0
        for c in piece:
            if c not in self.trie[node]:
                self.trie[node][c] = len(self.trie)
                self.trie.append({})
            node = self.trie[node][c]
        self.piece_at[node] = piece

    def _forget(self) -> None:
        """Back to the first state only: one item (trie node, piece before it, count)."""
        self._states: list[tuple] = [((0, "", 0),)]
        self._numbers = {self._states[0]: 0}
        self._moves: list[dict[str, tuple[int, int]]] = [{}]
        self._as: dict[tuple[int, str], str | None] = {}
        self._fits: dict[tuple[int, str], tuple[str, ...]] = {}
        self._first: dict[tuple[int, tuple[str, ...]], str] = {}

    @staticmethod
    def normalise(text: str) -> str:
        return BLANK + text.replace(" ", BLANK) if text else ""

    def weight(self, piece: str) -> int:
        """Tokens of a piece: bytes if it's a character that the model lacks."""
        return 1 if piece in self.score else len(piece.encode())

    def derived(self, piece: str) -> list[tuple[float, str, str]] | None:
        """The merges that form a piece: score, and first and last part before it; at the end the piece.

        Of adjacent pairs the best score is joined, leftmost first. None if that doesn't end in the piece.
        """
        if piece in self._derived:
            return self._derived[piece]
        parts, steps = list(piece), []
        while len(parts) > 1:
            best = max(((self.score[p], -i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.score), default=None)
            if best is None:
                break
            steps.append((best[0], parts[0], parts[-1]))
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        got = [*steps, (_END, piece, piece)] if len(parts) == 1 else None
        if piece in self.score:
            self._derived[piece] = got
        return got

    def beside(self, left: str, right: str) -> bool:
        """Whether the two pieces can stand side by side.

        Each forms as it does alone until a merge over the place where they meet comes first.
        """
        right_merges = self.derived(right)
        if not left or right_merges is None:
            return right_merges is not None
        left_merges, score, i, j = self.derived(left), self.score, 0, 0
        if left_merges is None:
            return False
        while True:
            in_left, _, last = left_merges[i]
            in_right, first, _ = right_merges[j]
            over = score.get(last + first)
            if over is not None and over > in_left and over >= in_right:
                return False
            if in_left >= in_right:
                if in_left == _END:
                    return True
                i += 1
            else:
                j += 1

    def standing_for(self, node: int, before: str) -> str | None:
        """A piece that the same pieces beneath the node can follow; None if none can. Fewer states come of it."""
        key, below = (node, before), self.beneath[node]
        if below is None:
            return before
        if key not in self._as:
            fit = self._fits[key] = tuple(p for p in below if self.beside(before, p))
            self._as[key] = self._first.setdefault((node, fit), before) if fit else None
        return self._as[key]

    def step(self, state: int, c: str) -> tuple[int, int]:
        """State after a character and change of the count."""
        went, last, change = [], None, 0
        for node, before, count in self._states[state]:
            to = self.trie[node].get(c)
            piece = self.piece_at.get(to) if to is not None else None
            if node == 0 and piece is None:
                piece = c  # not a piece of the model
            if piece is not None and last is None and self.beside(before, piece):
                last, change = piece, count + self.weight(piece)
            if to is not None and self.trie[to] and (before := self.standing_for(to, before)) is not None:
                went.append((to, before, count))
        key = (*((to, before, count - change) for to, before, count in went), (0, last, 0))
        number = self._numbers.get(key)
        if number is None:
            number = self._numbers[key] = len(self._states)
            self._states.append(key)
            self._moves.append({})
        self._moves[state][c] = number, change
        return number, change

    def run(self, unit: str) -> int:
        state = total = 0
        if len(self._states) > _STATES:
            self._forget()
        for c in unit:
            move = self._moves[state].get(c)
            state, change = move if move is not None else self.step(state, c)
            total += change
        return total

    def count_unit(self, unit: str) -> int:
        """A unit is read from the first state again wherever no piece has the two characters that meet."""
        joined = self.joined
        cuts = [i for i, pair in enumerate(zip(unit, unit[1:], strict=False), 1) if pair not in joined]
        if not cuts:
            return self.run(unit)
        parts = [unit[i:j] for i, j in zip([0, *cuts], [*cuts, len(unit)], strict=True)]
        return sum(map(self._counts.__getitem__, parts))

    def count_units(self, units: list[str]) -> int:
        return sum(map(self._counts.__getitem__, units))

    def count(self, text: str) -> int:
        return self.count_units(self.units.findall(self.normalise(text)))

    def named(self, state: int) -> str:
        """The same name for a state in all tasks: pieces that stand for others are named by what they stand for."""
        items = [(node, self._fits.get((node, before), before), count) for node, before, count in self._states[state]]
        return hashlib.md5(repr(items).encode("utf-8", "surrogatepass")).hexdigest()

    def entered_in(self, context: str) -> list[int]:
        """States that a text may be in after these characters, if it was in its first state before one of them; all, if it begins with them."""
        states: dict[int, None] = {}
        for c in context:
            states[0] = None
            states = dict.fromkeys((self._moves[s].get(c) or self.step(s, c))[0] for s in states)
        return list(states)

    def read(self, state: int, text: str) -> tuple[int, int]:
        """State after a text and change of the count."""
        total = 0
        for c in text:
            move = self._moves[state].get(c)
            state, change = move if move is not None else self.step(state, c)
            total += change
        return state, total

    def starts_anew(self, left: str, right: str) -> bool:
        """Whether no piece has these characters side by side: then what is right of the place doesn't depend on what is left of it."""
        return (left, right) not in self.joined

    def chunk_map(self, context: str, chunk: str) -> dict[str, tuple[str, int]]:
        """By name of the state in which a normalised chunk is entered: the state after it and the change of the count.

        ``context``: characters before it, none at the beginning of the text.
        """
        if len(self._states) > _STATES:
            self._forget()
        anew = [i for i in range(1, len(chunk)) if (chunk[i - 1], chunk[i]) not in self.joined]
        entries = self.entered_in(context) if context and not self.starts_anew(context[-1], chunk[0]) else [0]
        if not anew:
            return {self.named(s): (self.named(to), n) for s in entries for to, n in [self.read(s, chunk)]}
        to, tail = self.read(0, chunk[anew[-1] :])
        rest = self.count_units([chunk[i:j] for i, j in zip(anew, anew[1:], strict=False)]) + tail
        return {self.named(s): (self.named(to), n + rest) for s in entries for _, n in [self.read(s, chunk[: anew[0]])]}

    def chunk_maps(self, context: str, chunk: str, following: str) -> dict[str, tuple[str, int]]:
        """As :meth:`chunk_map`; a chunk that the following character starts anew after is left in the first state."""
        found = self.chunk_map(context, chunk)
        if following and self.starts_anew(chunk[-1], following):
            return {s: (self.named(0), n) for s, (_, n) in found.items()}
        return found


def compose(left: dict[str, tuple[str, int]], right: dict[str, tuple[str, int]]) -> dict[str, tuple[str, int]]:
    """The map of two neighbours; entries whose way the right map lacks go."""
    return {s: (right[m][0], n + right[m][1]) for s, (m, n) in left.items() if m in right}


@lru_cache(maxsize=2)
def _loaded(model_path: str) -> Transducer:
    return Transducer(model_path)


def token_counts(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, chunk: int = CHUNK
) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens).

    Counts are those of whole texts. A null or empty text has 0 bytes and 0 tokens. Repeated
    rows give repeated results; an empty table gives an empty one; other columns are not
    looked at. ``model_path`` has to exist on every executor.
    """
    short, windows = whole_and_windows(docs, id_col, text_col, chunk, CONTEXT)
    kind = short.schema["doc_id"].dataType.simpleString()

    def count_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _loaded(model_path)
        for b in batches:
            counts = [machine.count(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    def map_chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = _loaded(model_path)
        for f in frames:
            maps, sizes = [], []
            for k, at, n, text in zip(f["k"], f["at"], f["n"], f["text"], strict=True):
                a, b = int(k) * chunk - int(at), min(int(n), (int(k) + 1) * chunk) - int(at)
                normal = text.replace(" ", BLANK)
                own = BLANK + normal[a:b] if k == 0 else normal[a:b]
                found = machine.chunk_maps(normal[:a] if k else "", own, normal[b : b + 1])
                maps.append([{"enter": s, "leave": to, "n": count} for s, (to, count) in found.items()])
                sizes.append(len(text[a:b].encode()))
            yield f[["doc_id", "h", "n", "times", "k"]].assign(n_bytes=sizes, map=maps)

    def put_together(group: pd.DataFrame) -> pd.DataFrame:
        parts = group.sort_values("k")
        maps = [{x["enter"]: (x["leave"], x["n"]) for x in m} for m in parts["map"]]
        whole = reduce(compose, maps)
        row = parts[["doc_id", "h", "n", "times"]].iloc[0].to_dict() | {"k": int(parts["k"].iloc[0]) // FAN, "n_bytes": int(parts["n_bytes"].sum())}
        return pd.DataFrame([row | {"map": [{"enter": s, "leave": to, "n": c} for s, (to, c) in whole.items()]}])

    def count_whole(group: pd.DataFrame) -> pd.DataFrame:
        machine, first = _loaded(model_path), group.sort_values("k")
        text = "".join(t[int(k) * chunk - int(at) : (int(k) + 1) * chunk - int(at)] for k, at, t in zip(first["k"], first["at"], first["text"], strict=True))
        row = {"doc_id": first["doc_id"].iloc[0], "n_bytes": len(text.encode()), "n_tokens": machine.count(text)}
        return pd.DataFrame([row] * int(first["times"].iloc[0]))

    schema = f"doc_id {kind}, n_bytes long, n_tokens long"
    sized = F.octet_length("text").cast("long").alias("n_bytes")
    counted = short.select("doc_id", "text", sized).mapInArrow(count_short, schema)
    of_map = f"doc_id {kind}, h long, n int, times long, k int, n_bytes long, map array<struct<enter: string, leave: string, n: long>>"
    mapped = table(windows.select("doc_id", "h", "n", "times", "k", "at", "text").mapInPandas(map_chunks, of_map), "token-maps")
    most = mapped.agg(F.max("k")).first()[0]
    while most:  # neighbours by FAN, until one map is left of each text
        mapped = table(mapped.groupBy("doc_id", "h", "n", F.floor(F.col("k") / FAN).alias("up")).applyInPandas(put_together, of_map), "token-maps")
        most //= FAN
    done = mapped.filter(F.size("map") > 0).withColumn("n_tokens", F.col("map")[0]["n"])
    again = F.explode(F.sequence(F.lit(1).cast("long"), "times"))
    odd = small(table(mapped.filter(F.size("map") == 0).select(F.struct("doc_id").alias("d"), "h", "n"), "token-maps-that-break"))
    rest = windows.withColumn("d", F.struct("doc_id")).join(odd, ["d", "h", "n"], "left_semi").groupBy("doc_id", "h", "n").applyInPandas(count_whole, schema)
    counted = counted.union(done.select("doc_id", "n_bytes", "n_tokens", again).select("doc_id", "n_bytes", "n_tokens")).union(rest)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
