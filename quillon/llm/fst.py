"""SentencePiece encoding and decoding as shortest paths through weighted transducers.

Three transducers are compiled from a model.

* ``Normaliser`` rewrites characters: the model's character map and user-defined symbols as a trie that takes the longest
  match, then a machine over spaces (dummy prefix, squeezing, the space mark).  It is sequential, so composing it with a
  text gives one path, its normal form.
* ``Pieces`` maps characters to pieces: a trie whose ends lead back to its root, with arcs for characters that no piece
  covers (byte fallback or unknown).  An arc weighs its piece's negated score; user-defined symbols weigh less than all else.
* ``Merges`` stands behind ``Pieces`` for a merge (BPE) model.  Its states are pieces; it weighs a pair of neighbours 0 if
  merging the two pieces' text from its characters gives just those two, and infinity otherwise.  The encoding is the
  only path of finite weight.

A normal form, cut where no piece can reach over, is composed with the pieces and, for a merge model, the merges.  States
of the composition are made as they are reached, in the order of their position, which is a topological order, so one
pass relaxes all arcs: the tropical shortest path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table
from .lattice import REMEMBERED
from .normaliser import Normaliser, Trie
from .spm import BPE, BYTE, CHAR, NORMAL, SPACE, UNIGRAM, UNUSED, USER_DEFINED, WORD, Model, load
from .tokencount import UNKNOWN_PENALTY, VOCABULARY

NEVER = float("inf")


class Merges:
    """The transducer behind a merge model's pieces: which neighbours are stable under the model's merges."""

    def __init__(self, model: Model, vocabulary: dict[str, int]):
        self.model, self.vocabulary = model, vocabulary
        self.trees: dict[int, tuple[str, str] | None | bool] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.spines: dict[tuple[int, bool], list[tuple[str, float]] | None] = {}

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Merge from characters, best score first and leftmost of equals; also the last pair merged."""
        parts, last = list(text), None
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                ident = self.vocabulary.get(parts[i] + parts[i + 1])
                if ident is not None and (best is None or self.model.scores[ident] > best):
                    best, at = self.model.scores[ident], i
            if at < 0:
                break
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, last

    def reachable(self, ident: int) -> bool:
        """Whether merging a piece's characters gives the piece; others never occur."""
        if ident not in self.trees:
            piece = self.model.pieces[ident]
            parts, last = self.merge(piece)
            self.trees[ident] = False if len(parts) > 1 else last
        return self.trees[ident] is not False

    def spine(self, ident: int, right: bool) -> list[tuple[str, float]] | None:
        """The pieces along a piece's right or left edge, innermost first, with the score of the merge that made each.

        None if a part has no better score than the whole: merges then don't happen in the order of their scores.
        """
        key = (ident, right)
        if key not in self.spines:
            out, piece = [], self.model.pieces[ident]
            score = float("-inf")
            while True:
                own = self.model.scores[self.vocabulary[piece]]
                if len(piece) == 1:
                    out.append((piece, NEVER))
                    break
                if own <= score:
                    out = None
                    break
                score = own
                out.append((piece, own))
                self.reachable(self.vocabulary[piece])
                tree = self.trees[self.vocabulary[piece]]
                if not tree or not self.ordered(self.vocabulary[piece]):
                    out = None
                    break
                piece = tree[1] if right else tree[0]
                if piece not in self.vocabulary:  # a character without a piece of its own
                    out.append((piece, NEVER))
                    break
            self.spines[key] = out[::-1] if out else None
        return self.spines[key]

    def ordered(self, ident: int) -> bool:
        """Whether both parts of a piece were made by better merges than the piece itself."""
        left, right = self.trees[ident]
        return all(len(p) == 1 or self.model.scores[self.vocabulary[p]] > self.model.scores[ident] for p in (left, right))

    def stable(self, left: int, right: int) -> bool:
        key = (left, right)
        out = self.pairs.get(key)
        if out is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            out = self.pairs[key] = self._stable(left, right)
        return out

    def _stable(self, left: int, right: int) -> bool:
        xs, ys = self.spine(left, True), self.spine(right, False)
        if xs is None or ys is None:
            pieces = self.model.pieces
            return self.merge(pieces[left] + pieces[right])[0] == [pieces[left], pieces[right]]
        # both edges grow in the order of their merges' scores; a merge across must not come before the next growth
        i = j = 0
        while True:
            across = self.vocabulary.get(xs[i][0] + ys[j][0])
            next_x = xs[i + 1][1] if i + 1 < len(xs) else float("-inf")
            next_y = ys[j + 1][1] if j + 1 < len(ys) else float("-inf")
            if across is not None:
                s = self.model.scores[across]
                if s > next_x and s >= next_y:
                    return False
            if next_x == next_y == float("-inf"):
                return True
            if next_x >= next_y:
                i += 1
            else:
                j += 1

    def loose(self, char: str, right: int) -> bool:
        """Whether a character without a piece stays apart from the piece behind it."""
        return self.merge(char + self.model.pieces[right])[0] == [char, self.model.pieces[right]]


class Codec:
    """Encoder and decoder of one model: its compiled transducers, and their composition with a text."""

    def __init__(self, data: bytes):
        self.model = model = load(data)
        if model.model_type not in (UNIGRAM, BPE, WORD, CHAR):
            raise ValueError(f"unknown model type {model.model_type}")
        self.normalise = Normaliser(model)
        merging = model.model_type == BPE
        vocabulary = model.of_kind(NORMAL, USER_DEFINED, UNUSED) if merging else model.normal()
        if model.model_type == CHAR:
            vocabulary = {p: i for p, i in vocabulary.items() if len(p) == 1 or model.kinds[i] == USER_DEFINED}
        self.vocabulary = vocabulary
        self.trie = Trie(vocabulary)
        self.merges = Merges(model, vocabulary) if merging else None
        self.byte_ids = model.byte_ids()
        scores = [s for s, k in zip(model.scores, model.kinds, strict=True) if k == NORMAL] or [0.0]
        self.fall = UNKNOWN_PENALTY - min(scores)
        best = max(scores)
        #: Weight of each piece's arc; a user-defined symbol weighs less than any other way through its text.
        self.weights = [0.1 - best * len(p.encode()) if k == USER_DEFINED else -s for p, s, k in zip(model.pieces, model.scores, model.kinds, strict=True)]
        self.surface = [p.replace(SPACE, " ").encode() if k in (NORMAL, USER_DEFINED, UNUSED) else b"" for p, k in zip(model.pieces, model.kinds, strict=True)]
        for b, i in self.byte_ids.items():
            self.surface[i] = bytes([b])
        self.surface[model.unknown] = model.unknown_surface.encode()
        self.known: dict[str, bytes] = {}
        self.cut = self._cuts()

    def _cuts(self) -> re.Pattern | None:
        """Runs of a normal form that no piece reaches over: a word with the spaces before it, or alone a character in no longer piece; None if there are none."""
        mark = self.normalise.mark
        if self.model.model_type == WORD:
            return re.compile(f"[^{mark}]*{mark}|[^{mark}]+" if self.model.space_as_suffix else f"{mark}?[^{mark}]+|{mark}")
        user = sorted((p for p in self.vocabulary if self.model.kinds[self.vocabulary[p]] == USER_DEFINED), key=len, reverse=True)
        if any(mark in p.lstrip(mark) for p in self.vocabulary):
            if not user or self.merges is None:
                return None
        inside = {c for p in self.vocabulary for c in p}
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in inside)
        if user and self.merges is not None:  # cut out first, longest first; the rest is not cut otherwise
            whole = "|".join(map(re.escape, user))
            return re.compile(f"{whole}|(?:(?!{whole}).)+", re.DOTALL)
        if user:
            return None
        return re.compile(f"[{alone}]|{mark}*[^{mark}{alone}]+|{mark}+" if alone else f"{mark}*[^{mark}]+|{mark}+")

    def fallback(self, char: str) -> list[int]:
        """Pieces of a character that has none of its own."""
        if not self.byte_ids:
            return [self.model.unknown]
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]

    def shortest_path(self, unit: str) -> list[tuple[int, int]]:
        """The tropical shortest path through the unit composed with the transducers: (start, piece) of each arc, -1 for fallback.

        ``back[i]`` is the last arc of the best path to position i, so also its state in ``Merges``; of a merge model's
        paths to a position only one has a finite weight.  Ties stay with the arc that starts first.
        """
        n, trie, end, weights, merges = len(unit), self.trie.arcs, self.trie.end, self.weights, self.merges
        back: list = [None] * (n + 1)
        if merges is not None:
            pairs, stable, trees, reachable = merges.pairs, merges.stable, merges.trees, merges.reachable
            for at in range(n):
                if at and back[at] is None:
                    continue
                last = back[at][1] if at else -2
                state, to, single = 0, at, False
                while to < n:
                    state = trie[state].get(unit[to])
                    if state is None:
                        break
                    to += 1
                    ident = end[state]
                    if ident is None:
                        continue
                    single = single or to == at + 1
                    if back[to] is not None:
                        continue
                    if last >= 0:
                        ok = pairs.get((last, ident))
                        if ok is None:
                            ok = stable(last, ident)
                    else:
                        ok = last == -2 or merges.loose(unit[at - 1], ident)
                    if ok and (trees[ident] is not False if ident in trees else reachable(ident)):
                        back[to] = (at, ident)
                if not single and back[at + 1] is None and (last < 0 or merges.merge(self.model.pieces[last] + unit[at])[0] == [self.model.pieces[last], unit[at]]):
                    back[at + 1] = (at, -1)
        else:
            weight = [0.0] + [NEVER] * n
            for at in range(n):
                here = weight[at]
                state, to, single = 0, at, False
                while to < n:
                    state = trie[state].get(unit[to])
                    if state is None:
                        break
                    to += 1
                    ident = end[state]
                    if ident is not None:
                        single = single or to == at + 1
                        w = here + weights[ident]
                        if w < weight[to]:
                            weight[to], back[to] = w, (at, ident)
                if not single and here + self.fall < weight[at + 1]:
                    weight[at + 1], back[at + 1] = here + self.fall, (at, -1)
        path, at = [], n
        while at:
            path.append(back[at])
            at = back[at][0]
        return path[::-1]

    def expanded(self, ident: int) -> list[int]:
        """A merge model's unused piece as the pieces it was merged from; other pieces as they are."""
        if self.merges is None or self.model.kinds[ident] != UNUSED or not self.merges.reachable(ident) or not self.merges.trees[ident]:
            return [ident]
        return [x for p in self.merges.trees[ident] for x in (self.expanded(self.vocabulary[p]) if p in self.vocabulary else self.fallback(p))]

    def pieces_of(self, unit: str) -> list[int]:
        ident = self.vocabulary.get(unit, -1)
        if self.model.model_type == WORD:
            return [ident] if ident >= 0 else ([self.byte_ids[b] for b in unit.encode()] if self.byte_ids else [self.model.unknown])
        if ident >= 0 and self.model.kinds[ident] == USER_DEFINED and self.merges is not None:
            return [ident]
        out = []
        for at, ident in self.shortest_path(unit):
            out += self.expanded(ident) if ident >= 0 else self.fallback(unit[at])
        return out

    def encode(self, text: str | None) -> np.ndarray:
        known, out = self.known, []
        normal = self.normalise(text or "")
        for unit in self.cut.findall(normal) if self.cut else [normal] if normal else []:
            ids = known.get(unit)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = np.array(self.pieces_of(unit), dtype=np.int32).tobytes()
                if len(unit) < 1024:
                    known[unit] = ids
            out.append(ids)
        ids = np.frombuffer(b"".join(out), dtype=np.int32)
        if not self.byte_ids:  # neighbouring unknown characters are one piece
            unknown = ids == self.model.unknown
            ids = ids[~(unknown & np.r_[False, unknown[:-1]])]
        return ids

    def decode(self, ids) -> str:
        """The text of a sequence of ids: the inverse transducer, a map from pieces to bytes."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        model = self.model
        if model.space_as_suffix:
            raw = raw[:-1] if model.dummy_prefix and raw[-1:] == b" " else raw
        elif model.dummy_prefix or model.squeeze_spaces:
            first = next((i for i in ids if self.surface[i]), None)
            if first is not None and model.kinds[first] != BYTE and first != model.unknown and raw[:1] == b" ":
                raw = raw.lstrip(b" ") if model.squeeze_spaces else raw[1:]
        return raw.decode("utf-8", "replace")


_CODECS: dict[int, Codec] = {}


def codec_of(data: bytes) -> Codec:
    """The worker's codec for a model, compiled once."""
    key = hash(data)
    if key not in _CODECS:
        _CODECS[key] = Codec(data)
    return _CODECS[key]


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode it again: id, ``ids`` array<int>, ``n_pieces`` int, ``round_trip`` boolean.

    Null and empty texts give no pieces.  ``round_trip`` is whether the decoded text equals the text; a text
    that holds the model's space mark itself comes back with spaces.  Texts of any length are encoded whole, unit by
    unit.  Repeated rows and null ids are rows like others; an empty table gives none.  Other columns are not read,
    whatever their names.  The model (a file's bytes) is broadcast; its size is that of the file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = [codec.encode(t) for t in texts]
                same = [codec.decode(i.tolist()) == t for i, t in zip(ids, texts, strict=True)]
                sizes = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
                values = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
                lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(sizes)].astype(np.int32), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(sizes), pa.array(same)], names=["id", "ids", "n_pieces", "round_trip"])

    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = some.mapInArrow(run, f"id {some.schema['id'].dataType.simpleString()}, ids array<int>, n_pieces int, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of encoded rows: id, ``text``; null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for batch in batches:
            texts = [None if i is None else codec.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    some = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return some.mapInArrow(run, f"id {some.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` encoded with the public 32k model and decoded again."""
    with open(VOCABULARY, "rb") as f:
        data = f.read()
    return encode(read_table(spark, sf_dir, "documents"), data)
