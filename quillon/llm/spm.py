"""What a SentencePiece model file holds, read without the library: pieces, scores, kinds and normaliser settings."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Fixed values of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE, WORD, CHAR = 1, 2, 3, 4
SPACE = "▁"


@dataclass(frozen=True)
class Model:
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    model_type: int
    normaliser: str
    charsmap: bytes
    dummy_prefix: bool
    squeeze_spaces: bool
    escape_spaces: bool
    space_as_suffix: bool = False
    unknown_surface: str = " ⁇ "

    @property
    def unknown(self) -> int:
        return self.kinds.index(UNKNOWN)

    def byte_ids(self) -> dict[int, int]:
        """Id of each byte's piece; empty if the model has no byte fallback."""
        return {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}

    def of_kind(self, *kinds: int) -> dict[str, int]:
        return {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in kinds}

    def normal(self) -> dict[str, int]:
        return self.of_kind(NORMAL, USER_DEFINED)


@lru_cache(maxsize=4)
def load(data: bytes) -> Model:
    """Parse a model file's bytes."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.ParseFromString(data)
    n, t = m.normalizer_spec, m.trainer_spec
    return Model(
        tuple(p.piece for p in m.pieces), tuple(p.score for p in m.pieces), tuple(p.type for p in m.pieces), t.model_type,
        n.name, n.precompiled_charsmap, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces, t.treat_whitespace_as_suffix, t.unk_surface,
    )


def changed(data: bytes, **fields) -> bytes:
    """The model file with some settings changed: ``model_type``, ``charsmap``, ``squeeze`` or ``kinds`` (piece to kind)."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.ParseFromString(data)
    m.trainer_spec.model_type = fields.get("model_type", m.trainer_spec.model_type)
    m.normalizer_spec.precompiled_charsmap = fields.get("charsmap", m.normalizer_spec.precompiled_charsmap)
    m.normalizer_spec.remove_extra_whitespaces = fields.get("squeeze", m.normalizer_spec.remove_extra_whitespaces)
    kinds = dict(fields.get("kinds", {}))
    for p in m.pieces:
        p.type = kinds.pop(p.piece, p.type)
    for piece, kind in kinds.items():
        m.pieces.add(piece=piece, score=0.0, type=kind)
    return m.SerializeToString()


def as_unigram(data: bytes) -> bytes:
    """The same vocabulary and scores as a unigram model file, as the library reads it: a reference for tests."""
    return changed(data, model_type=UNIGRAM)


def read_charsmap(data: bytes) -> dict[str, str]:
    """The rewriting rules of a compiled character map: a double-array trie over UTF-8, then texts that end in a zero byte.

    A unit of the trie holds a label (8 bits and the leaf mark, bit 31), whether a leaf follows (bit 8) and the offset to
    its children (from bit 10, shifted by 8 more if bit 9 is set); a leaf's low 31 bits are its value, a place among the texts.
    """
    if not data:
        return {}
    (size,) = struct.unpack_from("<I", data)
    units, texts = np.frombuffer(data, dtype="<u4", count=size // 4, offset=4), data[4 + size :]
    below = np.arange(len(units)) ^ ((units >> 10) << ((units & 512) >> 6)).astype(np.int64)
    bytes_, rules = np.arange(1, 256), {}
    base, keys = below[:1], [b""]
    while len(keys):  # one level of the trie after the other
        at = base[:, None] ^ bytes_
        inside = at < len(units)
        at[~inside] = 0
        row, col = np.nonzero(inside & (units[at] & 0x800000FF == bytes_))
        at = at[row, col]
        keys = [keys[r] + bytes([c + 1]) for r, c in zip(row.tolist(), col.tolist(), strict=True)]
        base = below[at]
        leaf = units[at] & 256 != 0
        for i in np.flatnonzero(leaf).tolist():
            start = int(units[base[i]]) & 0x7FFFFFFF
            rules[keys[i].decode()] = texts[start : texts.index(b"\0", start)].decode()
    return rules
