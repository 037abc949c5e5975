"""Pieces of every kind keep their text."""

from sentencepiece import sentencepiece_model_pb2 as proto

from quillon.llm import fst
from quillon.llm.spm import NORMAL, USER_DEFINED


def test_user_defined_pieces_have_a_surface():
    with open(fst.VOCABULARY, "rb") as f:
        m = proto.ModelProto.FromString(f.read())
    at = next(i for i, p in enumerate(m.pieces) if p.type == NORMAL and len(p.piece) > 3)
    m.pieces[at].type = USER_DEFINED
    assert fst.Codec(m.SerializeToString()).surface[at] == m.pieces[at].piece.replace("▁", " ").encode()
