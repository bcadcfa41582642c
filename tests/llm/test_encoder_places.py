"""New words take their places in the table without a second look at all known ones."""

import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers

from basketry.llm.encoder import ColumnEncoder


def test_learned_pieces_tell_their_places(monkeypatch):
    own = ColumnEncoder(public_tokenizers.path("word_bpe_49k.json"))
    own.numbers(pa.array(["alpha", "beta"]))
    looked, index_in = [], pc.index_in
    monkeypatch.setattr(pc, "index_in", lambda *a, **k: looked.append(a) or index_in(*a, **k))
    pieces = ["x1", "beta", "gamma", "alpha", "é?", "delta"]
    places = own.numbers(pa.array(pieces))
    assert [own.known[int(k)].as_py() for k in places] == pieces and len(looked) == 1
    want = [own.tokenizer.encode(p, add_special_tokens=False).ids for p in pieces]
    assert [own.flat[own.at[k] : own.at[k] + own.n[k]].tolist() for k in places] == want
