"""The table of encoded pieces stays within its bound and keeps what comes again; ids do not depend on it."""

import pyarrow as pa

from quarryline.llm import tokens


def test_table_keeps_repeated_pieces():
    encoder, plain = tokens.Encoder(tokens.tokenizer_path()), tokens.Encoder(tokens.tokenizer_path())
    encoder.cached = 60
    common = [f"common{i}" for i in range(10)]
    for step in range(20):
        text = " ".join(["The", "house,", *common, *(f"rare{step}x{i}" for i in range(25)), "end."])
        ids, count = encoder.encode(pa.array([text, None]))
        assert ids.tolist() == plain._encode([text])[0] and count.tolist() == [len(ids), 0]
        assert len(encoder.table.row) <= 60 + 2 * 40
        if step > 1:
            assert {c.encode() for c in common} <= set(encoder.table.row)
    before = set(encoder.table.row)
    kept = encoder.table.repeated()
    assert {c.encode() for c in common} <= set(kept.row) < before
    keys = sorted(kept.row)
    assert all((a == b).all() for a, b in zip(kept.take(keys), encoder.table.take(keys)))


def test_pieces_in_several_calls(monkeypatch):
    encoder, seen = tokens.Encoder(tokens.tokenizer_path()), []
    real = tokens.Encoder._encode
    monkeypatch.setattr(tokens.Encoder, "_encode", lambda self, texts: seen.append(len(texts)) or real(self, texts))
    text = " ".join(f"{i}-{i}" for i in range(5_000))
    ids, _ = encoder.encode(pa.array([text]))
    assert max(seen) <= tokens.PIECES
    assert ids.tolist() == real(encoder, [text])[0]
