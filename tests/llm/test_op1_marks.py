"""Pieces whose letters the normalizer turns into marks, before punctuation, against the library."""

import random

import numpy as np
import pyarrow as pa

from quarryline.llm import tokens


def test_marks_before_punctuation():
    encoder = tokens.Encoder(tokens.tokenizer_path())
    assert encoder.by_word
    known = ["İ.", "क़.", "יִ;", "aक़,", "İİ!?", "aİ", "abc.,", "É.", "É.", "İ", "ß|", ".", "..İ..", "ﬁ.", "Σ.", "ΑΣ,"]
    rng = random.Random(12)
    letters = ["İ", "क़", "ख़", "יִ", "שׁ", "É", "ß", "a", "B", "z", "é", "न", "ि", "1", "'s", "中", "ǆ", "ﬃ", "ͅ", "ΐ"]
    texts = list(known)
    for _ in range(4000):
        texts.append(" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) + "".join(rng.choice(".,;:!?|-") for _ in range(rng.randrange(0, 3))) for _ in range(rng.randrange(1, 4))))
    for i in range(0, len(texts), 500):
        part = texts[i : i + 500]
        ids, n = encoder.encode(pa.array(part, pa.string()))
        ends = np.cumsum(n)
        for t, a, b in zip(part, (ends - n).tolist(), ends.tolist()):
            assert ids[a:b].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids, t
