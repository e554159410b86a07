import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from axonframe.llm import maxplus

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    model = sentencepiece.SentencePieceProcessor()
    with open(PATH, "rb") as f:
        model.load_from_serialized_proto(f.read() + maxplus.AS_UNIGRAM)
    return model


def texts():
    # the library adds scores as 32-bit floats, so that sums below -2 ** 24 lose digits there
    rng = random.Random(3)
    words = "the and of encoding transfer matrices naïve résumé boundary-state éclair Über".split(" ")
    return [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 5, 60, 150)] + ["", "a", "qqqqqqqqqqqqqqqqqqqqqqqqqqqq", "x\ny", "\U0001f642"]


def test_equals_the_library(spark, library):
    rows = list(enumerate([*texts(), None]))
    got = {r.key: r.ids for r in maxplus.encode_giant(spark.createDataFrame(rows, "key long, text string"), PATH, True, chunk=37).collect()}
    exact = 0
    for k, t in rows:
        best = library.nbest_encode(t, nbest_size=1)[0] if t else []  # its lattice search; the one-best encoder of the library takes "the" over the better "t" + "he"
        assert "".join(map(library.id_to_piece, got[k])) == "".join(map(library.id_to_piece, best))
        own, theirs = (sum(map(library.get_score, x)) for x in (got[k], best))
        assert own >= theirs or t == "x\ny"  # a byte's score is not the unknown character's
        exact += own == theirs > -(1 << 24)
    assert exact >= 5


def test_matrices_combine_associatively():
    vocabulary = maxplus.vocabulary_of(PATH, True)
    text = "▁" + texts()[2].replace(" ", "▁")
    cut = [0, 50, 90, 140, len(text)]
    parts = [maxplus.transfer(vocabulary, text[a : b + vocabulary.reach], b - a) for a, b in zip(cut, cut[1:])]
    a, b, c, d = parts
    left = maxplus.combine(maxplus.combine(maxplus.combine(a, b), c), d)
    assert np.array_equal(left, maxplus.combine(a, maxplus.combine(b, maxplus.combine(c, d))))
    assert left[0, 0] == maxplus.transfer(vocabulary, text, len(text))[0, 0]
