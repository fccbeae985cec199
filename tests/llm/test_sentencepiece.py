"""Unigram encoding against the SentencePiece library, brute force and exact round trips."""

import random
from itertools import combinations

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from shoplens.llm import sentencepiece_unigram as unigram

TEXTS = ["", " ", "hello world", "  two  spaces\n\nand lines\t.", "Straße ÉTÉ ñandú 日本語 😀 ▁ marker▁", "x" * 200,
         "a▁b", "\u0000\u0001", " leading", "trailing ", "naïve café" * 30, "\n", "ééé" * 40 + " end"]


@pytest.fixture(scope="module")
def vocabulary():
    return unigram.load()


@pytest.fixture(scope="module")
def library(vocabulary):
    """The same pieces and scores as a unigram model of the library."""
    model = pb.ModelProto()
    model.ParseFromString(open(unigram.MODEL_PATH, "rb").read())
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for i, p in enumerate(model.pieces):
        if p.piece in vocabulary.pieces:
            p.score = vocabulary.pieces[p.piece][1]
            p.type = pb.ModelProto.SentencePiece.NORMAL
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def cost(vocabulary, ids):
    return sum(vocabulary.scores[i] for i in ids if i not in set(vocabulary.byte_ids))


def test_same_as_the_library(vocabulary, library):
    rng = random.Random(1)
    words = ["the", "Und", "être", "niño", "über", "unbelievable", "antidisestablishment", "q", "zzz", "日", "😀é", "3.14", "x=y;"]
    texts = [t for t in TEXTS if "▁" not in t and "\0" not in t]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(200)]
    for text in texts:
        mine, theirs = vocabulary.encode(text), library.encode(text)
        assert mine == theirs or cost(vocabulary, mine) == pytest.approx(cost(vocabulary, theirs), abs=1e-2), text


def test_round_trip(vocabulary):
    for text in TEXTS:
        assert vocabulary.decode(vocabulary.encode(text)) == text


def test_long_chunks_one_by_one_equal_side_by_side(vocabulary):
    words = [w.encode() for w in ("▁hello", "▁Straßenbahn", "日本語😀", "▁", "▁▁▁x", "ééé")]
    ids, counts = vocabulary._abreast(words)
    assert ids.tolist() == [i for w in words for i in vocabulary._alone(w)] and len(counts) == len(words)


def test_best_of_all_spellings():
    pieces = {p: (256 + k, s) for k, (p, s) in enumerate(
        {"a": -2.0, "b": -2.5, "ab": -3.0, "ba": -5.5, "aba": -4.2, "▁": -1.0, "▁a": -2.2, "bb": -4.0}.items())}
    names = [f"<0x{b:02X}>" for b in range(256)] + list(pieces)
    small = unigram.Unigram(pieces, list(range(256)), names)
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice("aab") for _ in range(rng.randrange(1, 9)))
        marked = "▁" + text
        best = max(sum(pieces[p][1] for p in parts) for n in range(len(marked)) for cuts in combinations(range(1, len(marked)), n)
                   for parts in [[marked[i:j] for i, j in zip((0, *cuts), (*cuts, len(marked)))]] if all(p in pieces for p in parts))
        assert sum(small.scores[i] for i in small.encode(text)) == pytest.approx(best)
    assert small.encode("c") == [small.pieces["▁"][0], ord("c")]


def test_columns(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(unigram, "REMEMBERED", 5)
    rows = [(k, t, "old") for k, t in enumerate([*TEXTS, None, "hello world"])]
    df = unigram.encoded(spark.createDataFrame(rows, "doc_id long, text string, pieces string"))
    assert df.columns == ["doc_id", "text", "pieces", "n_pieces", "n_fallback", "restored"]
    for row in df.withColumn("again", unigram.decoded("pieces", spark)).collect():
        assert row.pieces == vocabulary.encode(row.text or "") and row.n_pieces == len(row.pieces)
        assert row.restored and row.again == (row.text or "")
        assert row.n_fallback == sum(i in set(vocabulary.byte_ids) for i in row.pieces)
    assert unigram.encoded(spark.createDataFrame([], "text string")).count() == 0


def test_vocabularies_that_cannot_work():
    with pytest.raises(ValueError):
        unigram.Unigram({"a▁b": (0, 0.0)}, [0] * 256, ["a▁b"])
    with pytest.raises(ValueError):
        unigram.load(scores="other")
