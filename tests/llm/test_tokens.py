import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rankweave.llm.splitting import split_documents, split_text
from rankweave.llm.tokens import MinimalPerfectHash, encoded, encoder, token_counts, vocabulary_path

PATH = vocabulary_path("byte_bpe_50k")
ENC = encoder(PATH)
REF = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
REF.encode_special_tokens = True
HARD = ["", " ", "a" * 3000, " " * 999 + "x", "日本語" * 500, "<|endoftext|>", "\n\n a\n", "é́\U0001f600" * 20, "don't we'll I'm", "\x00�", "aaaaab" * 200]


def ref(t):
    return REF.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("t", HARD)
def test_hard_texts(t):
    assert ENC.encode_batch([t])[0] == ref(t)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(t):
    assert ENC.encode_batch([t])[0] == ref(t)


def test_perfect_hash():
    assert ENC.hash.lookup(ENC.keys).tolist() == list(range(len(ENC.keys)))  # every key has a place of its own
    h = MinimalPerfectHash([b"a", b"b"])
    assert sorted(h.at.tolist()) == [0, 1]
    assert max(h.lookup([b"zz", b"q"])) < 2


def test_column(spark):
    df = spark.createDataFrame([(1, "Hi there", "x"), (2, None, "x"), (3, "", "x"), (4, "Hi there", "x")], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encoded(df, "doc_id", "text", PATH).collect()}
    assert got == {1: ref("Hi there"), 2: [], 3: [], 4: ref("Hi there")}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(df, ["doc_id"], "text", PATH).collect()} == {1: 2, 2: 0, 3: 0, 4: 2}
    assert encoded(df.limit(0), "doc_id", "text", PATH).count() == 0


TOPICS = ["The battery lasts long. It charges fast. Charging the battery takes an hour. ", "The price is fair. You pay each month. The price may change. "]
LONG = {
    "topics": "\n\n".join(TOPICS[i % 2] * 12 for i in range(8)), "one line": "word " * 4000, "no space": "x1Y" * 4000, "cjk": "这是一个很长的句子没有任何标点" * 300, "emoji": "\U0001f600\U0001f680" * 2000, "lines": "\n".join(f"row {i}" for i in range(3000)), "blank": "\n" * 5000 + "end",
}


def fits(text, limit, overlap):
    ids = ENC.encode_batch([text])[0]
    pieces = split_text(text, ENC, limit, overlap)
    assert bool(pieces) == (len(ids) > limit)
    if pieces:
        assert pieces[0][0] == 0 and pieces[-1][1] == len(ids)
    for a, b, _, _ in pieces:
        assert 0 < b - a <= limit
    for (start, end, _, _), (later, *_rest) in zip(pieces, pieces[1:]):
        assert start < later and overlap <= end - later <= overlap + 3
    return ids, pieces


@pytest.mark.parametrize("name", LONG)
@pytest.mark.parametrize(("limit", "overlap"), [(256, 16), (100, 0), (64, 40), (100, 80)])
def test_pieces_cover_and_fit(name, limit, overlap):
    ids, pieces = fits(LONG[name], limit, overlap)
    for a, b, piece, _ in pieces:
        assert piece.encode() == b"".join(ENC.bytes_of[t] for t in ids[a:b])  # whole characters


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_any_limit_ends(data):
    limit = data.draw(st.integers(1, 64))
    overlap = data.draw(st.integers(0, limit - 1))
    text = data.draw(st.text(alphabet="ab .\n語漢字\U0001f600\U0001f469\u200dé", max_size=150))
    fits(text, limit, overlap)


def test_hard_limits():
    for limit, overlap in ((1, 0), (3, 0), (4, 1), (8, 2), (8, 7)):
        for text in ("\U0001f9ff\U0001fad8" * 30, "龘靐齉" * 30, "a b. " * 30):
            fits(text, limit, overlap)
    for limit, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError, match="limit"):
            split_text("one two three", ENC, limit, overlap)


def test_cut_at_topic_changes():
    text = LONG["topics"]
    pieces = split_text(text, ENC, 400, 0)
    assert all(cut >= 1 for *_, cut in pieces)
    assert sum(cut >= 2 for *_, cut in pieces[:-1]) >= len(pieces) // 2  # most at paragraphs


def test_within_limit_and_column(spark):
    assert split_text("short text", ENC, 10, 2) == []
    df = spark.createDataFrame([(1, "word " * 300), (2, None), (3, ""), (4, "short")], "doc_id long, text string")
    d = split_documents(df, "doc_id", "text", PATH, 100, 10)
    assert {r["doc_id"] for r in d.collect()} == {1}
    assert split_documents(df, "doc_id", "text", PATH, None, None).count() == 0
    assert split_documents(df.limit(0), "doc_id", "text", PATH, 100, 10).count() == 0
