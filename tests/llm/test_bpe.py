"""Byte-level BPE against the tokenizer library itself, and the round trip."""

import base64
import random

import public_tokenizers as P
import pytest
import tiktoken

from cytolake.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def known(spark):
    return bpe.vocabulary(spark, PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library(known):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=known.ranks, special_tokens={})


def hard_texts():
    r = random.Random(2)
    yield from ("", " ", "a", "\n\n  x", "<|endoftext|> don't I'LL", "é日本՘֋ x\U000107bb9", "\x00\x1c\x85  ", "-" * 300 + " " * 4000 + "x")
    yield from ("ab" * 3000, "a" * 5000, "abc" * 700 + "xyz", "".join(r.choice("ab") for _ in range(50_000)), "".join(r.choice("abcdeé日") for _ in range(4000)))
    yield "".join(chr(r.randrange(0x20, 0xD7FF)) for _ in range(5000))
    yield "".join(chr(r.randrange(0x10000, 0x110000)) for _ in range(5000))
    yield from ("".join(r.choice("aehnrst") for _ in range(r.randint(1, 60))) for _ in range(500))
    yield "long " * 200_000 + "x" * 1_000_000


def test_ids_are_those_of_the_library(known, library):
    texts = list(hard_texts())
    flat, n = bpe.encode_texts(texts, known, bpe.Splitter(known))
    at = 0
    for text, k in zip(texts, n.tolist(), strict=True):
        assert flat[at : at + k].tolist() == library.encode_ordinary(text), text[:50]
        at += k


def test_short_and_long_queues_agree(known):
    r = random.Random(3)
    words = ["".join(r.choice("abéno ") for _ in range(r.randint(1, 90))).encode() for _ in range(400)]
    flat, n = bpe.merge_all(words, known)
    at = 0
    for w, k in zip(words, n.tolist(), strict=True):
        assert flat[at : at + k].tolist() == bpe.merge_one(w, known)
        at += k


def test_tokens_made_earlier_than_their_parts(spark, tmp_path):
    """Ranks that no training gives: a merge may open a lower bucket, so of equal pairs only the leftmost is merged at once."""
    r = random.Random(4)
    for _ in range(30):
        tokens = [bytes([i]) for i in range(256)]
        more = sorted({"".join(r.choice("ab") for _ in range(r.randint(2, 5))).encode() for _ in range(12)})
        r.shuffle(more)
        file = tmp_path / "ranks"
        file.write_bytes(b"".join(base64.b64encode(t) + f" {i}\n".encode() for i, t in enumerate(tokens + more)))
        v = bpe.vocabulary(spark, str(file), r"\p{L}+")
        library = tiktoken.Encoding("own", pat_str=r"\p{L}+", mergeable_ranks=v.ranks, special_tokens={})
        texts = ["".join(r.choice("ab") for _ in range(r.randint(1, 60))) for _ in range(40)]
        flat, n = bpe.encode_texts(texts, v, bpe.Splitter(v))
        assert flat.tolist() == [i for t in texts for i in library.encode_ordinary(t)]
        for t in texts:  # a word with a rank of its own isn't merged
            assert t.encode() in v.ranks or bpe.merge_one(t.encode(), v) == library.encode_ordinary(t)
        assert n.tolist() == [len(library.encode_ordinary(t)) for t in texts]


def test_vocabulary_by_a_path_that_spark_reads(spark, known):
    far = bpe.vocabulary(spark, f"file://{PATH}", P.PATTERN)
    assert far.ranks == known.ranks and (far.pair_keys == known.pair_keys).all()


def test_whole_tables_and_the_way_back(hard, known, library):
    out = bpe.decode(bpe.encode(hard, known), known)
    assert out.columns == [*hard.columns, "ids", "decoded"]
    got = sorted(((r["doc_id"] or -1, r["text"] or "", r["ids"], bytes(r["decoded"])) for r in out.collect()), key=str)
    want = sorted(((r["doc_id"] or -1, r["text"] or "", library.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in hard.collect()), key=str)
    assert got == want


def test_clashing_names_and_empty_tables(spark, empty, known):
    rows = spark.createDataFrame([("x", "some text", 1), (None, None, 2)], "ids string, text string, decoded int")
    out = bpe.decode(bpe.encode(rows, known), known)
    assert out.columns == ["text", "ids", "decoded"] and {bytes(r["decoded"]) for r in out.collect()} == {b"some text", b""}
    assert bpe.decode(bpe.encode(empty, known), known).count() == 0


def test_unknown_ids_and_bytes_are_errors(spark, known, tmp_path):
    with pytest.raises(Exception, match="no rank"):
        bpe.decode(spark.createDataFrame([([999_999],)], "ids array<int>"), known).collect()
    (tmp_path / "few").write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError, match="every byte"):
        bpe.vocabulary(spark, str(tmp_path / "few"), P.PATTERN)
