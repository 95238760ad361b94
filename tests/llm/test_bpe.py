"""BPE against the public library, and exact round trips."""

import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataq.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal(codec):
    index = codec.index
    assert sorted(index.slot.tolist()) == list(range(len(codec.tokens)))
    assert all(index.get(t) == i for i, t in enumerate(codec.tokens))
    assert index.get(b"no such token \xff") == -1 and bpe.PerfectHash([]).get(b"x") == -1


def test_table(docs, rows, empty, library):
    got = bpe.encode(docs, PATH, public_tokenizers.PATTERN, decoded=True).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    assert sorted((str(r["doc_id"]), tuple(r["ids"]), bytes(r["decoded"])) for r in got) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
    assert bpe.encode(empty, PATH, public_tokenizers.PATTERN).count() == 0


def test_decode(docs, rows):
    back = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert sorted(bytes(r["decoded"]) for r in back) == sorted((t or "").encode() for _, t in rows)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(codec, library, text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    ids = codec.encode(text)
    assert ids.tolist() == library.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_long_words(codec, library):
    r = random.Random(3)
    for alphabet in ("ab", "aeiouthn", "é日🎉a"):
        word = "".join(r.choice(alphabet) for _ in range(3000))
        assert codec.encode(word).tolist() == library.encode_ordinary(word)


def test_round_trip_in_the_workers(docs, rows, spark):
    """The pipeline's stage gets neither texts nor decoded bytes back from the workers; results are those of decoding outside."""
    import corpus_pipeline as p

    whole = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"))
    out = p.encode(spark, whole, "")
    assert "decoded" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = bpe.encode(whole, PATH, public_tokenizers.PATTERN, decoded=True, keep=("doc_id", "text")).collect()
    expected = sorted((str(r["doc_id"]), tuple(r["ids"]), bytes(r["decoded"]) == (r["text"] or "").encode()) for r in want)
    assert sorted((str(r["doc_id"]), tuple(r["ids"]), r["round_trip"]) for r in out.collect()) == expected
    # ids of another vocabulary don't decode to the text: what is compared is real
    assert not bpe.encode(whole.where("doc_id is null"), PATH, r"[a-z]", round_trip=True).first()["round_trip"]
