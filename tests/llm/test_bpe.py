"""Byte-level BPE: against the tokenizer library."""

import random
import sys

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from affinity.llm import bpe, bpe_scan

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
CODEC = bpe_scan.Codec(RANKS, bpe.code_point_classes())
OWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def same(texts):
    done = CODEC.encode(texts)
    assert [np.frombuffer(i, "<u4").tolist() for i, _ in done] == [OWN.encode_ordinary(t) for t in texts]
    assert [CODEC.decode(i).decode() for i, _ in done] == texts


def test_cases():
    same(["", " ", "  ", "a", "it's we're I'LL 'sabc ''s 's", " 's  't \n'm\n\n x　y", "a\n", "a \n b\t\tc ", "\0a\0", "<|endoftext|>", "é́  x 12½ Ⅷ", "x" * 3000, "ab " * 2000, "!'s?'ll 'l", "don'", "'", "'r", "  a", "🙂🙂 🙂"])


def test_random():
    rng = random.Random(7)
    alphabet = list("'srtlemd  \n\t1a.é  ñ漢🙂\0")
    same(["".join(rng.choices(alphabet, k=rng.randrange(700))) for _ in range(400)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_any_text(texts):
    same(texts)


def test_dataframe(spark):
    rows = [(1, "It's a test", "x"), (2, None, "y"), (3, "", "z"), (1, "It's a test", "x"), (None, "end \n", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    encoded = bpe.encode(docs, PATH)
    assert sorted(map(str, [r.text for r in bpe.decode(encoded, PATH).collect()])) == sorted(t or "" for _, t, _ in rows)
    got = bpe.digests(docs, PATH)
    assert got.columns == ["doc_id", "n_tokens", "n_pieces", "ids_sha256", "decoded_sha256"]
    assert sorted(r.n_tokens for r in got.collect()) == sorted(len(OWN.encode_ordinary(t or "")) for _, t, _ in rows)
    assert bpe.digests(docs.limit(0), PATH).count() == 0
    assert sys.byteorder == "little"
