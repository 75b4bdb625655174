import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.llm import bpe, queries
from tests.llm.conftest import ODD, by_id

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
CODER = bpe.ByteBPE(RANKS, public_tokenizers.PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab 's\n\t  .é漢😀0'\x1c\x85\xa0_-TrevEVmldx")), max_size=60))
def test_same_ids_and_round_trip(text):
    [raw] = CODER.encode([text])
    assert ids(raw) == REFERENCE.encode_ordinary(text)
    assert CODER.decode(np.frombuffer(raw, "<u4")) == text.encode()


@pytest.mark.parametrize("text", ["x" * 3000, "ab" * 700, " " * 900, "the" * 300 + " end", "é" * 400])
def test_long_pieces(text):
    assert ids(CODER.encode([text])[0]) == REFERENCE.encode_ordinary(text)


def test_matrix_and_heap_agree():
    rnd = random.Random(2)
    pieces = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 120))).encode() for _ in range(300)]
    assert CODER.encode_distinct(pieces) == [RANKS[p].to_bytes(4, "little") if p in RANKS else CODER._by_heap(p) for p in pieces]


def test_pair_table_finds_all_and_only_its_pairs():
    left, right = np.arange(5000) % 71, np.arange(5000)
    table = bpe.PairTable(left, right, np.arange(5000))
    assert (table.find(left, right) == np.arange(5000)).all()
    assert (table.find(left + 100, right) == bpe.NONE).all()


def test_chunks_join_to_the_text():
    for text in ("a b", " a", "a ", "a  b", "a \n b c", "\n"):
        assert "".join(bpe.split_chunks(text)) == text


def test_odd_rows(odd, empty):
    args = (PATH, public_tokenizers.PATTERN)
    rows = by_id(bpe.decode(bpe.encode(odd, *args), *args))
    for doc_id, text, *_ in ODD:
        want = REFERENCE.encode_ordinary(text or "")
        assert ids(rows[doc_id]["ids"]) == want and rows[doc_id]["n_tokens"] == len(want)
        assert bytes(rows[doc_id]["decoded"]) == (text or "").encode()
    assert bpe.encode(empty, *args).count() == 0


def test_query(spark, small):
    import hashlib

    rows = by_id(queries.op2_byte_bpe(spark, small))
    docs = by_id(spark.read.parquet(f"{small}/documents.parquet"))
    assert rows.keys() == docs.keys()
    for k, r in rows.items():
        text = docs[k]["text"] or ""
        want = np.array(REFERENCE.encode_ordinary(text), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(want), hashlib.sha256(want.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
