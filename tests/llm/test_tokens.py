"""Token counts and the codec against the public libraries, and exact round trips."""

import base64
import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stratalake.llm.bpe_codec import Prefixes, codec, digests, encode
from stratalake.llm.token_counts import count_tokens, token_counts

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
LIBRARY = Tokenizer.from_file(JSON)
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})
ALPHABET = st.text(st.sampled_from("ab cd'\n\t  é×ß123,.!日😀tsl\x1c\x85\xa0"), max_size=60)


@settings(max_examples=30, deadline=None)
@given(st.lists(ALPHABET | st.text(max_size=20), min_size=1, max_size=30))
def test_against_libraries(xs):
    xs = [x.encode("utf-8", "ignore").decode() for x in xs]
    assert count_tokens(pa.array(xs, pa.string()), JSON).tolist() == [len(e.ids) for e in LIBRARY.encode_batch(xs, add_special_tokens=False)]
    ids, ends = codec(RANKS).encode(pa.array(xs, pa.string()))
    data, data_ends = codec(RANKS).decode(ids, ends)
    for i, x in enumerate(xs):
        assert ids[ends[i] : ends[i + 1]].tolist() == TIKTOKEN.encode_ordinary(x)
        assert data[data_ends[i] : data_ends[i + 1]].tobytes() == x.encode()


def test_token_counts(docs, texts, empty):
    got = {r["doc_id"]: r for r in token_counts(docs, JSON, limit=100).collect()}
    for i, t in texts:
        n = len(LIBRARY.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 100)
    assert token_counts(empty, JSON).count() == 0


def test_codec(docs, texts, empty):
    got = {r["doc_id"]: r for r in digests(docs, RANKS).collect()}
    for i, t in texts:
        ids = TIKTOKEN.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    whole = {r["doc_id"]: r for r in encode(docs, RANKS).collect()}
    assert all(whole[i]["ids"] == TIKTOKEN.encode_ordinary(t or "") and bytes(whole[i]["decoded"]) == (t or "").encode() for i, t in texts)
    assert digests(empty, RANKS).count() == 0


def test_decoding_takes_little_more_than_its_bytes():
    own, text = codec(RANKS), " ".join(f"word{i % 977} und der" for i in range(60_000)).encode()
    ids, ends = own.encode(pa.array([text.decode()]))
    tracemalloc.start()
    data, data_ends = own.decode(ids, ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert data.tobytes() == text and data_ends.tolist() == [0, len(text)]
    assert peak < 20 * len(ids) + 2 * len(text) + (4 << 20)


def test_edits():
    own, r = codec(RANKS), random.Random(3)
    p = Prefixes(own, b"unbelievable" * 30)
    for _ in range(60):
        i = r.randint(0, len(p.text))
        again = p.replace(i, min(len(p.text), i + r.randint(0, 4)), "".join(r.choices("abeliun", k=r.randint(0, 5))).encode())
        fresh = Prefixes(own, p.text)
        assert p.last == fresh.last and p.tokens() == fresh.tokens()
    assert again < len(p.text)
    n = len(p.last)
    p.append(b"able")
    assert p.last == Prefixes(own, p.text).last and len(p.last) == n + 4
