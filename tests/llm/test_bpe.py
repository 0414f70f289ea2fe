import base64
import hashlib
import random
import tracemalloc

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from gramforge.llm import bpe
from tests.llm.conftest import AWKWARD

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.ranks_from(PATH)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(b):
    return [int.from_bytes(b[i : i + 4], "little") for i in range(0, len(b), 4)]


def test_texts_as_tiktoken(ranks, reference):
    t = bpe.Tokenizer(ranks, P.PATTERN)
    rng = random.Random(1)
    alphabet = "ab  \n\t'sé\x85\xa0    1２the ing ñ🙂\x1c٣Ⅷ̈ d'll're\r\n<|endoftext|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 3000, " " * 4000, "ab" * 2000 + " " * 300 + "x", "\n" * 200, *(x or "" for _, x in AWKWARD)]
    for text, ids in zip(texts, t.encode_all(texts), strict=True):
        assert ids_of(ids) == reference.encode_ordinary(text), repr(text[:80])
        assert t.decode(ids) == text.encode()


def test_prefixes_are_merges(ranks):
    b = bpe.PrefixBPE(ranks)
    rng = random.Random(2)
    for _ in range(300):
        data = bytes(rng.choice(b"thereing abc\xc3\xa9") for _ in range(rng.randint(0, 60)))
        last = b.prefixes(data)
        for n in range(len(data) + 1):
            assert b.read_back(last[: n + 1]) == b.merged(data[:n])


def test_append_and_edit(ranks):
    b = bpe.PrefixBPE(ranks)
    rng = random.Random(3)
    for _ in range(400):
        data = bytes(rng.choice(b"thereing abc\xc3\xa9") for _ in range(rng.randint(0, 400)))
        more = bytes(rng.choice(b"thering") for _ in range(rng.randint(0, 6)))
        assert b.append(data, b.prefixes(data), more)[1] == b.prefixes(data + more)
        at = rng.randint(0, len(data))
        gone = rng.randint(0, min(6, len(data) - at))
        new, last = b.edit(data, b.prefixes(data), at, gone, more)
        assert new == data[:at] + more + data[at + gone :]
        assert last == b.prefixes(new)


def test_small_vocabulary():
    """Ranks in which some tokens can't be reached by merges."""
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259, b"bcd": 300, b"xyz": 301}
    b = bpe.PrefixBPE(ranks)
    rng = random.Random(4)
    many = bpe.ManyPieces(b)
    pieces = [bytes(rng.choice(b"abcdxyz") for _ in range(rng.randint(1, 12))) for _ in range(2000)]
    for piece, got in zip(pieces, many.encode(pieces), strict=True):
        want = [ranks[piece]] if piece in ranks else b.merged(piece)
        assert ids_of(got) == want == b.encode_piece(piece)


def test_documents(awkward, no_documents, reference):
    rows = bpe.encode_documents(awkward, PATH, P.PATTERN, with_ids=True).collect()
    key = lambda i, n: (-1 if i is None else i, n)
    want = sorted(key(i, len(reference.encode_ordinary(t or ""))) for i, t in AWKWARD)
    assert sorted(key(r.doc_id, r.n_tokens) for r in rows) == want
    texts = {}
    for i, t in AWKWARD:
        texts.setdefault(i, set()).add(hashlib.sha256((t or "").encode()).hexdigest())
    for r in rows:
        assert r.decoded_sha256 in texts[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest() and len(r.ids) == 4 * r.n_tokens
    assert bpe.encode_documents(no_documents, PATH, P.PATTERN).count() == 0


def new_words(k, n=60000):
    return " ".join(f"{k}q{i:x}z" for i in range(n))


def test_caches_stay_small(ranks, reference):
    """Many words that never come again, and long chunks without a space, don't stay."""
    t = bpe.Tokenizer(ranks, P.PATTERN)
    tracemalloc.start()
    try:
        for k in range(12):
            t.encode_all([new_words(k)])
            t.encode_all(["x " + f"{k}a" * 100000])
        assert t.encode_all(["one more"]) and tracemalloc.get_traced_memory()[0] < 25e6
    finally:
        tracemalloc.stop()
    for text in (new_words(1, 500), new_words(99, 500)):
        assert ids_of(t.encode_all([text])[0]) == reference.encode_ordinary(text)


def test_batches_are_encoded_in_slices(ranks, reference):
    """A worker's memory depends neither on how large a batch is nor on how many different words it has."""
    t = bpe.Tokenizer(ranks, P.PATTERN)
    texts = [new_words(k, 10000) for k in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["id", "text"])
    got, most = [], 0
    tracemalloc.start()
    try:
        for part in bpe.encoded(iter([batch]), t, True):
            most = max(most, tracemalloc.get_traced_memory()[1])
            got += part.to_pylist()
            tracemalloc.reset_peak()
    finally:
        tracemalloc.stop()
    assert most < 150e6
    assert [r["id"] for r in got] == list(range(len(texts)))
    for r, text in zip(got, texts, strict=True):
        assert ids_of(r["ids"]) == reference.encode_ordinary(text) and r["n_tokens"] == len(r["ids"]) // 4


def test_vocabulary_file():
    assert all(base64.b64decode(a) for a in open(PATH, "rb").read().split()[:10:2])
