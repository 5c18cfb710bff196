import base64
import random

import pytest

from codeweft.llm.bpe import VOCABULARY, Vocabulary, vocabulary
from codeweft.llm.encoding import round_trips, token_counts, token_ids
from codeweft.llm.packing import fill, first_fit, pack

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    out = ["", " ", "\r\n\t", "it's <|endoftext|> we'll", "a" * 5000, "=" * 3000, "é" * 700, "\u200b👩‍💻 中文字", " \n \n x", "0" * 1000]
    parts = ["a", "ab ", "é", "  \n", "0123", "字", "_-", "Z", "😀", "'re", "\t", "the ", "return"]
    return out + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 300))) for _ in range(150)] + ["".join(rng.choice("abcdefgh") for _ in range(2500))]


def test_ids_equal_the_public_encoder_and_decode_again(reference):
    v = vocabulary()
    for t in texts():
        ids = v.encode(t)
        assert ids == reference.encode_ordinary(t)
        assert "".join(v.decode(ids)) == t
    assert v.encode(None) == []


def test_stream_emits_stable_tokens_and_keeps_little():
    v = Vocabulary(VOCABULARY)
    data = b"abcdefgh" * 4000
    chunks, out = 0, []

    def feed():
        nonlocal chunks
        for k in range(0, len(data), 64):
            chunks += 1
            yield data[k : k + 64]

    first = None
    for token in v.stream(feed()):
        first = first or chunks
        out.append(token)
    assert first < 20  # long before the end
    assert b"".join(v.bytes_of[t] for t in out) == data
    small = b"abcdefghij" * 12
    assert list(v.stream([small])) == v.merged(small) == [t for t in v.stream(small[k : k + 1] for k in range(len(small)))]


def test_operators(spark):
    rows = [(1, "hello world", 5), (2, None, 6), (3, "", 7), (1, "hello world", 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted((r["doc_id"], r["ids"]) for r in token_ids(d).collect())
    assert got == [(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, [])]
    assert {(r["doc_id"], r["n_tokens"]) for r in token_counts(d).collect()} == {(1, 2), (2, 0), (3, 0)}
    assert all(r["same"] for r in round_trips(d).collect())
    assert token_ids(d.limit(0)).count() == 0


def test_first_fit_equals_the_plain_loop():
    rng = random.Random(1)
    for _ in range(30):
        sizes = sorted((rng.randint(0, 50) for _ in range(rng.randint(0, 120))), reverse=True)
        room, want = [], []
        for n in sizes:
            for k, free in enumerate(room):
                if free >= n:
                    break
            else:
                room.append(50)
                k = len(room) - 1
            want.append((k, 50 - room[k]))
            room[k] -= n
        assert list(zip(*first_fit(sizes, 50))) == want if sizes else first_fit(sizes, 50) == ([], [])


def test_packing_holds_everything_once_and_splits_only_what_must_be(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([0, None, 1, 10, 50, 99, 100, 101, 250, 1000])) for k in range(400)] + [(7, 300), (7, 300)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    got = pack(df, capacity=100, group=20).collect()
    size, spans = {}, {}
    for r in got:
        spans.setdefault(r["container"], []).append((r["start"], r["start"] + r["n_tokens"]))
        size[r["doc_id"]] = size.get(r["doc_id"], 0) + r["n_tokens"]
    want = {}
    for k, n in rows:
        want[k] = want.get(k, 0) + (n or 0)
    assert size == want
    for s in spans.values():
        s.sort()
        assert s[-1][1] <= 100 and all(a[1] <= b[0] for a, b in zip(s, s[1:]))
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r["n_tokens"])
    assert all(len(pieces[k]) == 1 for k, n in rows if (n or 0) <= 100 and k != 7)
    report = fill(pack(df, capacity=100, group=20), 100).first()
    assert report["fullest"] <= 100 and report["containers"] <= 1.1 * report["least"] + 1
    assert pack(df.limit(0)).count() == 0 and fill(pack(df.limit(0))).first()["containers"] == 0


def test_very_many_empty_items_and_one_key_spread_over_groups(spark):
    rows = [(7, 0) for _ in range(400)] + [(k, None) for k in range(100)]
    got = pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), capacity=100, group=20, most=50).collect()
    assert len(got) == 500 and len({r["container"].split("-")[0] for r in got}) >= 8
