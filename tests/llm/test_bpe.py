import random

import duckdb
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lookout.llm import bpe, q6_tokens

RANKS = bpe.load_ranks()
THEIRS = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def want(text):
    return THEIRS.encode_ordinary(text) if text else []


def test_whole_table(spark, sf):
    texts = dict(duckdb.connect().execute(f"SELECT doc_id, text FROM read_parquet('{sf}/documents.parquet')").fetchall())
    got = {r.doc_id: r.ids for r in q6_tokens.p6_ids(spark, sf).collect()}
    assert got == {i: want(t) for i, t in texts.items()}
    assert [r for r in q6_tokens.p6_round_trip(spark, sf).collect() if not r.same] == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "  ", "\n", "the", " in", "1", "'s", "'", "é", "书", "​", "!", "aaaa", "ing", "<|endoftext|>"]), max_size=60), st.integers(1, 9))
def test_any_chunks(parts, size):
    text = "".join(parts)
    assert list(bpe.encoder().stream(text[i : i + size] for i in range(0, len(text), size))) == want(text) == bpe.encoder().ids(text)


@pytest.mark.parametrize("size", [1, 100, 5000])
@pytest.mark.parametrize("run", ["a", "ab", "!", "7", " ", "\n", " \n", "书", "é"])
def test_long_runs_stream_in_constant_memory(run, size):
    text = "x " + run * 9000 + "y  " + run * 3000
    e = bpe.encoder()
    assert list(e.stream(text[i : i + size] for i in range(0, len(text), size))) == want(text)
    open_, most = bpe._OpenPiece(e), 0
    for i in range(0, len(run) * 9000, 50):
        list(open_.feed((run * 9000)[i : i + 50].encode()))
        most = max(most, len(open_.held))
    assert most < 4 * e.window


def test_lookahead_holds_for_random_continuations():
    rng, e = random.Random(5), bpe.encoder()
    words = ["".join(rng.choice("abeinrst") for _ in range(rng.randint(1, 6))) for _ in range(50)]
    for _ in range(200):
        head = "".join(rng.choice(words) for _ in range(300))[:700].encode()
        a, b = (bpe._merged(head + "".join(rng.choice(words) for _ in range(20)).encode(), RANKS) for _ in range(2))
        end = 0
        for x, y in zip(a, b, strict=False):
            if end + max(len(x), len(y)) > len(head) - e.lookahead:
                break
            assert x == y
            end += len(x)


def test_nulls_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, None, "q"), (None, "", "q"), (2, "hello", "q"), (2, "hello", "q")], "doc_id long, text string, ids string")
    got = bpe.with_ids(docs).collect()
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted([("1", []), ("None", []), ("2", want("hello")), ("2", want("hello"))])
    assert bpe.with_ids(docs.limit(0)).count() == 0


def test_decoder_splits_characters():
    ids, d = want("a书é\U0001f600"), bpe.Decoder(RANKS)
    assert "".join(d.feed([i]) for i in ids) + d.close() == "a书é\U0001f600"
