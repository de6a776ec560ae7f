import random
from pathlib import Path

import pytest

pytest.importorskip("doclake.llm.tokens")
from doclake.llm import tokens as K

RANKS = Path(K.TOKENIZERS, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not RANKS.exists(), reason="no tokenizer files")


@pytest.fixture(scope="module")
def tokenizer():
    return K.Tokenizer(RANKS.read_bytes())


def whole(t, s):
    return t.pieces.encode_ordinary(s)


def test_lookahead_of_small_vocabularies():
    ranks = {bytes([i]): i for i in range(256)}
    assert K.sufficient_lookahead(ranks) == 0
    # b+c before a+b before x+a: how far the end is felt grows along the chain.
    chain = ranks | {b"bc": 256, b"ab": 257, b"xa": 258}
    assert K.sufficient_lookahead(chain) == 3


def test_streaming_equals_whole(tokenizer):
    rnd = random.Random(2)
    parts = ["=", "-", "a", " ", "\n", "é", "汉", "0", "'", "'re", "the", "ing", " \n", "\t", "🙂", "    ", "\n\n", "<|endoftext|>"]
    texts = ["".join(rnd.choice(rnd.sample(parts, 3)) for _ in range(3000)) for _ in range(60)]
    for _ in range(60):
        few = rnd.sample(parts, rnd.randint(1, 3))
        texts.append("".join(rnd.choice(few) for _ in range(4000)))
    texts += ["".join(rnd.choice("abcdefXYZ") for _ in range(9000)), "a" * 9000, " " * 9000 + "x", "\n" * 9000 + " x", "汉" * 4000, "🙂" * 4000, ("a'" * 3000)]
    for s in texts:
        for block, step in ((532, 97), (2000, 5000)):
            e = K.Encoder(tokenizer, block)
            got, most = [], 0
            for i in range(0, len(s), step):
                got += e.push(s[i : i + step]).tolist()
                most = max(most, len(e.held))
            got += e.finish().tolist()
            assert got == whole(tokenizer, s)
            assert most <= block + step  # constant memory


def test_a_piece_that_ends_at_the_end_of_the_window(tokenizer):
    for block in (532, 1024):
        for tail in ("\n\n", " x", "'s", "\n", "..", "1", "\n\nx"):
            for n in range(block - 6, block + 2):
                s = "q" * n + tail
                e = K.Encoder(tokenizer, block)
                got = [i for at in range(0, len(s), block) for i in e.push(s[at : at + block]).tolist()] + e.finish().tolist()
                assert got == whole(tokenizer, s)


def test_random_vocabularies_settle():
    import numpy as np

    rnd = random.Random(8)
    for _ in range(15):
        ranks = {bytes([i]): i for i in range(256)}
        pool = [b"a", b"b", b"c"]
        for _ in range(40):
            w = rnd.choice(pool) + rnd.choice(pool)
            if w not in ranks:
                ranks[w] = len(ranks)
                pool.append(w)
        used = {u + v for u, v in K.rules(ranks)}
        ranks = {t: i for i, t in enumerate(sorted(ranks, key=lambda t: ranks[t])) if len(t) == 1 or t in used}
        t = K.Tokenizer("".join(f"{__import__('base64').b64encode(k).decode()} {v}\n" for k, v in ranks.items()).encode())
        s = "".join(rnd.choice("abc") for _ in range(3000))
        full = t._ids if hasattr(t, "_ids") else t.pieces._encode_single_piece
        ids = full(s.encode())
        ends = set(np.cumsum(t.lengths[ids]).tolist())
        for n in range(t.lookahead + 1, 2500, 61):
            part = np.cumsum(t.lengths[full(s[:n].encode())]).tolist()
            assert {e for e in part if e <= n - t.lookahead} == {e for e in ends if e <= n - t.lookahead}


def test_decoding_is_a_round_trip(tokenizer):
    s = "naïve 汉字 🙂🙂 <|endoftext|> \r\n\t" * 50
    ids = tokenizer.encode(s).tolist()
    for step in (1, 3, 1000):
        d = K.Decoder(tokenizer)
        assert "".join(d.push(ids[i : i + step]) for i in range(0, len(ids), step)) + d.finish() == s


def test_column_with_nulls_blanks_and_long_texts(spark, tokenizer):
    long = "word " * 60_000 + "x" * 70_000
    data = [(1, None, "c"), (2, "", "c"), (3, " \n", "c"), (4, long, "c"), (5, "<|endoftext|>", "c"), (5, "<|endoftext|>", "c"), (None, "a", None)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, ids string")
    got = [(r.doc_id, list(r.ids)) for r in K.encode_column(df, ["doc_id"]).collect()]
    assert got == [(i, whole(tokenizer, s or "")) for i, s, _ in data]
    assert 50256 not in got[4][1]
    assert K.encode_column(df.limit(0), ["doc_id"]).count() == 0
    assert [r.n_tokens for r in K.count_tokens(df, ["doc_id"]).collect()] == [len(x[1]) for x in got]


def test_decoding_a_column(spark):
    rows = [(1, "a 汉字 🙂 " * 700), (2, ""), (3, None), (1, "x")]
    ids = K.encode_column(spark.createDataFrame(rows, "k int, text string"), ["k"])
    got = sorted((r["k"], r["text"]) for r in K.decode_column(ids, ["k"]).collect())
    assert got == sorted((k, s or "") for k, s in rows)
    broken = spark.createDataFrame([(1, [255, 0]), (2, None), (3, [])], "k int, ids array<int>")
    assert [r["text"] for r in K.decode_column(broken, ["k"]).orderBy("k").collect()][1:] == ["", ""]
