import random

from tallyloom.llm.token_counts import Automaton, read_vocabulary, token_counts


def greedy(pieces, word):
    """Longest match first; None if some byte has no piece."""
    rest, n, left = b" " + word, 0, {p for p in pieces if p[:1] == b" "}
    while rest or n == 0:
        for k in range(len(rest), 0, -1):
            if rest[:k] in left:
                break
        else:
            return None
        rest, n, left = rest[k:], n + 1, {p for p in pieces if p[:1] != b" "}
    return n


def test_small_vocabularies_against_greedy():
    rng = random.Random(3)
    for _ in range(300):
        pieces = {bytes(rng.choices(b"abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 9))}
        pieces |= {b" " + bytes(rng.choices(b"abc", k=rng.randint(0, 3))) for _ in range(4)}
        a = Automaton(sorted(pieces))
        for _ in range(30):
            w = bytes(rng.choices(b"abc", k=rng.randint(1, 9)))
            want = greedy(pieces, w)
            assert a.count(w) == (1 if want is None else want), (pieces, w)


def test_public_vocabulary_against_greedy():
    pieces = read_vocabulary()
    a, have = Automaton(pieces), set(pieces)
    for w in "the internationalization Straße éaueau 12345678 <|endoftext|> ,.;'\"x 中文 zzzzzzzzzzzzzzzzqqqq".split():
        assert a.count(w.encode()) == greedy(have, w.encode())


def test_edge_rows(spark):
    rows = [(1, None, 7), (2, "", 7), (None, " \t\n", 7), (4, "the the", 7), (4, "the the", 7), (5, "word " * 100_000, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    out = sorted((tuple(r) for r in token_counts(df, keep=["doc_id"]).collect()), key=str)
    assert out == sorted([(1, 0, 0), (2, 0, 0), (None, 0, 0), (4, 2, 2), (4, 2, 2), (5, 100_000, 100_000)], key=str)
    assert token_counts(df).columns == ["doc_id", "text", "n_words", "n_tokens"]
    assert token_counts(df.limit(0)).count() == 0
