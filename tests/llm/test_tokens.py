import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from accessum.llm import byte_bpe, token_counts

ODD = ["", " ", "\n\n  a", "日本語 テキスト 🎉 👩‍👩‍👧", "▁a ▁ b", "x" * 3000, "a\x00b\x01", "<unk> <s>", "⁇", "don't DON'T we'll", "<|endoftext|>a <|startoftext|>", "é x　y\x1cz\x85w İ Σ", "'s 's's", "ſt ½ 123"]


def mixed(n, seed=1):
    r = random.Random(seed)
    letter = lambda: chr(r.choice([32, 10, r.randrange(32, 127), r.randrange(128, 0x3000), r.randrange(0x4E00, 0x9FFF), r.randrange(0x1F300, 0x1F6FF)]))
    return ["".join(letter() for _ in range(120)) for _ in range(n)]


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.ByteBpe(byte_bpe.vocabulary_path(), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(byte_bpe.vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_the_librarys(coder, library):
    texts = ODD + mixed(80)
    for t, ids in zip(texts, coder.encode_batch(texts)):
        assert ids == library.encode_ordinary(t) and coder.decode(ids) == t.encode()
    assert coder.encode("a b") == library.encode_ordinary("a b")


def test_cache_may_be_cleared(coder, monkeypatch):
    want = list(coder.encode_batch(ODD))
    monkeypatch.setattr(byte_bpe, "CACHE", 3)
    coder.seen.clear()
    assert list(coder.encode_batch(ODD)) == want and list(coder.encode_batch(ODD)) == want


def test_other_rank_file(coder):
    other = byte_bpe.ByteBpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for x in ODD[:8] + mixed(20, 3):
        assert other.encode(x) == t.encode(x, add_special_tokens=False).ids


def test_round_trip(odd, library):
    rows = byte_bpe.round_trip(odd, byte_bpe.vocabulary_path(), keep_ids=True).collect()
    want = []
    for r in odd.collect():
        t = r.text or ""
        ids = library.encode_ordinary(t)
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), len(t.encode()), True, ids))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)


def test_encode_then_decode(odd):
    path = byte_bpe.vocabulary_path()
    got = byte_bpe.decode_ids(byte_bpe.encode_texts(odd, path), path).collect()
    assert sorted((bytes(r["bytes"]) for r in got)) == sorted((r.text or "").encode() for r in odd.collect())


def test_bad_rank_files(tmp_path):
    p = tmp_path / "gap"
    p.write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError, match="ranks"):
        byte_bpe.read_ranks(str(p))
    p.write_bytes(b"YQ== 0\nYg== 1\n")
    with pytest.raises(ValueError, match="no token"):
        byte_bpe.ByteBpe(str(p), P.PATTERN)


def test_counts_are_the_librarys(odd):
    path = token_counts.vocabulary_path()
    t = Tokenizer.from_file(path)
    got = token_counts.token_counts(odd, path, limit=5, table=True).collect()
    want = []
    for r in odd.collect():
        n = len(t.encode(r.text or "", add_special_tokens=False))
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 5))
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        assert len(r.totals) == r.n_words and sum(x <= 5 for x in r.totals) == r.words_in_limit


def test_every_prefix_and_budget():
    path = token_counts.vocabulary_path()
    words, t = token_counts.WordCounter(path), Tokenizer.from_file(path)
    count = lambda s: len(t.encode(s, add_special_tokens=False))
    for x in [*ODD[:5], *ODD[6:], *mixed(6, 5), "the quick brown foxes aren't unbelievably jumping"]:
        table = token_counts.PrefixTable(x.encode(), words)
        counts = [count(x[:i]) for i in range(len(x) + 1)]
        ends = [len(x[:i].encode()) for i in range(len(x) + 1)]
        assert [table.tokens(n) for n in ends] == counts
        for budget in (0, 1, 2, 5, 17, 10_000):
            best = table.truncate(budget)
            assert table.tokens(best) <= budget
            assert best == max(e for e, c in zip(ends, counts) if c <= budget)


def test_prefix_program_is_the_librarys():
    """Words of many kinds: contractions, digits, marks that join, special strings, other scripts; every prefix of each."""
    path = token_counts.vocabulary_path()
    words, t = token_counts.WordCounter(path), Tokenizer.from_file(path)
    r = random.Random(4)
    parts = ["'", "'s", "'re", "'l", "l", "ll", "don", "We", "12", "é", "e\u0301", "a\u0323\u0307", "한", "\u1112\u1161\u11ab", "Σ", "İ", "ing", "ation", "..", "(", "🎉", "日本", "aaaa", "<|endoftext|>", "<|startoftext|", "\u3000", "th", "x"]
    made = ["".join(r.choice(parts) for _ in range(r.randrange(1, 9))) for _ in range(250)]
    made += ["".join(r.choice("etaoinshrdlu'") for _ in range(r.randrange(1, 25))) for _ in range(250)]
    for w in made:
        sizes, counts = words.inside(w)
        assert counts == [len(t.encode(w[:i], add_special_tokens=False)) for i in range(len(w) + 1)], w
        assert sizes == [len(w[:i].encode()) for i in range(len(w) + 1)]


def test_no_text_is_encoded_once_the_table_is_built(monkeypatch):
    path = token_counts.vocabulary_path()
    words, t = token_counts.WordCounter(path), Tokenizer.from_file(path)
    word = ("unbelievable日本語の文章é" * 40_000)[:580_000]  # one word of 1 MB without spaces
    table = token_counts.PrefixTable((word + " and the rest").encode(), words)
    want = len(t.encode(word + " and the rest", add_special_tokens=False))
    for broken in ("model", "_merges"):
        monkeypatch.setattr(words, broken, None)
    assert table.totals[-1] == want and table.tokens(len(table.text)) == want
    for n in range(1, len(word.encode()), 99_991):
        best = table.truncate(table.tokens(n))
        assert best >= n - 3 and table.tokens(best) <= table.tokens(n)


def test_bytes_in_limit(odd):
    path = token_counts.vocabulary_path()
    words = token_counts.WordCounter(path)
    text = {r.doc_id: (r.text or "").encode() for r in odd.filter("doc_id < 9 or doc_id > 10").collect()}
    for r in token_counts.token_counts(odd.filter("doc_id < 9 or doc_id > 10").dropDuplicates(["doc_id"]), path, limit=3).collect():
        assert r.bytes_in_limit == token_counts.PrefixTable(text[r.doc_id], words).truncate(3) or r.doc_id == 4


def test_empty(empty):
    assert token_counts.token_counts(empty, token_counts.vocabulary_path()).isEmpty()
    assert byte_bpe.round_trip(empty, byte_bpe.vocabulary_path()).isEmpty()
