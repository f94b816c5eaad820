"""Token counts by prefix dynamic programming.

The count of a prefix follows from a shorter one, at two levels. Between words, which no token crosses:
tokens(prefix that ends with word k) = tokens(prefix that ends with word k - 1) + tokens(word k). Inside a word, by
bytes: of each prefix the last token of its encoding is stored; a prefix is encoded as a shorter one and one more
token where that token and the shorter one's last can stand side by side, that is where no merge across their border
would have come before those that built them. Exactly one token does, so its count is the shorter one's and one.
The table answers every prefix, truncation and budget question by looking up; the text isn't encoded again.
"""

from __future__ import annotations

import json
import os
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import in_pieces, slices
from .byte_bpe import byte_letters

#: Words kept with their counts, and the longest that is kept, in bytes: together they bound the cache.
CACHE, LONGEST_KEPT = 400_000, 64
LIMIT = 2048
WORD_END = "</w>"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordCounter:
    """Counts tokens of words, each met word once; words are what ASCII white space separates."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.special = tuple(t.content for t in self.model.get_added_tokens_decoder().values())
        if any(c.isspace() for t in self.special for c in t):
            raise ValueError(f"{path}: an added token holds white space, so words can't be counted apart")
        if not self.model.normalizer or self.model.encode("a b", add_special_tokens=False).tokens != self.model.encode("a\n b", add_special_tokens=False).tokens:
            raise ValueError(f"{path}: white space isn't dropped, so words can't be counted apart")
        self.path, self.seen, self._merges = path, {}, None

    @property
    def merges(self) -> Merges:
        if self._merges is None:
            self._merges = Merges(self.path)
        return self._merges

    def learn(self, words: list[bytes]) -> None:
        """Words' counts, as the library gives them for each word alone."""
        coded = self.model.encode_batch_fast([w.decode("utf-8") for w in words], add_special_tokens=False)
        self.seen.update(zip(words, map(len, coded)))

    def inside(self, word: str) -> tuple[list[int], list[int]]:
        """Each character prefix of a word: its length in bytes, and its tokens, by the dynamic program."""
        return prefix_counts(word, self.merges, self.model.normalizer.normalize_str, self.special)

    def counts(self, texts: list[bytes]) -> list[np.ndarray]:
        """The token counts of each text's words, in order."""
        out = []
        for i, j in slices([len(t) for t in texts], 1 << 18):
            split = [t.split() for t in texts[i:j]]
            new = {w for words in split for w in words if w not in self.seen}
            if len(self.seen) + len(new) > CACHE:
                self.seen.clear()
                new = {w for words in split for w in words}
            if new:
                self.learn(list(new))
            long = [w for w in new if len(w) > LONGEST_KEPT]
            out += [np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words)) for words in split]
            for w in long:
                del self.seen[w]
        return out


@lru_cache(2)
def counter(path: str) -> WordCounter:
    return WordCounter(path)


class Merges:
    """A BPE vocabulary with word ends: its tokens by text, how each was merged, and which may stand side by side."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != WORD_END:
            raise ValueError(f"{path}: not a BPE vocabulary with word ends {WORD_END}")
        vocab = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.parts = {vocab[a + b]: (vocab[a], vocab[b], r) for r, (a, b) in enumerate(pairs)}
        self.known: dict[tuple[int, int], bool] = {}
        self.inner: dict[str, int] = {}
        self.last: dict[str, int] = {}
        for text, token in vocab.items():
            if self._stands(token):
                at_end = text.endswith(WORD_END)
                (self.last if at_end else self.inner)[text.removesuffix(WORD_END)] = token
        self.longest = max(map(len, (*self.inner, *self.last)))

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens at a token's left (0) or right (1) edge while it is merged, from itself down, each with the rank of the merge that ends it."""
        out, until = [(token, float("inf"))], float("inf")
        while token in self.parts:
            *parts, until = self.parts[token]
            token = parts[side]
            out.append((token, until))
        return out

    def _crossed(self, a: int, b: int, but: int = -1) -> bool:
        """Whether a merge across the border of a and b (other than rank `but`) comes while both its sides stand; of equal ranks the left one comes first."""
        right = self._spine(b, 0)
        for x, x_until in self._spine(a, 1):
            for y, y_until in right:
                r = self.rank.get((x, y))
                if r is not None and r != but and r < x_until and r <= y_until:
                    return True
        return False

    def _stands(self, token: int) -> bool:
        """Whether a token's text is encoded as that token alone: no merge within it came before those that built it."""
        if token not in self.parts:
            return True
        a, b, r = self.parts[token]
        return self._stands(a) and self._stands(b) and not self._crossed(a, b, r)

    def fit(self, a: int, b: int) -> bool:
        """Whether a's and b's texts together are encoded as a, b."""
        if (a, b) not in self.known:
            if len(self.known) > 1_000_000:
                self.known.clear()
            self.known[a, b] = not self._crossed(a, b)
        return self.known[a, b]


class Piece:
    """One pre-token that grows letter by letter: of each prefix, taken as not yet ended, the last token and the count."""

    def __init__(self, merges: Merges, letters: str = ""):
        self.merges, self.letters, self.token, self.count = merges, [], [-1], [0]
        for x in letters:
            self.push(x)

    def _step(self, texts: dict[str, int]) -> tuple[int, int]:
        n = len(self.letters)
        tail = "".join(self.letters[-self.merges.longest :])
        for k in range(len(tail), 0, -1):
            token = texts.get(tail[-k:])
            if token is not None and (k == n or self.merges.fit(self.token[n - k], token)):
                return token, self.count[n - k] + 1
        raise ValueError(f"no token ends the piece {''.join(self.letters)!r}")

    def push(self, letter: str) -> None:
        self.letters.append(letter)
        token, count = self._step(self.merges.inner)
        self.token.append(token)
        self.count.append(count)

    def cut(self, n: int) -> None:
        del self.letters[n:], self.token[n + 1 :], self.count[n + 1 :]

    def tokens(self) -> int:
        """Tokens of what has been pushed, as a whole pre-token."""
        return self._step(self.merges.last)[1] if self.letters else 0


_LETTERS = byte_letters()
# The vocabulary's pre-tokens are these endings after an apostrophe, runs of letters, single digits, runs of other signs.
SHORT_ENDINGS, LONG_ENDINGS = ("s", "t", "m", "d"), ("re", "ve", "ll")
_kind = lru_cache(1 << 16)(lambda c: "L" if regex.match(r"\p{L}", c) else "N" if regex.match(r"\p{N}", c) else "S" if regex.match(r"\p{White_Space}", c) else "O")


@lru_cache(1 << 16)
def _apart(c: str) -> bool:
    """Whether normalising never joins a character with those before it."""
    return not (unicodedata.combining(c) or unicodedata.category(c)[0] == "M" or "\u1160" <= c <= "\u11ff") and unicodedata.is_normalized("NFC", c)


def prefix_counts(word: str, merges: Merges, normal, special: tuple[str, ...] = ()) -> tuple[list[int], list[int]]:
    """For each prefix of word by characters, the empty one first: its bytes, and its tokens. A special string is one token."""

    def push(state, c):
        """(tokens of finished pieces, kind of the piece that grows, the piece, apostrophe's tokens if it may yet belong to an ending) with a character more."""
        done, kind, piece, held = state
        now = _kind(c)
        letters = [_LETTERS[b] for b in c.encode("utf-8")]
        quote = kind == "O" and piece.letters == ["'"]
        if now == "S":
            return done + piece.tokens(), "S", Piece(merges), 0
        if quote and c in SHORT_ENDINGS:
            return done, "E", Piece(merges, "'" + c), 0
        if held and piece.letters[0] + c in LONG_ENDINGS and len(piece.letters) == 1:
            return done - held, "E", Piece(merges, "'" + piece.letters[0] + c), 0
        if now == kind and now in "LO":
            for x in letters:
                piece.push(x)
            return done, kind, piece, 0
        return done + piece.tokens(), now, Piece(merges, "".join(letters)), piece.tokens() if quote and c in "rvl" else 0

    bytes_, counts, n = [0], [0], 0
    state = (0, "S", Piece(merges), 0)
    tail, free = "", 0  # characters that may yet be joined with what follows; the end of the last special string
    for at, c in enumerate(word, 1):
        if tail and _apart(c):
            for x in normal(tail):
                state = push(state, x)
            tail = ""
        tail += c
        n += len(c.encode("utf-8"))
        whole = next((t for t in special if c == t[-1] and at - len(t) >= free and word.startswith(t, at - len(t))), None)
        if whole:
            state, tail, free = (counts[at - len(whole)] + 1, "S", Piece(merges), 0), "", at
            bytes_.append(n)
            counts.append(state[0])
            continue
        piece, size, now = state[2], len(state[2].letters), state
        for x in normal(tail):  # on trial, as what follows may be joined with it
            now = push(now, x)
        bytes_.append(n)
        counts.append(now[0] + now[2].tokens())
        piece.cut(size)
    return bytes_, counts


class PrefixTable:
    """Counts at every prefix of one text, given in UTF-8 bytes; a prefix that cuts a character counts without it."""

    def __init__(self, text: bytes, words: WordCounter):
        self.text = text
        found, at = text.split(), 0
        self.starts = []
        for w in found:
            self.starts.append(at := text.index(w, at))
            at += len(w)
        self.ends = [a + len(w) for a, w in zip(self.starts, found)]
        each = {w: words.inside(w.decode("utf-8")) for w in set(found)}
        self.inside = [each[w] for w in found]
        self.totals = [0, *np.cumsum([counts[-1] for _, counts in self.inside]).tolist()]

    def tokens(self, n_bytes: int) -> int:
        """Tokens of the first n_bytes bytes."""
        k = bisect_right(self.starts, n_bytes - 1) - 1 if n_bytes > 0 else -1
        if k < 0:
            return 0
        sizes, counts = self.inside[k]
        return self.totals[k] + counts[bisect_right(sizes, n_bytes - self.starts[k]) - 1]

    def truncate(self, budget: int) -> int:
        """Bytes of the longest prefix of at most budget tokens."""
        k = bisect_right(self.totals, budget) - 1  # words that fit whole
        return len(self.text) if k >= len(self.ends) else self.starts[k] + longest_fit(self.inside[k], budget - self.totals[k])


def longest_fit(inside: tuple[list[int], list[int]], budget: int) -> int:
    """Bytes of a word's longest prefix of at most budget tokens."""
    return max(size for size, count in zip(*inside) if count <= budget)


def bytes_in_limit(text: bytes, totals: np.ndarray, limit: int, words: WordCounter) -> int:
    """As PrefixTable.truncate(limit), from the counts at word ends: only the word that crosses the limit is looked into."""
    k = int(np.searchsorted(totals, limit, "right"))
    if k >= len(totals):
        return len(text)
    found = regex.finditer(rb"[^\x20\x09-\x0D]+", text)
    word = next(m for i, m in enumerate(found) if i == k)
    return word.start() + longest_fit(words.inside(word[0].decode("utf-8")), limit - (int(totals[k - 1]) if k else 0))


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", table: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), n_words, words_in_limit, bytes_in_limit; with table also totals array<long>.

    n_tokens is the last entry of the prefix table, words_in_limit the number of leading words of at most limit tokens
    together, bytes_in_limit the bytes of the longest prefix of at most limit tokens; totals are the table's entries at
    word ends. Counts hold no begin, end or added special token, no truncation and no padding. Null text: empty, 0
    tokens. A text is split whole, so a task holds one text and its words at a time; a word's own table grows with the
    word. One row per row, repeated and null ids included; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, n_words long, words_in_limit long, bytes_in_limit long" + ", totals array<long>" * table

    def run(batches):
        words = counter(path)
        for batch in in_pieces(batches, 1, 4 << 20):
            texts = batch.column(1).to_pylist()
            totals = [np.cumsum(c) for c in words.counts(texts)]
            last = np.array([t[-1] if len(t) else 0 for t in totals], np.int64)
            columns = [
                batch.column(0),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array(last),
                pa.array(last > limit),
                pa.array([len(t) for t in totals], pa.int64()),
                pa.array([int(np.searchsorted(t, limit, "right")) for t in totals], pa.int64()),
                pa.array([bytes_in_limit(x, t, limit, words) for x, t in zip(texts, totals)], pa.int64()),
            ]
            columns += [pa.array(totals, pa.list_(pa.int64()))] * table
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_words", "words_in_limit", "bytes_in_limit"] + ["totals"] * table
            yield pa.RecordBatch.from_arrays(columns, names)

    texts = docs.select(F.col(id_col).alias("doc_id"), F.encode(F.coalesce(text_col, F.lit("")), "utf-8").alias("body"))
    return texts.mapInArrow(run, schema)
