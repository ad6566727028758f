"""Byte-level BPE by dynamic programming over prefixes (operator 4).

Of every byte prefix of a piece only one token can be the last one of its encoding.
A token t ends the prefix of length i if t is its suffix and t may follow the last
token of the prefix of length i - len(t), that is, if BPE leaves the two tokens'
bytes as these two tokens. Storing that token for each prefix gives the encoding of
every prefix; bytes appended need new entries only, and after an edit entries are
worked out again just until as many as the longest token has bytes agree with the
old ones.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from functools import cached_property, lru_cache

import ahocorasick
import pyarrow as pa
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame

from tracewright.llm.common import in_slices, tidy


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=8)
def _class_of(letter: str, top: int) -> str:
    """The code points of a general category up to top, as ranges for a character class of re."""
    out, start = [], None
    for cp in range(top + 2):
        inside = cp <= top and unicodedata.category(chr(cp))[0] == letter
        if inside and start is None:
            start = cp
        elif not inside and start is not None:
            out.append(re.escape(chr(start)) + (f"-{re.escape(chr(cp - 1))}" if cp - 1 > start else ""))
            start = None
    return "".join(out)


# White space as the pattern means it (Python's own \\s has four separators more).
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(maxsize=8)
def compiled(pattern: str, top: int) -> re.Pattern:
    r"""The pattern for re, for texts without code points above top, with \p{L}, \p{N} and
    \s written as classes; those of low code points are tables, far faster than property
    lookups."""
    classes = {r"\p{L}": _class_of("L", top), r"\p{N}": _class_of("N", top), r"\s": SPACES}
    out, inside, k = [], False, 0
    while k < len(pattern):
        token = next((t for t in (*classes, r"\S") if pattern.startswith(t, k)), None)
        if token == r"\S":
            out.append(f"[^{SPACES}]")
        elif token:
            out.append(classes[token] if inside else f"[{classes[token]}]")
        else:
            token = pattern[k]
            inside = (inside or token == "[") and token != "]"
            out.append(token)
        k += len(token)
    return re.compile("".join(out))


ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def pieces(text: str, pattern: str) -> list[str]:
    top = 0x7F if text.isascii() else 0x10FFFF if ASTRAL.search(text) else 0xFFFF
    return compiled(pattern, top).findall(text)


# where cutting at single spaces might cut inside a run of white space
RUNS = re.compile(r"\s \s|  ")


class Vocabulary:
    """Ranks with what the prefix tables need. The caches are bounded, whatever is read."""

    def __init__(self, ranks: dict[bytes, int], cached: int = 200_000):
        self.ranks, self.bytes_of = ranks, {r: t for t, r in ranks.items()}
        self.names = {r: str(r) for r in self.bytes_of}
        self.longest = max(map(len, ranks), default=1)
        self._step: dict[bytes, bytes] = {}
        self._ends: dict[bytes, tuple[tuple[int, int], ...]] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._pair: dict[tuple[int, int], bool] = {}
        # words in two generations, so that frequent ones outlive the rest
        self._new: dict[str, tuple[str, bytes]] = {}
        self._old: dict[str, tuple[str, bytes]] = {}
        self._room = cached
        # all tokens that may end a prefix; bytes stand as the code points of their values
        self._matcher = ahocorasick.Automaton()
        for r, t in self.bytes_of.items():
            if len(t) == 1 or self.halves(r):
                self._matcher.add_word(t.decode("latin-1"), (len(t), r))
        self._matcher.make_automaton()

    @cached_property
    def _starts(self) -> set[bytes]:
        """What a token starts with; only prefix tables of single pieces need it."""
        return {t[:k] for t in self.ranks for k in range(1, len(t) + 1)}

    def forget(self) -> None:
        """Empty the caches of words and pairs, which take several times as much as the rest."""
        self._new, self._old, self._pair = {}, {}, {}

    def merged(self, data: bytes, stop: int = 1) -> list[int]:
        """BPE from its definition: merge the neighbours of least rank, the leftmost first,
        down to so many tokens. Only the bytes of single tokens come here."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > stop:
            rank, k = min((self.ranks.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte, and for a
        token that BPE doesn't make of its own bytes, which then ends no prefix."""
        if token not in self._halves:
            t = self.bytes_of[token]
            two = self.merged(t, 2) if len(t) > 1 else []
            self._halves[token] = tuple(two) if len(two) == 2 and self.ranks.get(self.bytes_of[two[0]] + self.bytes_of[two[1]]) == token else None
        return self._halves[token]

    def follows(self, left: int, right: int) -> bool:
        """Whether BPE leaves the bytes of the two tokens as these two.

        Their last merges are undone, the later one first. While two parts faced each
        other, their own merge must not have been due before the next merge of either;
        of equal ranks the left place comes first."""
        if (known := self._pair.get((left, right))) is not None:
            return known
        a, b, until, ok = left, right, 1 << 60, True
        while True:
            r = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if r is not None and r < until:
                ok = False
                break
            later = a if a > b else b
            if (two := self.halves(later)) is None:
                break
            if later == b:
                until, b = b + 1, two[0]
            else:
                until, a = a, two[1]
        if len(self._pair) > 500_000:
            self._pair.clear()
        self._pair[left, right] = ok
        return ok

    def step(self, state: bytes, byte: bytes) -> bytes:
        """Aho-Corasick: the longest end of state + byte that a token starts with."""
        t = state + byte
        if (to := self._step.get(t)) is None:
            to = t
            while to not in self._starts:
                to = to[1:]
            self._step[t] = to
        return to

    def ends(self, state: bytes) -> tuple[tuple[int, int], ...]:
        """Lengths and ranks of the tokens that end in this state, longest first."""
        if (found := self._ends.get(state)) is None:
            found = []
            for k in range(len(state)):
                r = self.ranks.get(state[k:])
                if r is not None and (k == len(state) - 1 or self.halves(r)):
                    found.append((len(state) - k, r))
            found = self._ends[state] = tuple(found)
        return found

    def last_token(self, state: bytes, end: int, before) -> int:
        """The last token of the encoding of a prefix of length end; before(k): that of length k."""
        for n, r in self.ends(state):
            if n == end or self.follows(before(end - n), r):
                return r
        raise ValueError("the vocabulary lacks single bytes")

    def ids(self, data: bytes) -> list[int]:
        """Ids of a piece. The matcher gives the tokens that end at each place, longest
        first; the first that may follow the last token before it is the prefix's own."""
        last, pair, follows = [-1] * (len(data) + 1), self._pair, self.follows
        for end, (n, r) in self._matcher.iter(data.decode("latin-1")):
            end += 1
            if last[end] < 0:
                if n == end:
                    last[end] = r
                else:
                    left = last[end - n]
                    ok = pair.get((left, r))
                    if ok or ok is None and follows(left, r):
                        last[end] = r
        out, end = [], len(data)
        while end:
            out.append(t := last[end])
            end -= len(self.bytes_of[t])
        out.reverse()
        return out

    def encoded_piece(self, piece: str) -> tuple[str, bytes]:
        """Ids of a piece as text, joined by spaces, and the bytes that they decode to."""
        data = piece.encode("utf-8", "surrogatepass")
        r = self.ranks.get(data)
        if r is not None:
            return self.names[r], self.bytes_of[r]
        ids = self.ids(data)
        return " ".join([self.names[t] for t in ids]), b"".join([self.bytes_of[t] for t in ids])

    def encoded_word(self, word: str, pattern: str) -> tuple[str, bytes]:
        """The same for a word, split by the pattern; kept for words of usual length."""
        if (known := self._old.get(word)) is None:
            parts = pieces(word, pattern)
            known = self.encoded_piece(word) if len(parts) == 1 else joined([self.encoded_piece(x) for x in parts])
        if len(word) <= 64:
            if len(self._new) >= self._room:
                self._old, self._new = self._new, {}
            self._new[word] = known
        return known

    def encoded(self, text: str | None, pattern: str) -> tuple[str, bytes]:
        """The same for a text. A space between two characters that aren't white space
        starts a piece of PATTERN, whatever surrounds it, so such texts are cut there and whole
        words looked up; others, and all texts under another pattern, are split as a whole."""
        if not text:
            return "", b""
        words = pieces(text, pattern) if pattern != PATTERN or RUNS.search(text) or text[-1] == " " else text.replace(" ", "\0 ").split("\0") if "\0" not in text else pieces(text, pattern)
        if not words[0]:
            words = words[1:]
        get, miss = self._new.get, self.encoded_word
        found = []
        for w in words:
            if (x := get(w)) is None:
                x = miss(w, pattern)
                get = self._new.get
            found.append(x)
        return joined(found)


def joined(parts: list[tuple[str, bytes]]) -> tuple[str, bytes]:
    return " ".join([x[0] for x in parts]), b"".join([x[1] for x in parts])


class PrefixTable:
    """The last token of every prefix of one piece, with the automaton's states."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last, self.states = vocabulary, b"", [], []
        self.append(data)

    def _extend(self, end: int) -> None:
        self.states.append(self.v.step(self.states[-1] if self.states else b"", self.data[end - 1 : end]))
        self.last.append(self.v.last_token(self.states[-1], end, lambda k: self.last[k - 1]))

    def append(self, more: bytes) -> None:
        """Exact: entries of the old prefixes stay as they are."""
        self.data += more
        for end in range(len(self.last) + 1, len(self.data) + 1):
            self._extend(end)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put new for data[start:stop]; returns how many entries were worked out again."""
        last, states, shift = self.last, self.states, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last, self.states, same = last[:start], states[:start], 0
        for end in range(start + 1, len(self.data) + 1):
            self._extend(end)
            # an entry rests on the bytes and entries of the longest token before it
            if end - start > len(new):
                same = same + 1 if self.last[-1] == last[end - shift - 1] else 0
                if same >= self.v.longest:
                    self.last += last[end - shift :]
                    self.states += states[end - shift :]
                    return end - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        out, end = [], len(self.last)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.v.bytes_of[out[-1]])
        return out[::-1]


_LOADED: dict[str, Vocabulary] = {}


def loaded(path: str) -> Vocabulary:
    """One vocabulary a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(load_ranks(path))
    return _LOADED[path]


def encode(text: str | None, path: str, pattern: str) -> list[int]:
    return [int(x) for x in loaded(path).encoded(text, pattern)[0].split()]


def decode(ids: list[int], path: str) -> bytes:
    return b"".join(map(loaded(path).bytes_of.__getitem__, ids))


def op4_byte_bpe(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; with ids, the ids too.

    A null text counts as empty: no tokens and the digests of nothing. Rows are encoded
    one by one, so repeated rows and null ids get their own results. path is a file on
    every executor."""
    src = docs.select("doc_id", docs["text"].alias("__text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        v = loaded(path)
        for b in in_slices(batches):
            n, a, d, every = [], [], [], []
            for t in b.column(1).to_pylist():
                text_ids, decoded = v.encoded(t, pattern)
                n.append(text_ids.count(" ") + 1 if text_ids else 0)
                a.append(hashlib.sha256(text_ids.encode()).hexdigest())
                d.append(hashlib.sha256(decoded).hexdigest())
                if ids:
                    every.append([int(x) for x in text_ids.split()])
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(every, pa.list_(pa.int32()))] if ids else []), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids"] if ids else []))

    return src.mapInArrow(tidy(run, lambda: loaded(path).forget()), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else ""))
