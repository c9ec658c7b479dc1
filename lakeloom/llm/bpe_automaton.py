"""Operator 4: byte-level BPE by a token automaton.

The merges of a byte-level vocabulary are compiled, one after the other, into a deterministic
automaton over tokens whose only path for a byte string is the string's BPE encoding. The state
after a token depends on that token alone. The gadget of merge number k, (u, v) -> w,

* gives u a new state, a copy of its old one without the arc v (u followed by v is now w),
* adds the arc w wherever the arc u leads to a state that has the arc v, and
* lets w end in the state that v ended in just before.

States are therefore kept as what each gadget took away: ``cut[u, v] = k``. An arc is looked up
along the copies (the right parts of the token before, the left parts of the arc's token), and each
answer is kept in a table. The byte strings of all tokens form a transition table, so that one pass
over a word finds the path; decoding emits the byte labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from itertools import chain

import regex
from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm import _common as C

#: White space as Unicode defines it (the separators 1C-1F are not in it).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def split_pattern(letters: str, numbers: str, space: str) -> str:
    """How byte-level vocabularies split text before merging (fixed by the format)."""
    return rf"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"


SPLIT = regex.compile(split_pattern(r"\p{L}", r"\p{N}", SPACE))
#: The same up to U+024F, where the classes are short ranges and the standard module is twice as fast.
SPLIT_LATIN = re.compile(split_pattern("A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\\t-\\r \x85\xa0"))
NOT_LATIN = re.compile("[^\x00-\u024f]")
#: Bytes of each of the two generations of encoded words that a worker remembers.
MEMO_BYTES = 96 << 20
#: Longer words (in characters) are encoded anew each time.
MEMO_WORD = 64


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in such vocabularies: itself if it is visible, else the next from U+0100."""
    out, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(spare)], spare = b, spare + 1
    return out


class Automaton:
    """Compiled from the content of a tokenizer file (model BPE, byte level)."""

    def __init__(self, content: dict):
        symbols, vocab = byte_symbols(), content["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.labels = {i: bytes(symbols[c] for c in s) for s, i in vocab.items() if s not in self.specials}
        self.labels |= {i: s.encode() for s, i in self.specials.items()}
        self.cut: dict[tuple[int, int], int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born: dict[int, int] = {}
        live = {vocab[s] for s in symbols if s in vocab}
        for k, merge in enumerate(content["model"]["merges"]):
            self._gadget(k, vocab[merge[0]], vocab[merge[1]], vocab[merge[0] + merge[1]], live)
        self.step: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for t in live:
            node = 0
            for b in self.labels[t]:
                at = node << 8 | b
                if (node := self.step.get(at, -1)) < 0:
                    node = self.step[at] = len(self.ends)
                    self.ends.append(-1)
            self.ends[node] = t
        self.arcs: dict[int, bool] = {}
        self.decimal = {i: str(i).encode() for i in self.labels}

    def _gadget(self, k: int, u: int, v: int, w: int, live: set[int]) -> None:
        if u in live and v in live and w not in live and self.has_arc(u, v):
            self.cut[u, v] = k
            self.left[w], self.right[w], self.born[w] = u, v, k
            live.add(w)

    def has_arc(self, before: int, token: int) -> bool:
        """Whether the state after `before` has an arc `token`."""
        cut, born, time = self.cut, self.born, 1 << 60
        while True:
            q, until = before, time
            while True:
                if cut.get((q, token), 1 << 61) <= until:
                    return False
                if q not in born:
                    break
                until, q = min(until, born[q] - 1), self.right[q]
            if token not in born:
                return True
            time, token = min(time, born[token]), self.left[token]

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        n, step, ends, arcs = len(word), self.step, self.ends, self.arcs
        last, back = [-1] * (n + 1), [0] * (n + 1)
        for s in range(n):
            before, node = last[s], 0
            for j in range(s, n):
                node = step.get(node << 8 | word[j], -1)
                if node < 0:
                    break
                if (t := ends[node]) >= 0 and last[j + 1] < 0:
                    if s:
                        if (ok := arcs.get(key := before << 20 | t)) is None:
                            ok = self.has_arc(before, t)
                            if len(arcs) > 3_000_000:
                                arcs.clear()
                            arcs[key] = ok
                        if not ok:
                            continue
                    last[j + 1], back[j + 1] = t, s
        out, i = [], n
        while i:
            out.append(last[i])
            i = back[i]
        return tuple(out[::-1])

    def decode(self, ids) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    with open(path, encoding="utf-8") as f:
        return Automaton(json.load(f))


class Memo:
    """What was worked out for keys, in two generations bounded by bytes: the older one goes when the younger one is full."""

    def __init__(self):
        self.young, self.old, self.bytes = {}, {}, 0

    def keep(self, key, value, cost: int) -> None:
        """cost is what key and value take, in bytes."""
        self.young[key] = value
        self.bytes += cost
        if self.bytes > MEMO_BYTES:
            self.young, self.old, self.bytes = {}, self.young, 0


@lru_cache(maxsize=2)
def _memo(path: str) -> Memo:
    return Memo()


def encode_words(words: list[str], path: str) -> list[int]:
    """Ids of words as the split pattern gives them, one after the other."""
    memo = _memo(path)
    try:
        return list(chain.from_iterable(map(memo.young.__getitem__, words)))
    except KeyError:
        pass
    fsm, here = automaton(path), {}
    for w in words:
        if w in here:
            continue
        if (ids := memo.young.get(w) or memo.old.get(w)) is None:
            ids = fsm.encode_word(w.encode("utf-8", "surrogatepass"))
        here[w] = ids
        if len(w) <= MEMO_WORD and w not in memo.young:
            memo.keep(w, ids, 200 + 4 * len(w) + 8 * len(ids))  # objects' heads, characters, places of ids
    return list(chain.from_iterable(map(here.__getitem__, words)))


def encode(text: str, path: str, specials: bool = True) -> list[int]:
    """Ids of a whole text; a special token's string in it becomes that token, or with specials=False is text like any other."""
    fsm = automaton(path)
    present = [s for s in fsm.specials if s in text] if specials else []
    parts = regex.split("(" + "|".join(map(regex.escape, sorted(present, key=len, reverse=True))) + ")", text) if present else [text]
    out: list[int] = []
    for i, part in enumerate(parts):
        if i % 2:
            out.append(fsm.specials[part])
            continue
        ids = encode_words((SPLIT if NOT_LATIN.search(part) else SPLIT_LATIN).findall(part), path)
        out = out + ids if out else ids
    return out


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """(id_col, ids array<int>, and with texts: decoded string) of each row; a null text is the empty one.

    Every row gives one row: empty texts give an empty array, repeated rows repeat, ids may be null or
    tie, further columns of any name are left out, an empty table gives an empty one.
    """

    def rows(keys, values):
        fsm = automaton(path)
        ids = [encode(t or "", path) for t in values]
        return [keys, ids, *([[fsm.decode(x) for x in ids]] if texts else [])]

    kind = dict(df.dtypes)[id_col].replace("bigint", "long")
    return C.per_batch(df, [id_col, text_col], f"{id_col} {kind}, ids array<int>" + ", decoded string" * texts, rows)


def token_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_documents() and its decoding as digests, made where the ids are (they don't travel)."""

    def rows(keys, values):
        fsm, n, ids_sha, text_sha = automaton(path), [], [], []
        for t in values:
            ids = encode(t or "", path)
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(b",".join(map(fsm.decimal.__getitem__, ids))).hexdigest())
            text_sha.append(hashlib.sha256(fsm.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
        return [keys, n, ids_sha, text_sha]

    kind = dict(df.dtypes)[id_col].replace("bigint", "long")
    return C.per_batch(df, [id_col, text_col], f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", rows)


def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded by the automaton of byte_bpe_50k.json."""
    return token_digests(C.dealt(spark, sf_dir, "documents"), C.tokenizer_file("byte_bpe_50k.json"))
