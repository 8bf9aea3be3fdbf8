"""Operator 5, BPE encoding and decoding by prefix-sharing trie traversal.

The distinct new words of a run of texts go into a trie; their sorted order is its
depth-first order, so the traversal keeps one stack of states and each shared prefix is
computed once. The state of a prefix is the last token of its encoding: the one token that
ends there and may follow the last token of what precedes it. A word's ids are read back
from its states, last token first. Whether two tokens may stand side by side is decided by
undoing merges from the border outwards, latest first: an earlier merge across the border
would have won.

Texts are cut into words as the vocabulary file's own pre-tokenizer does: by an equal
pattern of the standard library for texts of plain Latin characters, else by the
tokenizers library's pre-tokenizer. Special tokens in a text are single ids.

Defined results: null text is an empty text (no ids); repeated rows and ids are encoded
row by row; an empty table gives no rows; only the id and the text column are read. The
vocabulary is read from ``path`` on every worker and never written.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import common as C

VOCABULARY = "byte_bpe_50k.json"
#: Words (and token pairs) kept per worker before the memory is dropped and filled anew.
KEEP_WORDS, KEEP_PAIRS = 400_000, 1_000_000
KEEP_LENGTH = 64
# characters for which the pattern below cuts exactly as the pre-tokenizer does
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
DIGITS = "0-9²³¹¼-¾"
UNUSUAL = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ‐-‧‰-⁞€]")
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+"
                    rf"| ?[^\s{LETTERS}{DIGITS}]+|\s+(?!\S)|\s+")


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves,
    the others follow from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Codec:
    """Byte-level BPE of one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        raw = {token: bytes(map(alphabet.__getitem__, token)) for token in vocab}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.bytes_of = {i: raw[t] for t, i in vocab.items()} | {
            i: t.encode() for t, i in self.special.items()}
        self.join: dict[tuple[int, int], int] = {}    # pair -> merged id
        self.parts: dict[int, tuple[int, int]] = {}   # id -> the pair it is made of
        self.rank: dict[int, int] = {}                # id -> when it is made; bytes at 0
        for n, (left, right) in enumerate(spec["model"]["merges"], 1):
            pair, made = (vocab[left], vocab[right]), vocab[left + right]
            self.join.setdefault(pair, made)
            if made not in self.parts:
                self.parts[made], self.rank[made] = pair, n
        self.pairs: dict[int, bool] = {}
        alive = {i for t, i in vocab.items() if len(raw[t]) == 1}
        for made, (a, b) in self.parts.items():   # in merge order: parts come first
            if a in alive and b in alive and self._borders(a, b, self.rank[made]):
                alive.add(made)
        self.token = {raw[t]: i for t, i in vocab.items() if i in alive}
        self.longest = max(map(len, self.token))
        self.words: dict[str, tuple[str, bytes]] = {}
        self.cutter = Tokenizer.from_file(path).pre_tokenizer

    def _borders(self, a: int, b: int, before: int = 1 << 60) -> bool:
        """Whether no merge across the border of ``a`` and ``b`` comes earlier than the merges
        that make them (and than ``before``). Of two equal merges the left one comes first."""
        rank, parts, join = self.rank, self.parts, self.join
        while True:
            across = join.get((a, b))
            if across is not None and rank[across] < before:
                return False
            ra, rb = rank.get(a, 0), rank.get(b, 0)
            if ra == rb == 0:
                return True
            if ra > rb:            # undo the later of the two
                before, a = ra, parts[a][1]
            else:                  # a merge across starts left of b's own, so it wins a tie
                before, b = rb + 1, parts[b][0]

    def _fits(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KEEP_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._borders(a, b)
        return known

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of distinct words, by a depth-first walk over their trie."""
        token, fits, longest = self.token, self._fits, self.longest
        previous, last = b"", [-1]      # last[i]: last token of the first i bytes
        for raw, word in sorted((w.encode(), w) for w in words):
            shared = len(os.path.commonprefix((previous, raw)))
            del last[shared + 1:]
            for end in range(shared + 1, len(raw) + 1):
                for start in range(max(0, end - longest), end):
                    t = token.get(raw[start:end])
                    if t is not None and (start == 0 or fits(last[start], t)):
                        last.append(t)
                        break
                else:
                    raise ValueError(f"no token of the vocabulary ends at byte {end} of {word!r}")
            previous, ids, at = raw, [], len(raw)
            while at:
                ids.append(last[at])
                at -= len(self.bytes_of[last[at]])
            yield word, ids[::-1]

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids; special tokens stand for their text."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def pieces(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        if UNUSUAL.search(text) is None:
            return PIECES.findall(text)
        return [text[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(text)]

    def split(self, text: str) -> list[str]:
        """Words of a text; a special token is a word of its own."""
        if self.cut_special is None or not any(s in text for s in self.special):
            return self.pieces(text)
        out: list[str] = []
        for k, part in enumerate(self.cut_special.split(text)):
            out += [part] if k % 2 else self.pieces(part)
        return out

    def encoded(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """(decimal ids joined by commas, decoded bytes) of every text."""
        split = [self.split(t) for t in texts]
        if len(self.words) > KEEP_WORDS:
            self.words.clear()
        new = set().union(*split).difference(self.words)
        found = {} if new else self.words
        marked = {s for s in self.special if s in new}
        for word in marked:
            found[word] = (str(self.special[word]), self.decode([self.special[word]]))
        for word, ids in self.encode_words(list(new - marked)):
            found[word] = (",".join(map(str, ids)), self.decode(ids))
        if new:
            known = {w: self.words[w] for w in set().union(*split) - new}
            self.words |= {w: v for w, v in found.items() if len(w) <= KEEP_LENGTH}
            found |= known
        for words in split:
            both = [found[w] for w in words]
            yield ",".join([x[0] for x in both]), b"".join([x[1] for x in both])


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a vocabulary file, loaded once."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_texts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row."""
    return _mapped(df, path, id_col, text_col, "ids array<int>", lambda ids, _: (
        list(map(int, ids.split(","))) if ids else [],))


def decode_ids(df: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows with an array of ids; bytes that are no UTF-8 become U+FFFD."""
    picked = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codec(path).decode(x or []).decode("utf-8", "replace") for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(texts, pa.string())], names=["id", "text"])

    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, text string")


def _mapped(df, path, id_col, text_col, fields, make):
    picked = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = f"id {picked.schema['id'].dataType.simpleString()}, {fields}"
    names = [f.split(" ")[0] for f in fields.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "array<int>": pa.list_(pa.int32())}
    types = [kinds[f.split(" ")[1]] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.text_slices(batch, "text", C.SLICE_BYTES):
                texts = [t or "" for t in part["text"].to_pylist()]
                rows = [make(*x) for x in codec(path).encoded(texts)]
                yield pa.RecordBatch.from_arrays(
                    [part["id"], *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))],
                    names=["id", *names])

    return picked.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    def make(ids: str, raw: bytes):
        text = raw.decode("utf-8", "replace").encode()
        return (ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(),
                hashlib.sha256(text).hexdigest())

    return _mapped(df, path, id_col, text_col, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: token count and digests of every document."""
    out = digests(C.table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return out.withColumnRenamed("id", "doc_id")
