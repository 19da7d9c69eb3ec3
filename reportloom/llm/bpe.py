"""Exact BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word there is exactly one token that can end its encoding. An automaton
over the vocabulary names all tokens that are suffixes of a prefix; the one whose predecessor
(the last token of the shorter prefix) may stand beside it is the last token. Following the
last tokens back from the end of the word gives the ids.

Two tokens may stand side by side if no merge would have crossed their border. Along the border
stand the right spine of the left token and the left spine of the right one; a merge of a pair
of spine nodes crosses if it comes before either node is merged into its own parent.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from weakref import ref

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

_NEVER = 1 << 60
# Separators that only Python counts as white space, and the start of special tokens: a text
# with one of them is encoded in one piece.
_WHOLE = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
_WORD_END = "</w>"
# Texts (words, chunks) whose ids a worker remembers before it lets the older ones go.
REMEMBERED_WORDS = 400_000


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for b in range(256):
        letters.append(chr(b if b in shown else spare))
        spare += b not in shown
    return letters


def _char_class(wanted) -> str:
    """A regex class body of the code points up to the fast path's end that ``wanted`` accepts."""
    parts, start = [], None
    for c in range(_FAST_END + 2):
        hit = c <= _FAST_END and wanted(chr(c))
        if hit and start is None:
            start = c
        elif not hit and start is not None:
            parts.append(f"\\u{start:04x}-\\u{c - 1:04x}")
            start = None
    return "".join(parts)


# Unicode White_Space up to the last code point of the fast path; fixed values.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0"
# Scripts whose character classes no Unicode version has changed: Latin to Cyrillic.
_FAST_END = 0x52F


class WordSplitter:
    """The normal form and word rule of the tokenizer file, special tokens taken out first.

    Texts of Latin, Greek and Cyrillic letters take a regex; texts with any other character take
    the library's own normalizer and splitter, as character classes differ by Unicode version.
    """

    def __init__(self, path: str, spec: dict):
        letter = _char_class(lambda c: unicodedata.category(c)[0] == "L")
        number = _char_class(lambda c: unicodedata.category(c)[0] == "N")
        short = "'s|'t|'re|'ve|'m|'ll|'d"
        self.words = re.compile(
            f"{short}|[{letter}]+|[{number}]|[^{letter}{number}{_SPACE}]+"
        ).findall
        self.ascii_words = re.compile(rf"{short}|[a-z]+|[0-9]|[^a-z0-9\t-\r ]+").findall
        self.beyond = re.compile(f"[^\\0-\\u{_FAST_END:04x}]").search
        rule = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.normalize = Tokenizer.from_file(path).normalizer.normalize_str
        self.cut = pre_tokenizers.Split(Regex(rule), "removed", invert=True).pre_tokenize_str
        specials = [t["content"] for t in spec["added_tokens"]]
        self.specials = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_words(text.lower())
        if self.beyond(text) or "Σ" in text:
            return [w for w, _ in self.cut(self.normalize(text))]
        text = unicodedata.normalize("NFC", text).lower()
        return self.words(text)

    def __call__(self, text: str) -> list[str]:
        if "<|" not in text or self.specials is None:
            return self._plain(text)
        out: list[str] = []
        for i, part in enumerate(self.specials.split(text)):
            if i % 2:
                out.append(part)
            else:
                out += self._plain(part)
        return out


class WordBpe:
    """Vocabulary, merges and the per-prefix table of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = WordSplitter(path, spec)
        self.letters = _byte_letters()
        self.ending = {c: self._mark(c + _WORD_END) for c in self.letters}
        self.piece = {i: t for t, i in (self.vocab | self.special).items()}
        self.merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.automaton = None

    def prepare(self) -> None:
        """Ranks, spines and automaton: made when the first word is encoded."""
        merges, ids = self.merges, self.vocab
        self.merge_rank = {(ids[a], ids[b]): r for r, (a, b) in enumerate(merges)}
        parts = {ids[a + b]: (ids[a], ids[b], r) for r, (a, b) in enumerate(merges)}
        # Spines: (node, rank of the merge that takes it into its parent) from the token down.
        self.left_spine = {t: self._spine(t, parts, 0) for t in ids.values()}
        self.right_spine = {t: self._spine(t, parts, 1) for t in ids.values()}
        self._beside: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            marked = self._mark(token)
            self.automaton.add_word(marked, (i, len(marked)))
        self.automaton.make_automaton()

    @staticmethod
    def _spine(token: int, parts: dict, side: int) -> list[tuple[int, int]]:
        spine, absorbed = [(token, _NEVER)], _NEVER
        while token in parts:
            absorbed = parts[token][2]
            token = parts[token][side]
            spine.append((token, absorbed))
        return spine

    @staticmethod
    def _mark(token: str) -> str:
        """One symbol per letter: the last letter of a word is a symbol of its own."""
        if len(token) > len(_WORD_END) and token.endswith(_WORD_END):
            token = token[: -len(_WORD_END)]
            return token[:-1] + chr(ord(token[-1]) + 0x1000)
        return token

    def chunks(self, text: str) -> list[str]:
        """Pieces of ``text`` that encode on their own: no word spans white space."""
        if any(mark in text for mark in _WHOLE):
            return [text]
        return text.split()

    def may_stand_beside(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self._beside.get(key)
        if known is None:
            if len(self._beside) > 1_000_000:
                self._beside.clear()
            known = self._beside[key] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        rank = self.merge_rank.get
        for x, x_gone in self.right_spine[left]:
            for y, y_gone in self.left_spine[right]:
                r = rank((x, y))
                # At equal rank the leftmost pair merges first.
                if r is not None and r < x_gone and r <= y_gone:
                    return False
        return True

    def lettered(self, word: str) -> str:
        """One letter of the vocabulary's alphabet for each byte."""
        if word.isascii() and word.isprintable():
            return word
        return "".join([self.letters[b] for b in word.encode("utf-8")])

    def word_ids(self, word: str) -> list[int]:
        """Ids of one word of the split text (or of one special token)."""
        if word in self.special:
            return [self.special[word]]
        if self.automaton is None:
            self.prepare()
        word = self.lettered(word)
        text = word[:-1] + self.ending[word[-1]]
        last = [-1] * (len(text) + 1)
        back = [0] * (len(text) + 1)
        known = self._beside.get
        done = -1
        for end, (token, size) in self.automaton.iter(text):
            if end == done:
                continue
            start = end + 1 - size
            if start:
                key = last[start] << 32 | token
                holds = known(key)
                if holds is None:
                    holds = self.may_stand_beside(last[start], token)
                if not holds:
                    continue
            done = end
            last[end + 1] = token
            back[end + 1] = start
        ids = []
        at = len(text)
        while at:
            ids.append(last[at])
            at = back[at]
        return ids[::-1]

    def encode(self, text: str) -> list[int]:
        return [i for chunk in self.chunks(text) for word in self.split(chunk) for i in self.word_ids(word)]

    def decode(self, ids) -> str:
        """Token texts joined by a blank: the file names no decoder."""
        return " ".join([self.piece[i] for i in ids])


class Remembered(dict):
    """text -> ``make(text)`` for at most twice ``most`` texts.

    A full table becomes the older one, from which words still in use are taken back; so common
    words stay and memory is bounded.
    """

    def __init__(self, make, most: int = REMEMBERED_WORDS):
        super().__init__()
        self.make = make
        self.most = most
        Remembered.alive = [r for r in Remembered.alive if r() is not None] + [ref(self)]
        self.older: dict = {}

    alive: list[ref] = []

    @classmethod
    def keep_only(cls, *tables: "Remembered") -> None:
        """Empty all other tables of this worker: operators that ran before leave no memory taken."""
        for table in (r() for r in cls.alive):
            if table is not None and not any(table is t for t in tables):
                table.clear()
                table.older = {}
        gc.collect()
        pa.default_memory_pool().release_unused()
        # Freed blocks go back to the system; other C libraries do so by themselves.
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    def room(self, more: int = 1) -> None:
        if len(self) + more > self.most:
            self.older = dict(self)
            self.clear()

    def __missing__(self, word):
        self.room()
        value = self.older.get(word)
        if value is None:
            value = self.make(word)
        self[word] = value
        return value


_loaded: dict[str, dict] = {}


def tools(path: str) -> dict:
    """The tokenizer of ``path`` and its word tables, loaded once per Python worker."""
    if path not in _loaded:
        bpe = WordBpe(path)

        def texts_of_word(word: str) -> tuple[bytes, bytes]:
            ids = bpe.word_ids(word)
            return (
                (" ".join(map(str, ids)) + " ").encode(),
                (" ".join([bpe.piece[i] for i in ids]) + " ").encode("utf-8"),
            )

        words = Remembered(texts_of_word)

        def texts(chunk: str) -> tuple[bytes, bytes]:
            parts = [words[w] for w in bpe.split(chunk)]
            if len(parts) == 1:
                return parts[0]
            return b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])

        ids = Remembered(lambda chunk: [i for w in bpe.split(chunk) for i in bpe.word_ids(w)])
        _loaded[path] = {"bpe": bpe, "ids": ids, "texts": Remembered(texts), "words": words}
    return _loaded[path]


def encode_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): the token ids of each text and the text they decode to.

    A null text counts as empty: no ids and an empty decoded text. Null and repeated ids are
    kept row by row, an empty table gives an empty result, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tools(vocab_path)
        bpe, ids_of = t["bpe"], t["ids"]
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = [
                    [i for chunk in bpe.chunks(text or "") for i in ids_of[chunk]]
                    for text in part.column(1).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(rows, pa.list_(pa.int32())), pa.array(list(map(bpe.decode, rows)), pa.string())],
                    names=["key", "ids", "decoded"],
                )

    picked = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("body"))
    kind = picked.schema["key"].dataType.simpleString()
    return picked.mapInArrow(run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", id_col)


def encode_digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each text; same cases as above.

    The same encoding, but a chunk's part of both digests is remembered, so whole
    texts are joined and hashed without a list of ids per document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tools(vocab_path)
        chunks, look = t["bpe"].chunks, t["texts"].__getitem__
        Remembered.keep_only(t["texts"], t["words"])
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for text in batch.column(1).to_pylist():
                parts = list(map(look, chunks(text or "")))
                ids = b"".join([p[0] for p in parts])[:-1]
                decoded = b"".join([p[1] for p in parts])[:-1]
                counts.append(ids.count(b" ") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                decoded_sha.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                names=["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    picked = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("body"))
    kind = picked.schema["key"].dataType.simpleString()
    return picked.mapInArrow(
        run, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    ).withColumnRenamed("key", id_col)
