"""Dense features of texts, added up from remembered features of their white-space chunks."""

from __future__ import annotations

import re

import numpy as np

from reportloom.llm.bpe import Remembered

_words = re.compile(r"[^\W\d_]+").findall
_signs = re.compile(r"[^\w\s]").findall
# Letters broken up by digits or signs inside a word, or one letter four times in a row.
_broken = re.compile(r"[^\W\d_][\d@$*#+][^\W\d_]|[^\W\d_]\*{2,}|([^\W\d_])\1{3}").search
# Digits and signs that stand for letters; fixed values.
_STANDS_FOR = str.maketrans("013457@$!|+", "oieastasiit")
# Words of address in the four languages; fixed values.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer sie tu te toi ton ta tes "
    "vous votre vos tú ti tus usted ustedes vosotros vos os".split()
)
CHUNK_FIELDS = 12
# Word beginnings that may stand in a lexicon; inflected and compound words share them.
PREFIXES = (4, 6)


class ChunkFeatures:
    """Rows of chunk features under one lexicon (term -> weight; ``p:`` terms are prefixes)."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.rows = Remembered(self._row, 100_000)

    def _weight(self, word: str) -> float:
        get = self.lexicon.get
        return max(get("w:" + word, 0.0), *(get("p:" + word[:n], 0.0) for n in PREFIXES if len(word) > n), 0.0)

    def _row(self, chunk: str) -> bytes:
        words = _words(chunk)
        low = [w.lower() for w in words]
        signs = _signs(chunk)
        bangs = chunk.count("!") + chunk.count("?")
        weight = max(map(self._weight, low), default=0.0)
        broken = bool(_broken(chunk))
        plain = 0.0
        if broken and not weight:
            plain = max(map(self._weight, _words(chunk.lower().translate(_STANDS_FOR).replace("*", ""))), default=0.0)
        return np.array(
            [
                len(words),
                len(chunk),
                sum(map(str.isupper, "".join(words))),
                sum(len(w) > 1 and w.isupper() for w in words),
                bangs,
                len(signs) - bangs,
                sum(map(str.isdigit, chunk)),
                weight > 0,
                weight,
                any(w in SECOND_PERSON for w in low),
                broken,
                plain > 0,
            ],
            np.float32,
        ).tobytes()

    def table(self, text: str | None) -> tuple[list[str], np.ndarray]:
        chunks = (text or "").split()
        raw = b"".join(map(self.rows.__getitem__, chunks))
        return chunks, np.frombuffer(raw, np.float32).reshape(-1, CHUNK_FIELDS)


NEAR = 6
TOXIC_NAMES = (
    "hit_rate hit_weight hits near_second second_rate capitals upper_words bangs signs digits broken broken_hits log_words"
).split()


def toxic_row(table: np.ndarray) -> list[float]:
    """Lexicon densities, nearness to words of address, capitals, signs and obfuscation rates."""
    if not len(table):
        return [0.0] * len(TOXIC_NAMES)
    s = table.sum(axis=0, dtype=float)
    words, chars, n = max(s[0], 1), max(s[1], 1), len(table)
    hits = np.flatnonzero(table[:, 7])
    near = 0.0
    if len(hits) and s[9]:
        you = np.flatnonzero(table[:, 9])
        at = np.searchsorted(you, hits)
        gap = np.minimum(
            np.abs(hits - you[np.maximum(at - 1, 0)]), np.abs(you[np.minimum(at, len(you) - 1)] - hits)
        )
        near = float((gap <= NEAR).sum())
    return [
        s[7] / words, s[8] / words, s[7], near / words, s[9] / words, s[2] / chars, s[3] / words,
        s[4] / n, s[5] / n, s[6] / chars, s[10] / n, s[11] / n, float(np.log1p(s[0])),
    ]


QUALITY_NAMES = "capitals upper_words bangs signs digits word_size same_as_before distinct top_share log_words lines".split()


def quality_row(text: str | None, chunks: list[str], table: np.ndarray) -> list[float]:
    """Shouting, signs, repetition and shape of a text."""
    if not len(table):
        return [0.0] * len(QUALITY_NAMES)
    s = table.sum(axis=0, dtype=float)
    words, chars, n = max(s[0], 1), max(s[1], 1), len(chunks)
    seen: dict[str, int] = {}
    for c in chunks:
        seen[c] = seen.get(c, 0) + 1
    same = sum(a == b for a, b in zip(chunks, chunks[1:], strict=False))
    return [
        s[2] / chars, s[3] / words, s[4] / n, s[5] / n, s[6] / chars, chars / n, same / n,
        len(seen) / n, max(seen.values()) / n, float(np.log1p(n)), text.count("\n") / n,
    ]
