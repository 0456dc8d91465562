"""Language identification with hyperdimensional letter profiles (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, release, slices
from .near_dup import mixed

DIM = 512
SEED = 20_177
CP_BITS = 21
MOST_BOUND = 1 << 17  # trigram vectors that a worker keeps (67 MB); beyond that it starts anew


def _fold_table() -> np.ndarray:
    """The lower-case code point of every letter, 0 for the rest."""
    fold = np.zeros(0x110000, np.int64)
    for cp in range(0x110000):
        if not 0xD800 <= cp < 0xE000 and chr(cp).isalpha():
            fold[cp] = ord(chr(cp).lower()[0])
    return fold


def letters(cps: np.ndarray) -> np.ndarray:
    """Bipolar vectors of letters, one a row: ``DIM`` bits of a mixing function of the code point, so no two letters share theirs.

    Code point 0 stands for any run of non-letters.
    """
    words = mixed((cps.astype(np.uint64)[:, None] + np.uint64(SEED)) * np.uint64(DIM // 64) + np.arange(DIM // 64, dtype=np.uint64))
    words = mixed(words * np.uint64(0x9E3779B97F4A7C15))
    return np.unpackbits(words.astype("<u8").view(np.uint8), axis=1, bitorder="little").astype(np.int8) * 2 - 1


class Encoder:
    """Binds permuted letter vectors to trigram vectors, on demand, and bundles those of texts."""

    def __init__(self) -> None:
        self.fold = _fold_table()
        self._forget()

    def _forget(self) -> None:
        self.kinds, self.row = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.vectors = np.zeros((4096, DIM), np.int8)

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams of a text and their counts, with runs of non-letters as one gap; none if it has no letter."""
        cps = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        ids = self.fold[cps]
        if not ids.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids = np.concatenate([[0], ids, [0]])
        ids = ids[np.concatenate([[True], (ids[1:] != 0) | (ids[:-1] != 0)])]
        return np.unique((ids[:-2] << 2 * CP_BITS) | (ids[1:-1] << CP_BITS) | ids[2:], return_counts=True)

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Rows of ``vectors`` for distinct sorted trigrams; new ones are bound first."""
        at = np.searchsorted(self.kinds, codes)
        known = np.zeros(len(codes), bool)
        inner = at < len(self.kinds)
        known[inner] = self.kinds[at[inner]] == codes[inner]
        new = codes[~known]
        if len(new):
            if len(self.kinds) and len(self.kinds) + len(new) > MOST_BOUND:
                self._forget()
                return self.rows(codes)
            bound = len(self.kinds)
            upto = bound + len(new)
            if upto > len(self.vectors):
                grown = np.zeros((upto * 3 // 2, DIM), np.int8)
                grown[:bound] = self.vectors[:bound]
                self.vectors = grown
            mask = (1 << CP_BITS) - 1
            a, b, c = (letters(x & mask) for x in (new >> 2 * CP_BITS, new >> CP_BITS, new))
            self.vectors[bound:upto] = np.roll(a, 2, axis=1) * np.roll(b, 1, axis=1) * c
            self.kinds = np.insert(self.kinds, at[~known], new)
            self.row = np.insert(self.row, at[~known], np.arange(bound, upto))
            at = np.searchsorted(self.kinds, codes)
        return self.row[at]

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of trigram vectors, each as often as its count."""
        total = np.zeros(DIM)
        for a in range(0, len(codes), 8192):
            at = self.rows(codes[a : a + 8192])
            total += (counts[a : a + 8192].astype(np.float32) @ self.vectors[at].astype(np.float32)).astype(np.float64)
        return total


_ENCODER: Encoder | None = None


def encoder() -> Encoder:
    """One encoder a worker process; it depends on constants alone."""
    global _ENCODER
    if _ENCODER is None:
        _ENCODER = Encoder()
    return _ENCODER


@dataclass(frozen=True)
class Prototypes:
    """Unit bundles of the languages, in the order of ``langs``."""

    langs: tuple[str, ...]
    matrix: np.ndarray


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = encoder()
    totals: dict[str, np.ndarray] = {}
    for batch in slices(batches):
        found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            grams = coder.grams(text)
            if len(grams[0]):
                found.setdefault(lang, []).append(grams)
        for lang, grams in found.items():  # texts of one language are bundled together
            codes, which = np.unique(np.concatenate([c for c, _ in grams]), return_inverse=True)
            counts = np.bincount(which, np.concatenate([n for _, n in grams])).astype(np.int64)
            totals[lang] = totals.get(lang, 0) + np.rint(coder.bundle(codes, counts)).astype(np.int64)
    for lang, total in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(total)], names=["lang", "dim", "v"])
    release()


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Prototypes:
    """Prototypes from all labelled rows with a text.

    Bundling is a sum, so each partition sends ``DIM`` whole numbers a language and the driver gets
    ``DIM`` times the number of languages, whatever the input. Rows without a text or label are passed over.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    )
    sums = rows.mapInArrow(_totals, "lang string, dim int, v long").groupBy("lang", "dim").agg(F.sum("v").alias("v")).collect()
    langs = tuple(sorted({r.lang for r in sums}))
    matrix = np.zeros((len(langs), DIM))
    for r in sums:
        matrix[langs.index(r.lang), r.dim] = r.v
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return Prototypes(langs, matrix / np.where(norm > 0, norm, 1))


def predict(docs: DataFrame, model: Prototypes, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """Add ``lang_pred`` and ``lang_score`` (or the names ``out``): the language whose prototype has the largest cosine, and that cosine.

    The whole text is read, whatever its length. A null text, one without any letter, or a model without languages gives ``und``
    and 0; a negative cosine counts as 0; of equal cosines the language that comes first by name wins.
    Columns of the two names are replaced, all others pass through; an empty table gives an empty result.
    """
    names = [c for c in docs.columns if c not in out]
    langs, matrix = model.langs, model.matrix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder()
        for batch in slices(batches):
            pred, score = [], []
            for text in batch.column(at).to_pylist():
                codes, counts = coder.grams(text or "")
                if not len(codes) or not langs:
                    pred.append("und")
                    score.append(0.0)
                    continue
                v = coder.bundle(codes, counts)
                norm = float(np.linalg.norm(v))
                cos = matrix @ v / norm if norm else np.zeros(len(langs))
                best = int(np.argmax(cos))
                pred.append(langs[best])
                score.append(min(1.0, max(0.0, float(cos[best]))))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(names))), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                names=[*names, *out],
            )
        release()

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    given = docs.select(*names) if text_col in names else docs.select(*names, F.col(text_col).alias(free("_lang_text", names)))
    at = names.index(text_col) if text_col in names else len(names)
    return given.mapInArrow(run, f"{schema}, `{out[0]}` string, `{out[1]}` double")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of the id as text leaves 1 on division by 3; a null id does not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
