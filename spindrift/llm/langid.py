"""Language identification by a string kernel with Nyström landmarks and kernel ridge regression.

The kernel of two texts is the number of 1- to 3-grams of letters that both hold
(presence, not counts), over the root of the product of how many each holds.
Landmarks are a sample of labelled rows; a text's features are its kernel values with
them, whitened; a ridge regression for each language against the rest is fitted
on these. The product of landmark presences, whitening and weights is one
matrix, so a batch of texts is scored by one product of its presence matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PIECE = 1 << 20
#: Up to so many possible grams their columns stand in an array, beyond they are searched for.
_DENSE = 1 << 22


class Grams:
    """Numbers the 1- to 3-grams of a text's letters; runs of other characters count as one space.

    ``letters`` are all that the labelled rows hold. Any other has number 1: no landmark has it, whichever it is.
    """

    def __init__(self, letters: str):
        self.numbers = np.frombuffer(_letter_table(), np.uint8).astype(np.int64 if len(letters) > 1000 else np.int32)
        for i, c in enumerate(letters):
            self.numbers[ord(c)] = i + 2
        self.letters, self.n = letters, len(letters) + 2  # 0: anything but letters
        self.space = self.n + self.n**2 + self.n**3

    def of(self, text: str) -> np.ndarray:
        """Gram numbers with repeats; empty if the text has no letter."""
        found = []
        text, a = text.lower(), self.n
        for at in range(0, len(text), _PIECE):
            c = self.numbers[np.frombuffer(text[max(0, at - 2) : at + _PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)]
            c = np.concatenate(([0], c, [0])).astype(c.dtype)
            c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]
            if len(c) > 2:
                two = c[:-1] * a + c[1:]
                found += [c[1:-1], two + a, two[:-1] * a + c[2:] + (a + a * a)]
        return np.concatenate(found) if found else np.empty(0, self.numbers.dtype)


_table: list[bytes] = []


def _letter_table() -> bytes:
    if not _table:
        table = np.zeros(0x110000, np.uint8)
        table[[i for i in range(0x110000) if chr(i).isalpha()]] = 1
        _table.append(table.tobytes())
    return _table[0]


class Model:
    """``weights`` has a row per gram that a landmark holds and a column per language."""

    def __init__(self, languages: list[str], letters: str, columns: np.ndarray, weights: np.ndarray):
        self.languages, self.letters, self.columns, self.weights = languages, letters, columns, weights
        self._grams: Grams | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_grams", "column_of")} | {"_grams": None}

    def _columns(self, grams: np.ndarray) -> np.ndarray:
        if self.column_of is not None:
            return self.column_of[grams]
        grams = np.unique(grams)
        at = np.searchsorted(self.columns, grams)
        return np.where(self.columns[np.minimum(at, len(self.columns) - 1)] == grams, at, len(self.columns)) if len(self.columns) else np.zeros(0, np.int64)

    def score(self, texts: list[str | None], batch: int = 128) -> tuple[list[str], np.ndarray]:
        """The language and a score of 0 to 1 for each text; ``und`` and 0 without letters."""
        if self._grams is None:
            self._grams = Grams(self.letters)
            self.column_of = None
            if self._grams.space <= _DENSE:
                self.column_of = np.full(self._grams.space, len(self.columns), np.int32)  # the last column takes all other grams
                self.column_of[self.columns] = np.arange(len(self.columns), dtype=np.int32)
        names, scores = [], np.zeros(len(texts))
        for at in range(0, len(texts), batch):
            part = texts[at : at + batch]
            seen = np.zeros((len(part), len(self.columns) + 1), np.float32)
            empty = []
            for i, t in enumerate(part):
                grams = self._grams.of(t or "")
                empty.append(not len(grams) or not self.languages)
                seen[i, self._columns(grams)] = 1
            seen = seen[:, :-1]
            if not self.languages:
                names += ["und"] * len(part)
                continue
            got = (seen @ self.weights) / np.sqrt(np.maximum(seen.sum(axis=1, keepdims=True), 1))
            best = got.argmax(axis=1)
            names += ["und" if e else self.languages[k] for e, k in zip(empty, best.tolist(), strict=True)]
            scores[at : at + len(part)] = np.where(empty, 0, np.clip(got.max(axis=1), 0, 1))
        return names, scores


def fit(labelled: DataFrame, per_language: int = 300, landmarks: int = 60, ridge: float = 1e-2) -> Model:
    """Fits on at most ``per_language`` rows of each language of ``labelled`` (``doc_id, text, lang``).

    The rows are those with the least hash of doc_id; the driver gets of each only
    which grams it holds, so at most languages x per_language x grams numbers.
    Rows with null lang or without letters teach nothing; without any other row the model knows no language.
    """
    known = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], "", np.empty(0, np.int64), np.empty((0, 0), np.float32))
    modulus = 1 << 40
    share = F.coalesce(*[F.when(F.col("lang") == name, F.lit(int(min(1.0, (per_language + 5 * per_language**0.5) / n) * modulus))) for name, n in counts.items()])
    drawn = known.withColumn("draw", F.pmod(F.xxhash64("doc_id"), F.lit(modulus))).where(F.col("draw") < share)

    def letters_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                total += np.bincount(np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32), minlength=0x110000)
        total *= np.frombuffer(_letter_table(), np.uint8)
        code = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], ["code", "n"])

    common = drawn.select("text").mapInArrow(letters_of, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "code").collect()  # an alphabet
    letters = "".join(chr(r["code"]) for r in common)

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(letters)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array([np.unique(grams.of(t)).astype(np.int64) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], ["doc_id", "lang", "draw", "grams"])

    rows = drawn.mapInArrow(presence, "doc_id long, lang string, draw long, grams array<long>").where(F.size("grams") > 0).collect()
    rows.sort(key=lambda r: (r["lang"], r["draw"], r["doc_id"]))
    languages, chosen = sorted({r["lang"] for r in rows}), []
    for name in languages:
        chosen.append([np.array(r["grams"]) for r in rows if r["lang"] == name][:per_language])
    if not languages:
        return Model([], letters, np.empty(0, np.int64), np.empty((0, 0), np.float32))
    marks = [g for own in chosen for g in own[:landmarks]]
    columns = np.unique(np.concatenate(marks))

    def matrix(sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), len(columns)), np.float32)
        for i, g in enumerate(sets):
            at = np.searchsorted(columns, g)
            at = at[(at < len(columns)) & (columns[np.minimum(at, len(columns) - 1)] == g)]
            out[i, at] = 1
        return out / np.sqrt(np.maximum(out.sum(axis=1, keepdims=True), 1))

    m, x = matrix(marks), matrix([g for own in chosen for g in own])
    values, vectors = np.linalg.eigh((m @ m.T).astype(np.float64))
    keep = values > 1e-6 * values[-1]
    white = vectors[:, keep] / np.sqrt(values[keep])
    features = (x @ m.T).astype(np.float64) @ white
    targets = np.repeat(np.eye(len(languages)), [len(own) for own in chosen], axis=0)
    balance = np.repeat([1 / len(own) for own in chosen], [len(own) for own in chosen])[:, None]  # each language counts alike
    solved = np.linalg.solve(features.T @ (balance * features) + ridge * np.eye(features.shape[1]) / len(languages), features.T @ (balance * targets))
    return Model(languages, letters, columns, (m.T @ (white @ solved)).astype(np.float32))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` per row of ``docs`` (``doc_id, text``).

    Null and empty texts and texts without letters are ``und`` with score 0. Equal texts
    get equal results, and of equal scores the first language by name is taken; repeated rows stay; other columns are never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # grams of landmarks x languages: bounded by the alphabet

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = shared.value.score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, min_score: float) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text is in a language of ``model`` with at least ``min_score``.

    A model that knows no language keeps every row with a letter. Null and empty texts and those without letters go. Equal texts, and so
    repeated rows, stay or go together; a score of just ``min_score`` stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            if shared.value.languages:
                names, scores = shared.value.score(texts)
                good = [n != "und" and s >= min_score for n, s in zip(names, scores.tolist(), strict=True)]
            else:
                good = [any(map(str.isalpha, t or "")) for t in texts]
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """The fold that no model is fitted on: crc32 of the id as text, 2 modulo 4."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """Fits on the labelled rows outside the held-out fold and predicts every row.

    Returns ``doc_id, held_out, lang_pred, score``. Nulls, ties and repeated rows as in ``predict``; an empty table stays empty.
    """
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
