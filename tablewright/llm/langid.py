"""Language identification: sparse multinomial logistic regression on character n-grams.

Every text is lower-cased and its characters are read as words between single
spaces; n-grams of one to three characters are hashed to a fixed number of
buckets. A feature is tf * idf, where tf is the share of the text's n-grams of
that order and idf comes from the document frequencies over all training
documents. Weights are learnt with follow-the-regularised-leader (per-coordinate
rates, L1 and L2 penalties), which leaves most of them exactly zero; the scores
are then calibrated by one temperature, fitted on rows kept from the fit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import crc_rest, load

#: Training rows that the fit reads at most, for each language: bounds the driver's memory.
SAMPLE_ROWS = 1500
BITS = 16
ORDERS = (1, 2, 3)
UNKNOWN = "und"


def _letter_table() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


_LETTER = _letter_table()
_SLOTS = 1 << BITS


def code_points(text: str) -> np.ndarray:
    """Lower-cased letters with every run of anything else as one space; padded."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[cp]
    out = np.where(letter, cp, np.uint32(32))
    first = np.ones(len(out), bool)
    first[1:] = letter[1:] | letter[:-1]
    out = out[first]
    return np.concatenate([[32], out, [32]]).astype(np.uint32)


def buckets(cp: np.ndarray) -> list[np.ndarray]:
    """The bucket of every n-gram, one array for each order."""
    out = []
    acc = np.zeros(len(cp), np.uint32)
    for n in ORDERS:
        m = len(cp) - n + 1
        if m <= 0:
            out.append(np.zeros(0, np.int64))
            continue
        acc = (acc[:m] + cp[n - 1: n - 1 + m]) * np.uint32(0x9E3779B1)
        acc = acc ^ (acc >> np.uint32(15))
        out.append((((acc + np.uint32(n)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.int64))
    return out


def has_letter(cp: np.ndarray) -> bool:
    return bool((cp != 32).any())


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (slots, languages): idf * weight
    bias: np.ndarray
    temperature: float

    def logits(self, text: str | None) -> np.ndarray | None:
        """None if there is nothing to judge."""
        if not text:
            return None
        cp = code_points(text)
        if not has_letter(cp):
            return None
        total = self.bias.copy()
        for b in buckets(cp):
            if len(b):
                counts = np.bincount(b, minlength=_SLOTS) if len(b) > _SLOTS // 4 else None
                total = total + ((counts @ self.table) if counts is not None else self.table[b].sum(axis=0)) / len(b)
        return total


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares) of a text: at most one entry for each bucket and order, however long it is."""
    cp = code_points(text)
    idx, val = [np.zeros(0, np.int64)], [np.zeros(0)]
    for b in buckets(cp) if has_letter(cp) else ():
        if len(b):
            u, c = np.unique(b, return_counts=True)
            idx.append(u)
            val.append(c / len(b))
    return np.concatenate(idx), np.concatenate(val)


def fit(samples: list[tuple[np.ndarray, np.ndarray, str]], df: np.ndarray, n_docs: int, *, alpha: float = 8.0, beta: float = 1.0, l1: float = 2e-4, l2: float = 1e-3, epochs: int = 2) -> Model:
    """FTRL-proximal over the rows in order; every tenth row calibrates the temperature."""
    samples = [s for s in samples if len(s[0])]
    languages = sorted({s[2] for s in samples})
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    rows = [(idx, val * idf[idx], languages.index(lang)) for idx, val, lang in samples]
    k = len(languages)
    z, n, bias = np.zeros((_SLOTS, k)), np.zeros((_SLOTS, k)), np.zeros(k)

    def weights(idx: np.ndarray) -> np.ndarray:
        zi = z[idx]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[idx])) / alpha + l2))

    fitted = [r for i, r in enumerate(rows) if i % 10] or rows
    for _ in range(epochs):
        for idx, val, y in fitted:
            w = weights(idx)
            p = _softmax(val @ w + bias)
            p[y] -= 1
            g = val[:, None] * p[None, :]
            g2 = g * g
            sigma = (np.sqrt(n[idx] + g2) - np.sqrt(n[idx])) / alpha
            np.add.at(z, idx, g - sigma * w)
            np.add.at(n, idx, g2)
            bias -= 0.05 * p
    table = weights(np.arange(_SLOTS))
    model = Model(languages, table * idf[:, None], bias, 1.0)
    held = rows[::10]
    if held and k > 1 and len(rows) >= 20:
        logits = np.stack([val @ table[idx] + bias for idx, val, _ in held])
        y = np.array([r[2] for r in held])
        grid = np.exp(np.linspace(np.log(0.02), np.log(50), 120))
        loss = [-np.log(_softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def _document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """For each bucket, in how many of all rows it occurs; and the number of rows."""

    def count(batches):
        df, n, seen = np.zeros(_SLOTS, np.int64), 0, np.zeros(_SLOTS, bool)
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                n += 1
                for b in buckets(code_points(text or "")):
                    seen[b] = True
                at = np.flatnonzero(seen)
                df[at] += 1
                seen[at] = False
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n))], ["bucket", "n"])

    # At most one row a bucket comes to the driver.
    got = rows.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    at, n = np.asarray(got.column(0)), np.asarray(got.column(1))
    df = np.zeros(_SLOTS)
    df[at[at >= 0]] = n[at >= 0]
    return df, int(n[at < 0].sum())


def identify_language(documents: DataFrame, training: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id_col, the ``keep`` columns, lang_pred, score in [0, 1].

    ``training`` has text_col and lang_col; rows where either is null are not
    learnt from. Document frequencies count all its rows; weights are fitted on
    at most about ``sample_rows`` whole texts of each language, taken by a hash
    of their id. A null text, a text without letters, and every text if nothing
    could be learnt, get ``und`` and score 0. Repeated rows are judged alike, and texts of any length whole.
    """
    spark = documents.sparkSession
    usable = training.select(F.xxhash64(F.col(id_col), F.lit(8)).alias("u"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    df, n_docs = _document_frequencies(usable.select("text"))
    # A share of each language's hash range holds about sample_rows rows.
    share = [(r.lang, min(1.0, sample_rows / r.n)) for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    bounds = spark.createDataFrame(share or [("", 0.0)], "lang string, share double")
    position = (F.shiftrightunsigned("u", 11).cast("double")) / F.lit(float(1 << 53))
    taken = usable.join(F.broadcast(bounds), "lang").where(position < F.col("share")).select("u", "lang", "text")

    def measure(batches):
        for batch in batches:
            got = [features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([i.astype(np.int32) for i, _ in got], pa.list_(pa.int32())), pa.array([v for _, v in got], pa.list_(pa.float64()))], ["u", "lang", "idx", "val"])

    sample = taken.mapInArrow(measure, "u long, lang string, idx array<int>, val array<double>").limit(2 * sample_rows * max(1, len(share))).toArrow().sort_by([("u", "ascending"), ("lang", "ascending")])
    rows = [(np.asarray(i.values, np.int64), np.asarray(v.values), lang) for i, v, lang in zip(sample.column("idx"), sample.column("val"), sample.column("lang").to_pylist())]
    model = fit(rows, df, n_docs)
    model.table = model.table.astype(np.float32)
    shared = spark.sparkContext.broadcast(model)
    source = documents.select(F.col(id_col), *[F.col(c) for c in keep if c != id_col], F.col(text_col).cast("string").alias("__text"))
    passed = source.columns[:-1]

    def predict(batches):
        m = shared.value
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(batch.num_columns - 1):
                z = m.logits(text.as_py()) if m.languages else None
                if z is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    p = _softmax(z / m.temperature)
                    langs.append(m.languages[int(p.argmax())])
                    scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*passed, "lang_pred", "score"])

    return source.mapInArrow(predict, source.select(*passed).schema.add("lang_pred", "string").add("score", "double"))


def op8_langid(spark, sf_dir: str) -> DataFrame:
    """Every document's language, learnt from three quarters of the documents."""
    documents = load(spark, sf_dir, "documents")
    training = documents.where(crc_rest("doc_id", 4) != 2)
    out = identify_language(documents, training)
    return out.select("doc_id", (crc_rest("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
