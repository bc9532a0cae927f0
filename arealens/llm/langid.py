"""Language identification by error-correcting output codes over byte n-gram counts.

Each language has a codeword of bits; for each bit a linear classifier over hashed byte trigrams (log odds of
the languages with the bit against those without) gives a margin. The losses of all margins against a codeword,
weighted by how well each classifier separates, decide; a text whose best two codewords lie close is flagged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 13
BUCKETS = 1 << BITS
SHARPNESS = 6.0  # margins are mean log odds a trigram, of size 0.1 to 1
AMBIGUOUS = 0.15  # least gap of the two best losses, in units of the total weight
UNKNOWN = "und"
UNIT = 1 << 20  # log odds are whole numbers of its reciprocal, so sums do not depend on where a text is cut
CUT = 1 << 20  # bytes whose log odds are held at a time


def _buckets(data: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that starts at each byte but the last two."""
    x = data.astype(np.uint32)
    mixed = (x[:-2] | (x[1:-1] << 8) | (x[2:] << 16)) * np.uint32(0x9E3779B1)
    return mixed >> np.uint32(32 - BITS)


def _slices(batch: pa.RecordBatch, column: int, most: int = 1 << 22) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, stop row, bytes, row starts) for runs of rows of about ``most`` bytes; nulls are empty."""
    text = pa.array(batch.column(column).fill_null("").cast(pa.large_binary()))
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(text):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, stop, data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at]
        at = stop


def code_matrix(languages: int, seed: int = 5) -> np.ndarray:
    """Codewords of +1 and -1 (row a language): all splits for up to five languages, else random ones far apart."""
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= 5:
        splits = np.arange(1, 1 << (languages - 1))
        return np.where((splits[None, :] << 1 >> np.arange(languages)[:, None]) & 1, 1.0, -1.0)
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(languages)))
    best, far = None, -1.0
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (languages, width))
        code = code[:, np.abs(code.sum(axis=0)) < languages]
        near = ((code[:, None, :] != code[None, :, :]).sum(axis=2) + languages * width * np.eye(languages)).min()
        if near > far:
            best, far = code, near
    return best


def trigram_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, bucket, n) over all rows with a lang; each task adds up what it reads, so a large language is no large group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            for low, stop, data, starts in _slices(batch, 1):
                if len(data) < 3:
                    continue
                bucket = _buckets(data)
                inside = np.ones(len(bucket), bool)
                for back in (1, 2):
                    cut = starts[1:-1] - back
                    inside[cut[(cut >= 0) & (cut < len(bucket))]] = False
                present = sorted(set(names[low:stop]))
                code = np.array([present.index(x) for x in names[low:stop]], np.int64)
                owner = np.repeat(code, np.diff(starts))[: len(bucket)]
                summed = np.bincount((owner * BUCKETS + bucket)[inside], minlength=len(present) * BUCKETS).reshape(-1, BUCKETS)
                for x, row in zip(present, summed, strict=True):
                    total[x] = total.get(x, 0) + row
        for x, row in total.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at].astype(np.int64))], ["lang", "bucket", "n"])

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.lower(text).alias("text"))
    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class CodeClassifier:
    """One linear classifier a bit, from trigram counts by language; languages count alike, however many their rows."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages, self.code = languages, code_matrix(len(languages))
        share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True) if len(languages) else counts
        bits = self.code.shape[1] if len(languages) else 0
        self.odds, self.weight = np.zeros((bits, BUCKETS), np.int32), np.ones(bits)
        for b in range(bits if len(languages) > 1 else 0):
            plus, minus = share[self.code[:, b] > 0].mean(axis=0), share[self.code[:, b] < 0].mean(axis=0)
            odds = np.log(plus / minus)
            self.odds[b] = np.round(odds * UNIT)
            self.weight[b] = ((plus - minus) * odds).sum()  # how far the two sides' mean margins lie apart
        self.weight = self.weight / self.weight.sum() if bits else self.weight

    def margins(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Mean log odds of each text's trigrams (row a text, column a bit), bit by bit over CUT bytes at a time."""
        total = np.zeros((len(starts) - 1, len(self.odds)), np.int64)
        for low in range(0, max(len(data) - 2, 0), CUT):
            bucket = _buckets(data[low : low + CUT + 2])
            begin = np.clip(starts[:-1] - low, 0, len(bucket))
            end = np.maximum(begin, np.clip(starts[1:] - 2 - low, 0, len(bucket)))
            own = np.flatnonzero(end > begin)
            for b, odds in enumerate(self.odds):
                upto = np.concatenate([[0], np.cumsum(odds[bucket], dtype=np.int64)])
                total[own, b] += upto[end[own]] - upto[begin[own]]
        return total / UNIT / np.maximum(np.diff(starts)[:, None] - 2, 1)

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of each codeword for rows of margins."""
        return (np.logaddexp(0, -SHARPNESS * margins[:, None, :] * self.code[None, :, :]) * self.weight).sum(axis=2)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> CodeClassifier:
    """Classifiers from all rows of ``docs`` with a text and a lang; the driver gets languages x 8192 numbers."""
    found = trigram_counts(docs, text, lang).toPandas()
    languages = sorted(found["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    place = {x: i for i, x in enumerate(languages)}
    counts[found["lang"].map(place).to_numpy(int), found["bucket"].to_numpy(int)] = found["n"].to_numpy()
    return CodeClassifier(languages, counts)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, model: CodeClassifier, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and ambiguous (boolean).

    Whole texts are read. Null texts, texts without a letter, and all texts where no language was learned get ``und`` and
    score 0, and are not ambiguous. Rows are judged alone, so repeated rows agree; other columns pass through and
    columns of the new names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "ambiguous")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred:string,score:double,ambiguous:boolean>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        own = shared.value
        names, scores, close = [], [], []
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["t"])
        for _, _, data, starts in _slices(batch, 0):
            n = np.diff(starts)
            loss = own.losses(own.margins(data, starts))
            order = np.sort(loss, axis=1)
            odds_of = np.exp(-SHARPNESS * (loss - loss.min(axis=1, keepdims=True)))
            best = loss.argmin(axis=1)
            names += [own.languages[i] for i in best]
            scores.append(1 / odds_of.sum(axis=1))
            close.append(order[:, 1] - order[:, 0] < AMBIGUOUS if order.shape[1] > 1 else np.zeros(len(n), bool))
        return pd.DataFrame({"lang_pred": names, "score": np.concatenate(scores) if scores else [], "ambiguous": np.concatenate(close) if close else []})

    if not model.languages:
        return docs.select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"))
    known = F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False))
    judged = docs.withColumn("_k", known).withColumn("_j", judge(F.lower(F.coalesce(F.col(text), F.lit("")))))
    return judged.select(
        *docs.columns,
        F.when(F.col("_k"), F.col("_j.lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("_k"), F.col("_j.score")).otherwise(0.0).alias("score"),
        (F.col("_k") & F.col("_j.ambiguous")).alias("ambiguous"),
    )
