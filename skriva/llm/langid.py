"""Language identification: multinomial naive Bayes over hashed character n-grams.

Text is lower-cased by code point and whatever isn't a letter counts as a space; 2- and 3-grams of code
points are hashed to BUCKETS buckets. Counts by language are summed over all training rows; the matrix of
log probabilities (BUCKETS x languages, MOST_LANGUAGES at most) is broadcast and scored in numpy.

Null, empty or letterless text: und, score 0. No training rows: und for all. Ties go to the first language by
name. Equal rows count once each and get equal predictions; a text of any length is scored whole, a long one as
a piece of its own. Other columns aren't read; those asked for come back as they are, whatever their names. More
than MOST_LANGUAGES languages are an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

BUCKETS, ORDERS, SMOOTHING, MOST_LANGUAGES = 1 << 16, (2, 3), 0.5, 256
#: Bytes of text scored at once: each costs a row of the matrix for each order.
PIECE = 1 << 19
UNKNOWN = "und"
_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """Code point to its lower-case letter, 32 for what is none."""
    global _LETTERS
    if _LETTERS is None:
        made = np.full(0x32400, 32, np.uint32)
        for i in range(len(made)):
            if (c := chr(i)).isalpha():
                made[i] = ord(low) if len(low := c.lower()) == 1 else i
        _LETTERS = made
    return _LETTERS


def grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(letters, code points by row, for each order its buckets and their count by row)."""
    size = np.diff(np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[off])
    code = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    code = letters()[np.minimum(code, 0x323FF)]
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))
    made = []
    for k in ORDERS:
        h = np.full(max(0, len(code) - k + 1), k, np.uint32)
        for j in range(k):
            h = h * np.uint32(0x01000193) ^ code[j : j + len(h)]
        h = h * np.uint32(0x85EBCA6B)
        made.append(((h >> np.uint32(16))[left[: len(h)] >= k].astype(np.int64), np.maximum(size - k + 1, 0)))
    return code, size, made


def train(docs: DataFrame, label: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, BUCKETS + 1 rows of log probabilities; the last row holds the priors), from all rows of docs."""

    def counts(batches):
        seen: dict[str, np.ndarray] = {}
        for rows, buf, off in shared.pieces(batches):
            names = rows.column(0).to_pylist()
            made = grams(buf, off)[2]
            for name in dict.fromkeys(names):
                if name not in seen:
                    seen[name] = np.zeros(BUCKETS + 1, np.int64)
                own = np.array([x == name for x in names])
                for h, n in made:
                    seen[name][:BUCKETS] += np.bincount(h[np.repeat(own, n)], minlength=BUCKETS)
                seen[name][BUCKETS] += own.sum()
        for name, n in seen.items():
            yield shared.as_batch(["name", "n"], [[name], [n]], [pa.string(), pa.list_(pa.int64())])

    labelled = docs.filter(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("name"), F.col("text").cast("string").alias("text"))
    rows = shared.arrow(labelled, counts, "name string, n array<long>").select("name", F.posexplode("n").alias("bucket", "n"))
    summed = rows.filter("n > 0").groupBy("name", "bucket").agg(F.sum("n").alias("n"))
    packed = summed.groupBy("name").agg(F.collect_list(F.struct("bucket", "n")).alias("all")).limit(MOST_LANGUAGES + 1).toArrow().to_pylist()
    if len(packed) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    packed.sort(key=lambda r: r["name"])
    count = np.zeros((BUCKETS + 1, len(packed)))
    for i, r in enumerate(packed):
        count[[x["bucket"] for x in r["all"]], i] = [x["n"] for x in r["all"]]
    if not packed:
        return [], np.zeros((BUCKETS + 1, 0), np.float32)
    model = np.log((count[:BUCKETS] + SMOOTHING) / (count[:BUCKETS].sum(0) + SMOOTHING * BUCKETS))
    return [r["name"] for r in packed], np.vstack([model, np.log(count[BUCKETS] / count[BUCKETS].sum())]).astype(np.float32)


def score(buf: np.ndarray, off: np.ndarray, names: list[str], model: np.ndarray) -> tuple[list[str], np.ndarray]:
    code, size, made = grams(buf, off)
    some = shared.row_sums((code != 32).astype(np.int64), size) > 0
    if not names:
        return [UNKNOWN] * len(size), np.zeros(len(size))
    total = np.tile(model[BUCKETS].astype(np.float64), (len(size), 1))
    for h, n in made:
        total += shared.row_sums(model[h].astype(np.float64), n)
    best = total.argmax(1)
    sure = 1 / np.exp(np.minimum(total - total.max(1, keepdims=True), 0)).sum(1)
    return [names[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)], np.where(some, sure, 0.0)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], columns: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """columns of docs, lang_pred and score (or other names); the text is read and not returned unless it is among them."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    # the text travels once: under its own name if it is returned
    name = "text" if "text" in columns and dict(docs.dtypes)["text"] == "string" else "__text"
    picked = docs.select(*columns) if name == "text" else docs.select(*columns, F.col("text").cast("string").alias(name))

    def rows(batches):
        for rows, buf, off in shared.pieces(batches, name, PIECE):
            found, sure = score(buf, off, *known.value)
            kept = rows.select(columns)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.string()), pa.array(sure, pa.float64())], [*columns, *names])

    schema = docs.select(*columns).schema.add(names[0], "string").add(names[1], "double")
    return shared.arrow(picked, rows, schema)
