"""Language by error-correcting output codes over byte n-grams.

Every language has a codeword. For each bit a binary n-gram classifier tells the languages whose bit is set from
the others. A text's margins, as means of its n-grams, are compared with every codeword under a logistic loss; the
codeword of least loss names the language. How far the margins reach along that codeword is held against the same
figure of the language's learning rows: a text that falls far short, by more than its length explains, is foreign. It
is ambiguous if it is foreign or has a narrow lead over the next codeword.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobdelta.llm.common import bytes_of, fold, sized, texts_of

FOLDS, HELD_OUT = 4, 2
BUCKETS = 1 << 14  # of hashed n-grams
SIZES = (1, 2, 3, 4)
EXHAUSTIVE = 5  # languages up to which every distinct split becomes a bit
LONG_CODE = 31  # least bits of a codeword beyond
BITS_PER_DOUBLING = 12  # of the number of languages
SMOOTHING = 0.5
NARROW = 0.1  # lead in loss per bit below which a text is ambiguous
LEAST_REACH = 0.4  # of the language's usual reach, below which a text is foreign
SLACK = 1.0  # standard deviations of an n-gram, over the root of their number, that a short text may fall short
STEP = 1 << 18  # bytes of texts whose n-grams are made at once: they take some 200 bytes for each
UNKNOWN = "und"

# Letters of every script keep their bytes; A-Z in lower case; other ASCII becomes a blank.
_FOLDED = np.arange(256, dtype=np.uint32)
_FOLDED[:128] = 32
_FOLDED[97:123] = np.arange(97, 123)
_FOLDED[65:91] = np.arange(97, 123)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def codewords(languages: int) -> np.ndarray:
    """One row of -1 and 1 for each language.

    Few languages: all splits into two non-empty sides. More: of many random balanced codes the one whose closest
    rows are farthest apart, with bits that grow with the number of languages.
    """
    if languages <= 1:
        return np.ones((languages, 1), dtype=np.int8)
    if languages <= EXHAUSTIVE:
        bits = [[1] + [1 if split >> k & 1 else -1 for k in range(languages - 1)] for split in range(2 ** (languages - 1) - 1)]
        return np.asarray(bits, dtype=np.int8).T
    rng = np.random.default_rng(languages)
    bits = max(LONG_CODE, int(BITS_PER_DOUBLING * np.log2(languages)))
    best, apart = None, -1
    for _ in range(200):
        code = np.stack([rng.permutation(np.where(np.arange(languages) % 2, 1, -1)) for _ in range(bits)], axis=1).astype(np.int8)
        d = (bits - code.astype(int) @ code.T.astype(int)) // 2
        least = int(d[~np.eye(languages, dtype=bool)].min())
        if least > apart:
            best, apart = code, least
    return best


def grams(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of texts that lie one after the other in `data`, and the text of each.

    Runs of non-letters count as one blank, and n-grams stay inside a text.
    """
    x = _FOLDED[data]
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32) | (owner[1:] != owner[:-1])
    x, owner = x[keep], owner[keep]
    codes, owners = [], []
    h = np.zeros(len(x), dtype=np.uint32)
    for n in range(1, max(SIZES) + 1):
        m = len(x) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + (x[n - 1 :] + np.uint32(1)) * np.uint32(0x9E3779B1)
        if n in SIZES:
            inside = owner[:m] == owner[n - 1 :]
            g = (h ^ np.uint32(n * 0x7F4A7C15 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            codes.append(((g ^ (g >> np.uint32(15))) % np.uint32(BUCKETS))[inside])
            owners.append(owner[:m][inside])
    if not codes:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    return np.concatenate(codes), np.concatenate(owners)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # language x bit
    weights: np.ndarray  # bucket x bit: log-odds of the bit
    typical: np.ndarray  # language: mean reach of its n-grams along its codeword
    spread: np.ndarray  # language: their standard deviation


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and language: how often each bucket occurs. One row for each bucket that does."""
    sums: dict[str, np.ndarray] = {}
    for big in batches:
        for b in sized(big, "text", STEP):
            codes, owner = grams(*bytes_of(b.column("text")))
            langs = b.column("lang").dictionary_encode()
            names, which = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
            found = np.bincount(which[owner].astype(np.int64) * BUCKETS + codes, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
            for name, row in zip(names, found):
                sums[name] = sums[name] + row if name in sums else row
    for name, row in sums.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(row[at])], names=["lang", "bucket", "n"])


def fit(docs: DataFrame) -> Model:
    """Learn from all rows with a language outside the held-out fold. Sums of counts, at most BUCKETS a language, meet on the driver."""
    train = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).filter(fold("doc_id", FOLDS) != HELD_OUT)
    rows = train.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(_counted, "lang string, bucket long, n long") \
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique().tolist())
    counts = np.zeros((len(languages), BUCKETS))
    counts[rows["lang"].map({x: n for n, x in enumerate(languages)}).to_numpy(dtype=int), rows["bucket"].to_numpy(dtype=int)] = rows["n"]
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((BUCKETS, 1), dtype=np.float32), np.zeros(len(languages)), np.zeros(len(languages)))
    share = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)  # languages weigh alike, however frequent
    weights = np.stack([np.log(share[code[:, b] > 0].mean(axis=0)) - np.log(share[code[:, b] < 0].mean(axis=0)) for b in range(code.shape[1])], axis=1)
    reach = weights @ code.T / code.shape[1]  # of one n-gram along each codeword
    used = counts / counts.sum(axis=1, keepdims=True)
    typical = (used * reach.T).sum(axis=1)
    spread = np.sqrt((used * (reach.T - typical[:, None]) ** 2).sum(axis=1))
    return Model(languages, code, weights.astype(np.float32), typical, spread)


def _margins(model: Model, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text x bit: mean log-odds of a text's n-grams. And how many there are."""
    codes, owner = grams(data, ends)
    n = np.bincount(owner, minlength=len(ends) - 1)
    out = np.stack([np.bincount(owner, weights=model.weights[codes, b], minlength=len(ends) - 1) for b in range(model.weights.shape[1])], axis=1)
    return out / np.maximum(n, 1)[:, None], n


def _has_letter(texts: list[str], data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    ascii_ = np.r_[0, np.cumsum(_LETTER[data])]
    out = ascii_[ends[1:]] > ascii_[ends[:-1]]
    for n in np.flatnonzero(~out):
        out[n] = any(c.isalpha() for c in texts[n].as_py())
    return out


def decode(model: Model, margins: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The nearest codeword of each row of `n` n-grams, its score from 0 to 1, whether the row is ambiguous, and whether it is foreign.

    The score is the codeword's share under the loss, times the part of the language's usual reach that the row has.
    """
    loss = np.logaddexp(0, -margins) @ (model.code.T > 0) + np.logaddexp(0, margins) @ (model.code.T < 0)
    best = loss.argmin(axis=1)
    rest = np.exp(loss.min(axis=1, keepdims=True) - loss)
    ranked = np.sort(loss, axis=1)
    lead = ranked[:, 1] - ranked[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
    reach, usual = (margins * model.code[best]).mean(axis=1), model.typical[best]
    part = np.clip(np.divide(reach, usual, out=np.ones(len(reach)), where=usual > 0), 0, 1)
    foreign = reach + SLACK * model.spread[best] / np.sqrt(np.maximum(n, 1)) < LEAST_REACH * usual
    return best, part / rest.sum(axis=1), (lead < NARROW * model.code.shape[1]) | foreign, foreign


def predictor(model: Model):
    """A column function: text to a struct of lang_pred, score, ambiguous and foreign."""

    def run(texts: pd.Series) -> pd.DataFrame:
        m = model
        out = pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0, "ambiguous": True, "foreign": False})
        if not m.languages:
            return out
        batch = pa.RecordBatch.from_arrays([pa.array(texts.fillna(""), pa.string())], names=["text"])
        start = 0
        for b in sized(batch, "text", STEP):
            data, ends = bytes_of(b.column("text"))
            good = np.flatnonzero(_has_letter(b.column("text"), data, ends))
            margins, n = _margins(m, data, ends)
            best, score, ambiguous, foreign = decode(m, margins[good], n[good])
            at = start + good
            out.loc[at, "lang_pred"] = [m.languages[k] for k in best]
            out.loc[at, "score"] = score
            out.loc[at, "ambiguous"] = ambiguous
            out.loc[at, "foreign"] = foreign
            start += b.num_rows
        return out

    return F.pandas_udf(run, "lang_pred string, score double, ambiguous boolean, foreign boolean")


def with_language(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """All rows and columns of `docs` and a struct `name` of lang_pred, score, ambiguous and foreign."""
    return docs.withColumn(name, predictor(model)(F.col("text")))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous, foreign of every row.

    A null text, or one without a letter, is `und` with score 0, ambiguous and not foreign; so is every text when no
    row has a language to learn from. With a single language nothing is foreign. Of codewords equally near the
    alphabetically first language wins, and the text is ambiguous. Texts of any length are read whole, in steps. Repeated rows and null ids are predicted row by row. Nothing but the text is an input
    of a prediction; an empty table gives an empty one.
    """
    out = with_language(texts_of(docs), fit(docs), "found")
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "found.lang_pred", "found.score", "found.ambiguous", "found.foreign")
