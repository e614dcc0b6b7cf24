"""Quality classifier: a factorisation machine over hashed words, structure statistics and text length.

The score of features x is sigmoid(b + w.x + sum of <v_i, v_j> x_i x_j over pairs i < j); the pair sum over k factors is
half of |sum v_i x_i|^2 - sum |v_i x_i|^2, linear in the features present. Trained here by Adam on the logistic loss.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm.runtime import released, ship, table

#: The most labelled rows that the model is fitted on; the smallest hashes of their ids are taken.
TRAIN_ROWS = 6_000
#: Slots of hashed words, and factors.
SLOTS = 1 << 13
FACTORS = 8
EPOCHS = 12
RATE = 0.02
DECAY = 1e-5
THRESHOLD = 0.3
FOLDS = 5
SEED = 31

_WORD = re.compile(rb"[^\x20\x09-\x0D]+").findall
_CUTS = (2, 4, 8, 16, 32, 64, 128, 256, 512, 1024)


def statistics(text: str, words: list[bytes], counts: dict[bytes, int]) -> list[float]:
    """Structure of a text, each figure from 0 to about 1, then one-hot cells of its length in words and characters."""
    n, chars = max(len(words), 1), max(len(text), 1)
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    ended = sum(x.rstrip()[-1:] in (".", "!", "?", "…", '"') for x in lines)
    letters = sum(map(str.isalpha, text)) if not text.isascii() else len(re.findall(r"[A-Za-z]", text))
    upper = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    figures = [
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        letters / chars,
        upper / max(letters, 1),
        len(re.findall(r"[#*$%&<>^~=_{}\[\]\\|@]", text)) / n,
        text.count("|") / n,
        text.count("!") / n,
        len(re.findall(r"[0-9]", text)) / chars,
        len(re.findall(r"[.,;:]", text)) / n,
        ended / max(len(lines), 1),
        len(set(lines)) / max(len(lines), 1),
        min(sum(map(len, words)) / n / 10, 2.0),
        min(n / max(len(lines), 1) / 100, 2.0),
    ]
    cells = [float(sum(c < len(words) for c in _CUTS) == i) for i in range(len(_CUTS) + 1)]
    return [min(x, 2.0) for x in figures] + cells


N_STATISTICS = 14 + len(_CUTS) + 1


class Features:
    """Sparse features of whole texts; slots of words are remembered."""

    def __init__(self, slots: int):
        self.slots, self.seen = slots, {}

    def slot(self, word: bytes) -> int:
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) >= 1 << 18:
                self.seen.clear()
            found = self.seen[word] = N_STATISTICS + zlib.crc32(word.lower()) % self.slots
        return found

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values: statistics, then words by the square root of their counts, scaled to length 1."""
        text = text or ""
        words = _WORD(text.encode("utf-8", "surrogatepass"))
        counts: dict[bytes, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        fixed = np.array(statistics(text, words, counts), np.float64)
        if counts:
            at, where = np.unique(np.fromiter(map(self.slot, counts), np.int64, len(counts)), return_inverse=True)
            value = np.sqrt(np.bincount(where, weights=np.fromiter(counts.values(), np.float64, len(counts))))
            value /= np.sqrt((value * value).sum())
        else:
            at, value = np.zeros(0, np.int64), np.zeros(0)
        return np.concatenate([np.arange(N_STATISTICS), at]), np.concatenate([fixed, value])


class Machine:
    """A factorisation machine; parameters in one array each."""

    def __init__(self, slots: int = SLOTS, factors: int = FACTORS, seed: int = SEED):
        n = N_STATISTICS + slots
        self.bias, self.weight = np.zeros(1), np.zeros(n)
        self.factor = np.random.default_rng(seed).normal(0, 0.01, (n, factors))

    def raw(self, at: np.ndarray, value: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Of rows laid end to end, each from rows[i] on."""
        scaled = self.factor[at] * value[:, None]
        total = np.add.reduceat(scaled, rows)
        return self.bias[0] + np.add.reduceat(self.weight[at] * value, rows) + 0.5 * ((total * total).sum(1) - np.add.reduceat((scaled * scaled).sum(1), rows))

    def score(self, at, value, rows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(at, value, rows), -30, 30)))

    def fit(self, examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY, seed: int = SEED, batch: int = 128) -> None:
        """Logistic loss by Adam; the two classes weigh the same in sum, softened by a square root."""
        rng = np.random.default_rng(seed)
        share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
        weigh = np.where(labels == 1, np.sqrt(0.5 / share), np.sqrt(0.5 / (1 - share)))
        self.bias[0] = np.log(share / (1 - share))
        state = [(p, np.zeros_like(p), np.zeros_like(p)) for p in (self.bias, self.weight, self.factor)]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(examples))
            for s in range(0, len(order), batch):
                take = order[s : s + batch]
                sizes = np.array([len(examples[i][0]) for i in take])
                rows = np.r_[0, np.cumsum(sizes)[:-1]]
                at, value = (np.concatenate([examples[i][k] for i in take]) for k in (0, 1))
                of = np.repeat(np.arange(len(take)), sizes)
                scaled = self.factor[at] * value[:, None]
                total = np.add.reduceat(scaled, rows)
                error = (self.score(at, value, rows) - labels[take]) * weigh[take] / len(take)
                each = error[of]
                used, where = np.unique(at, return_inverse=True)
                grad_w = np.bincount(where, weights=each * value, minlength=len(used))
                pull = (each * value)[:, None] * (total[of] - scaled)
                grad_v = np.stack([np.bincount(where, weights=pull[:, k], minlength=len(used)) for k in range(pull.shape[1])], 1)
                step += 1
                for (p, m, v), g, i in zip(state, (np.array([error.sum()]), grad_w, grad_v), (slice(None), used, used)):
                    g = g + decay * p[i]
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)


def held_out(id_col: str, folds: int = FOLDS):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS, folds: int = FOLDS, slots: int = SLOTS) -> Machine:
    """A machine fitted on at most `rows` labelled rows outside the held-out fold.

    The rows are those of the smallest hashes of ids, so which they are depends on the ids alone. Rows with a null id or
    label aren't used; an id labelled twice counts with its largest label; an id that several documents have gives an example each, up to `rows` in all.
    With no usable row, or one class only, the model scores what that leaves: 0.5, or about that class's share.
    """
    ship(docs.sparkSession)
    named = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col, folds)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    chosen = named.orderBy(F.xxhash64(F.lit(SEED), "_id"), "_id").limit(rows)  # at most `rows` ids: small enough to broadcast
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "_y", "_text")

    def features(batches):
        own = Features(slots)
        for batch in batches:
            made = [own.of(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.astype(np.int32).tobytes() for a, _ in made], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in made], pa.binary())], names=["id", "y", "at", "value"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = picked.mapInArrow(features, f"id {kind}, y int, at binary, value binary").orderBy(F.xxhash64(F.lit(SEED), "id"), "id", "at", "value").limit(rows).collect()
    machine = Machine(slots)
    if found:
        examples = [(np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["value"], np.float32).astype(np.float64)) for r in found]
        machine.fit(examples, np.array([r["y"] for r in found], np.float64))
    return machine


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, folds: int = FOLDS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text; null and empty texts score by their statistics. One row for each row; other columns are ignored."""
    spark = docs.sparkSession
    ship(spark)
    given = spark.sparkContext.broadcast(machine)  # a fixed number of parameters
    slots = len(machine.weight) - N_STATISTICS

    def run(batches):
        own = Features(slots)
        for batch in released(batches):
            out = np.empty(batch.num_rows)
            for s in range(0, batch.num_rows, 256):
                made = [own.of(t.as_py()) for t in batch.column(2)[s : s + 256]]
                sizes = np.array([len(a) for a, _ in made])
                out[s : s + len(made)] = given.value.score(np.concatenate([a for a, _ in made]), np.concatenate([v for _, v in made]), np.r_[0, np.cumsum(sizes)[:-1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out), pa.array((out >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), held_out(id_col, folds).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document, learnt from labels outside the held-out fold.

    Null and empty texts have a score too; a null id counts as empty text in the fold's checksum and is never learnt from;
    repeated rows score alike; an empty table gives no rows; columns other than id and text are no input.
    """
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
