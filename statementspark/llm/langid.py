"""Language identification of texts in several languages by mixture inference.

**Model** (:func:`train`). For every language, smoothed frequencies of hashed byte trigrams of lower-cased words with
blanks around, from a bounded sample of labelled documents: about ``per_lang`` of each language at most, those with the smallest
hash of their id and text (all below a limit that a histogram of the hashes gives, so no language is ranked in one task). The model is a table of languages x ``1 << BITS`` numbers, of one size whatever the corpus.

**Inference** (:func:`predict`). The likelihood of a word in a language is the product of its trigrams'. A text is a mixture
of languages with unknown proportions; expectation-maximisation over its words estimates them. Candidate sets are
the k languages with the largest proportions, for each k; the set whose log-likelihood less ``penalty`` *
ln(words) for each language after the first is highest wins. ``lang_pred`` is the largest language of the
set and ``score`` its proportion in it.

Whole texts are read, in Arrow batches with one pass of numpy for all documents of a batch; nothing is shuffled but the
training counts.

Null text, or one without a letter: ``und`` with score 0 and an empty set. No labelled rows: all ``und``. Null or
repeated ids and repeated rows: each row is predicted by itself, and for training repeated rows are one. A null id's fold is that
of the empty string. Languages with equal shares: the first by name. Very long texts: whole. Empty table: no rows. Extra
columns are not read; columns to ``keep`` may have any name but the four of the result. More than ``MOST_LANGS`` labels, as in a column that is
no language: the most frequent ones are learned, and what has another label is told to be one of those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

BITS = 16
PER_LANG = 4000
#: The model has 65,536 numbers a language. Of more labels than this the most frequent are learned, the first by name on ties.
MOST_LANGS = 500
ROUNDS = 8
PENALTY = 2.0
FOLDS, HELD = 4, 2


def held_out(doc_id: Column) -> Column:
    """Whether a document is held out of training: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram bins of all words of a column; where each word starts in them; the text of each word.

    Bytes that are no letters part words: ASCII but a-z, so digits and signs never speak for a language.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    starts = letter.copy()
    starts[1:] &= ~letter[:-1]
    starts[offsets[:-1][offsets[:-1] < len(data)]] |= letter[offsets[:-1][offsets[:-1] < len(data)]]
    at = np.flatnonzero(letter)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    chars = data[at].astype(np.uint32)
    first = starts[at]
    last = np.append(first[1:], True)
    before = np.where(first, np.uint32(32), np.append(np.uint32(32), chars[:-1]))
    after = np.where(last, np.uint32(32), np.append(chars[1:], np.uint32(32)))
    bins = ((before * np.uint32(0x01000193) + chars) * np.uint32(0x9E3779B1) + after) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)
    begin = np.flatnonzero(first)
    return bins.astype(np.int64), begin, np.searchsorted(offsets, at[begin], side="right") - 1


def train(docs: DataFrame, per_lang: int = PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """(languages, log-probabilities as float32 of shape bins x languages), from rows with a language."""
    rows = docs.select(F.xxhash64(docs[id_col].cast("string"), docs[text_col]).alias("h"), docs[text_col].alias("t"), docs[lang_col].cast("string").alias("l")).where("l IS NOT NULL AND t IS NOT NULL")
    # A histogram of hashes, summed before it moves, gives each language a limit below which about ``per_lang`` of them lie. Bins widen
    # with the hash, sixteen to each doubling, so it is as fine where millions are below the limit as where hundreds are.
    rows = rows.withColumn("bin", F.floor(F.log2(F.shiftrightunsigned("h", 11) + 1) * 16))
    bins = rows.groupBy("l", "bin").agg(F.approx_count_distinct("h").alias("n"))
    up_to = F.sum("n").over(Window.partitionBy("l").orderBy("bin"))
    limits = bins.withColumn("up_to", up_to).groupBy("l").agg(F.max(F.when(F.col("up_to") <= per_lang, F.col("bin"))).alias("limit"), F.sum("n").alias("n"))
    limits = limits.where("limit IS NOT NULL").orderBy(F.desc("n"), "l").limit(MOST_LANGS).drop("n")
    # A row for each language, written so that the texts are read for it once: a side of bounded size.
    limits = materialize(limits, "lang-limits")
    chosen = rows.join(F.broadcast(limits.withColumnRenamed("l", "__l")), (F.col("l") == F.col("__l")) & (F.col("bin") <= F.col("limit")))
    # Repeated rows are one: texts of the sample, of bounded number, meet by their hash.
    sample = chosen.groupBy("l", "h").agg(F.first("t").alias("t"))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                names = part.column(1).to_pylist()
                bins, begin, owner = _words(part.column(0))
                whose = np.repeat(owner, np.diff(np.append(begin, len(bins))))
                for name in set(names):
                    mine = np.array([x == name for x in names])
                    sums[name] = sums.get(name, 0) + np.bincount(bins[mine[whose]], minlength=1 << BITS)
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(total[at])], names=["l", "bin", "n"])

    counts = sample.select(F.lower("t").alias("t"), "l").mapInArrow(count, "l string, bin long, n long").groupBy("l", "bin").agg(F.sum("n").alias("n"))
    found = counts.toPandas()
    langs = sorted(found["l"].unique())
    table = np.full((1 << BITS, len(langs)), 0.5)
    for k, lang in enumerate(langs):
        part = found[found["l"] == lang]
        table[part["bin"].to_numpy(), k] += part["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32) if langs else np.zeros((1 << BITS, 0), np.float32)


def _em(like: np.ndarray, first: np.ndarray, sizes: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood (less what does not depend on them) of each text. like: words x languages."""
    share = start
    words = np.maximum(sizes, 1)[:, None]
    for _ in range(rounds):
        joint = like * np.repeat(share, sizes, axis=0)
        joint /= joint.sum(axis=1, keepdims=True)
        share = np.add.reduceat(joint, first, axis=0) / words
    total = np.add.reduceat(np.log((like * np.repeat(share, sizes, axis=0)).sum(axis=1)), first)
    return share, total


def infer(texts: pa.Array, table: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: best language (-1: no words), its proportion, and the proportions of the chosen set."""
    n, langs = len(texts), table.shape[1]
    best, score, shares = np.full(n, -1), np.zeros(n), np.zeros((n, langs))
    bins, begin, owner = _words(texts)
    if not langs or not len(bins):
        return best, score, shares
    logs = np.add.reduceat(table[bins], begin, axis=0)
    logs -= logs.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(logs, -30)).astype(np.float32)
    docs, first, sizes = np.unique(owner, return_index=True, return_counts=True)
    uniform = np.full((len(docs), langs), 1 / langs, np.float32)
    full, _ = _em(like, first, sizes, uniform, rounds)
    order = np.argsort(-full, axis=1, kind="stable")
    cost = penalty * np.log(np.maximum(sizes, 2))
    top, chosen = None, None
    for k in range(1, langs + 1):
        allowed = np.zeros_like(full)
        np.put_along_axis(allowed, order[:, :k], 1, axis=1)
        start = full * allowed + 1e-9 * allowed
        start = (start / start.sum(axis=1, keepdims=True)).astype(np.float32)
        share, total = _em(like, first, sizes, start, rounds if k > 1 else 0)
        total = total - (k - 1) * cost
        if top is None:
            top, chosen = total, share
        else:
            better = total > top + 1e-6
            top = np.where(better, total, top)
            chosen = np.where(better[:, None], share, chosen)
        if k > 1 and not better.any():
            break  # a language more helped no text
    best[docs] = chosen.argmax(axis=1)
    score[docs] = np.clip(chosen.max(axis=1), 0, 1)
    shares[docs] = chosen
    return best, score, shares


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, penalty: float = PENALTY, keep: tuple = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, langs) for each row, and the columns ``keep``, which stay as they are."""
    model = docs.sparkSession.sparkContext.broadcast((langs, table))
    has = F.coalesce(docs[text_col].rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.when(has, F.lower(docs[text_col])).alias("text"), *[docs[c] for c in keep])
    names = ["doc_id", *keep]
    schema = T.StructType([f for k, f in enumerate(rows.schema) if k != 1]).add("lang_pred", "string").add("score", "double").add("langs", T.ArrayType(T.StringType()))

    def run(batches):
        langs, table = model.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                best, score, shares = infer(part.column(1), table, penalty)
                named = pa.array([langs[k] if k >= 0 else "und" for k in best], pa.string())
                sets = pa.array([[langs[j] for j in np.argsort(-row, kind="stable") if row[j] > 0.01] for row in shares], pa.list_(pa.string()))
                columns = [part.column(k) for k in range(part.num_columns) if k != 1]
                yield pa.RecordBatch.from_arrays([*columns, named, pa.array(score), sets], names=[*names, "lang_pred", "score", "langs"])

    return rows.mapInArrow(run, schema)
