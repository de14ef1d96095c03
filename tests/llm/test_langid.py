import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from statementspark.llm import langid as G

from ..conftest import SF

WORDS = {"aa": "kora tuno meka lipa sado".split(), "bb": "strengt wholms fjords brugh knacht".split(), "cc": "ziyxu qiwei xuyao zhiqu yuxian".split()}


def texts(lang, n, seed, size=40):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS[lang], size)) for _ in range(n)]


def model(spark):
    rows = [(k * 10 + j, t, lang) for j, lang in enumerate(WORDS) for k, t in enumerate(texts(lang, 30, j))]
    return G.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=20)


def test_mixture_sets_and_proportions(spark):
    langs, table = model(spark)
    assert langs == ["aa", "bb", "cc"]
    mixed = " ".join(texts("aa", 1, 7, 60) + texts("bb", 1, 8, 30))
    rows = [(1, texts("cc", 1, 5)[0]), (2, mixed), (3, None), (4, "123 !!"), (5, ""), (None, "kora"), (6, "tuno " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in G.predict(df, langs, table).collect()}
    assert (got[1].lang_pred, got[1].langs) == ("cc", ["cc"])
    assert got[2].langs == ["aa", "bb"] and abs(got[2].score - 2 / 3) < 0.05
    assert [got[k].lang_pred for k in (3, 4, 5)] == ["und"] * 3 and got[3].score == 0
    assert got[None].lang_pred == "aa" and got[6].lang_pred == "aa"


def test_likelihood_of_em_never_falls(spark):
    langs, table = model(spark)
    bins, begin, _ = G._words(pa.array([" ".join(texts("aa", 1, 1) + texts("cc", 1, 2))]))
    like = np.exp(np.add.reduceat(table[bins], begin, axis=0).astype(float))
    like /= like.max(axis=1, keepdims=True)
    start = np.full((1, 3), 1 / 3)
    totals = [G._em(like, np.array([0]), np.array([len(begin)]), start, n)[1][0] for n in range(8)]
    assert all(b >= a - 1e-6 for a, b in zip(totals, totals[1:], strict=False))


def test_no_labels_is_undetermined(spark):
    df = spark.createDataFrame([(1, "kora", None)], "doc_id long, text string, lang string")
    langs, table = G.train(df)
    assert langs == [] and G.predict(df, langs, table).first().lang_pred == "und"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    langs, table = G.train(docs.where(~G.held_out(F.col("doc_id"))))
    got = G.predict(docs, langs, table, keep=("lang",)).withColumn("held", G.held_out(F.col("doc_id"))).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_sample_is_bounded_and_repeated_rows_are_one(spark):
    rows = [(k, t, "aa") for k, t in enumerate(texts("aa", 300, 1))] + [(9, "kora kora", "bb")] * 200 + [(k, "mova", "bb") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    tables = [G.train(x, per_lang=100) for x in (docs, docs.coalesce(1))]
    assert tables[0][0] == ["aa", "bb"] and (tables[0][1] == tables[1][1]).all()
    mass = 1 / np.exp(tables[0][1].astype(float)).min(axis=0) / 2 - (1 << G.BITS) / 2  # trigrams counted, by language
    assert 50 * 200 < mass[0] <= 105 * 200 and mass[1] < 22 * 10
    assert G.train(docs.where("false"))[0] == [] and G.predict(docs.where("false"), *tables[0]).count() == 0
    kept = docs.limit(3).withColumn("lang_pred", F.lit("clash"))
    assert G.predict(kept, *tables[0]).columns == ["doc_id", "lang_pred", "score", "langs"] and G.predict(kept, *tables[0]).count() == 3


def test_more_labels_than_the_model_holds(spark, monkeypatch):
    """The most frequent labels are learned; a column of junk labels beside them stops nothing."""
    rows = [(k * 10 + j, t, lang) for j, lang in enumerate(WORDS) for k, t in enumerate(texts(lang, 30, j))] + [(10_000 + k, f"junk {k}", f"x{k}") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, table = G.train(docs)
    assert len(langs) == G.MOST_LANGS and set(WORDS) <= set(langs) and table.shape == (1 << G.BITS, G.MOST_LANGS)
    monkeypatch.setattr(G, "MOST_LANGS", 3)
    langs, table = G.train(docs)
    assert langs == ["aa", "bb", "cc"]
    assert [r.lang_pred for r in G.predict(docs.where("doc_id < 300"), langs, table, keep=("lang",)).where("lang <> lang_pred").collect()] == []


def test_kept_columns_of_any_name_and_kind(spark):
    langs, table = model(spark)
    df = spark.createDataFrame([(1, "kora tuno", "a", [1.5], {"k": 1})], "doc_id long, text string, t string, `odd name` array<double>, h map<string,int>")
    row = df.select("doc_id", "text", F.struct(*df.columns).alias("row"))
    got = G.predict(row, langs, table, keep=("row",)).first()
    assert (got.lang_pred, got.row["text"], got.row["t"], got.row["odd name"], got.row["h"]) == ("aa", "kora tuno", "a", [1.5], {"k": 1})
