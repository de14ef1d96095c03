from pyspark.sql import functions as F

import corpus_pipeline
from statementspark.llm import queries
from statementspark.llm.common import materialize

from ..conftest import SF

TEXT = "the quick brown fox jumps over the lazy dog and runs far away from all of the other animals in these woods"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_chain_and_keep_what_they_should(spark):
    own = [f"{w} is the only text that speaks of {w} and of nothing else but {w}s all day long" for w in ("amber", "basalt", "cedar", "delta")]
    rows = [(k, t, "en", "s1", 0) for k, t in enumerate(own)] + [(10, TEXT, "en", "s2", 0), (11, TEXT + "\nfoo", "en", "s2", 0), (12, None, None, None, None), (13, "12 34", "en", "s2", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "t")
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        seen[name] = sorted(r.doc_id for r in docs.select("doc_id").distinct().collect())
    assert seen["language_id"] == [0, 1, 2, 3, 10, 11]
    assert set(seen["near_dedup"]) >= {0, 1, 2, 3, 10}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert sorted(r.doc_id for r in pieces.select("doc_id").distinct().collect()) == seen["mixing"]


def test_empty_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "t")
    assert docs.count() == 0


def test_run_and_names(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")] == list(range(1, 14))


CLASHING = "t string, n_lines int, n_kept string, lang_pred array<int>, __doc_id long, h long, d long, row string, copies int, size long, __row string, component_id long, langs string"


def test_extra_columns_of_clashing_names_pass_all_stages(spark):
    """What the driver's documents give with and without further columns is the same, and the further ones stay as they were."""
    base = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 20000")
    extra = [F.lit("a"), F.lit(7), F.lit("b"), F.array(F.lit(3)), F.lit(-1), F.lit(-2), F.lit(-3), F.lit("r"), F.lit(4), F.lit(5), F.lit("s"), F.lit(6), F.lit("l")]
    names = [c.split()[0] for c in CLASHING.split(", ")]
    more = base.select("*", *[F.when(F.col("doc_id") % 3 > 0, x).alias(n) for n, x in zip(names, extra, strict=True)])
    for name, stage in corpus_pipeline.STAGES:
        if name == "packing":
            base = more.select(*base.columns)
        plain, wide = materialize(stage(spark, base, SF), "t"), materialize(stage(spark, more, SF), "t")
        if name == "packing":
            assert plain.columns == wide.columns and plain.agg(F.sum("length")).first() == wide.agg(F.sum("length")).first()
            assert plain.count() > 0
            break
        assert wide.columns == [*base.columns, *names]
        if name != "mixing":  # its draws depend on all columns
            assert sorted(map(repr, wide.select(*base.columns).collect())) == sorted(map(repr, plain.collect()))
        for n, x in zip(names, extra, strict=True):
            assert wide.where(~F.col(n).eqNullSafe(F.when(F.col("doc_id") % 3 > 0, x))).count() == 0
        base, more = plain, wide
