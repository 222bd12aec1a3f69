"""The pipeline's stages on the smallest tables: each decision takes effect, clean documents stay, columns hold."""

import corpus_pipeline
from pyspark.sql import functions as F
from trackloom.llm import common, jaccard_join, packing, pii_crf
from trackloom.llm.queries import WORD_TOKENIZER


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = kept[name] = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns or name == "packing"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    left = kept["toxicity"].join(labels, "doc_id").groupBy("toxic").count().collect()
    counts = {r.toxic: r["count"] for r in left}
    all_clean = labels.where("toxic = 0").count()
    assert counts[0] >= 0.95 * all_clean
    classes = jaccard_join.jaccard_join(kept["toxicity"])
    assert kept["ngram_jaccard_join"].count() == classes.select(F.col("component_id")).distinct().count()
    assert not any(pii_crf.pattern_spans(r.text) for r in kept["pii"].collect())
    assert kept["mixing"].select("doc_id").distinct().count() <= kept["pii"].count()
    packed = kept["packing"]
    tokens = packing.token_pieces(kept["mixing"], WORD_TOKENIZER).agg(F.sum("length")).first()[0]
    assert packed.agg(F.sum("length")).first()[0] == tokens
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= packing.MAX_TOKENS


def test_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0
        if name != "packing":
            docs = out


def test_a_worker_remembers_one_operator():
    """Stages share Python workers: what packing remembers of words and its tokenizers goes with the first batch of another operator."""
    list(packing._encode(["some words again"], WORD_TOKENIZER))
    assert list(common.tended(iter([1, 2, 3]), "packing")) == [1, 2, 3] and packing._STATE["ids"]
    assert list(common.tended(iter([4, 5]), "pii_crf")) == [4, 5] and not packing._STATE
    again = list(packing._encode(["some words again", ""], WORD_TOKENIZER))
    assert again == list(packing._encode(["some words again", ""], WORD_TOKENIZER)) and again[0] and not again[1]
