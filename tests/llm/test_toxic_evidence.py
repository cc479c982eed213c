"""Evidence of short labelled texts."""

from foliotab.llm import toxicity


def test_different_short_texts_of_one_length_all_count(spark):
    from pyspark.sql import functions as F

    ids = [r.id for r in spark.range(600).where(toxicity.in_training("id")).limit(200).collect()]
    rows = [(i, f"grobzan {k:03}" if k % 2 else f"garden {k:04}", k % 2) for k, i in enumerate(ids)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(frame.select("doc_id", "text"), frame.select("doc_id", F.lit(1).alias("quality"), "toxic"))
    assert any(entry.startswith("grob") for entry in model.lexicon)
