"""The pipeline's stages, each on its own input against a plain version, and as a whole."""

from collections import Counter

import corpus_pipeline
from dataveil.llm import toxicity
from dataveil.llm.store import stored
from tests.llm import plain

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, given = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        result = stored(stage(spark, given, SF), name)
        before, after = [(r.doc_id, r.text) for r in given.collect()], result.collect()
        if name == "toxicity":
            scored = toxicity.score(given, toxicity.fit(given, spark.read.parquet(f"{SF}/labels.parquet")))
            assert {r.doc_id for r in after} == {r.doc_id for r in scored.where("predicted = 0").collect()}
        elif name == "near_duplicates":
            want = plain.roots([d for d, _ in before], plain.near_links(before, 5))
            assert Counter(r.doc_id for r in after) == Counter(d for d in want if want[d] == d)
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            hit = plain.contamination(before, items)
            assert Counter(r.doc_id for r in after) == Counter(d for (d, _), (_, n, _) in zip(before, hit) if not n)
        elif name == "mixing":
            count = Counter(r.doc_id for r in after)
            assert max(count.values()) <= 2 and set(count) <= {d for d, _ in before}
            words = sum(len(plain.words(r.text)) for r in after) / sum(len(plain.words(t)) for _, t in before)
            assert 1.45 < words < 1.55
        else:
            assert Counter(r.doc_id for r in after) == Counter(d for d, _ in before)
            assert max(Counter(r.shard for r in after).values()) - min(Counter(r.shard for r in after).values()) <= 1
        if name != "sharding":
            assert result.columns == columns
        given = result


def test_stages_take_awkward_and_empty_tables(spark):
    for docs in (plain.awkward_docs(spark), plain.awkward_docs(spark).where("false")):
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
