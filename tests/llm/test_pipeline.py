"""The pipeline's stages, each on what the one before kept."""

import re

from pyspark.sql import functions as F

WHERE = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{WHERE}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in c.STAGES:
        out = stage(spark, docs, WHERE)
        out.write.parquet(str(tmp_path / name))
        docs_before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != c.STAGES[-1][0]:
            assert docs.columns == columns
        assert set(kept[name]) <= {r.doc_id for r in docs_before.select("doc_id").collect()}
    known = kept["language_id"]
    assert all(r.text and re.search(r"[^\W\d_]", r.text) for r in known.values())
    grams = {}
    for i, r in known.items():
        w = r.text.split()
        grams[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b) - 1e-9
    left = set(kept["ngram_jaccard"])
    assert not any(alike(grams[a], grams[b]) for a in left for b in left if a < b)
    assert all(any(alike(grams[i], grams[j]) for j in grams if j < i) for i in set(known) - left)
    items = [" ".join(re.findall(r"\w+", r.text.lower())) for r in spark.read.parquet(f"{WHERE}/benchmark.parquet").collect()]
    holds = {i for i in left if any(f" {x} " in f" {' '.join(re.findall(r'\w+', known[i].text.lower()))} " for x in items)}
    assert holds and not holds & set(kept["decontamination"])
    assert len(left - holds - set(kept["decontamination"])) <= 2
    assert set(kept["pii"]) == set(kept["decontamination"])
    assert not any(re.search(r"[\w.]+@[\w-]+\.\w", r.text) for r in kept["pii"].values())
    same = [i for i, r in kept["pii"].items() if r.text == known[i].text]
    assert len(same) > 0.7 * len(kept["pii"])
    assert set(kept["byte_bpe"]) == set(kept["pii"])
    assert c.run(spark, WHERE).select(F.sum("n_tokens")).first()[0] == sum(r.n_tokens for r in kept["byte_bpe"].values())
