import re
from collections import Counter

import corpus_pipeline
from girder.llm import stages, toxicity

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(df.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"], r["text"] or ""))


def shingles(text):
    words = (text or "").lower().split()
    return Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4)) or Counter([tuple(words)] if words else [])


def test_stages_against_brute_force(spark):
    """Each stage on what its predecessors kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r["doc_id"] for r in toxicity.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r["predicted"]}
    clean = stages.drop_toxic(spark, docs, SF)
    assert rows(clean) == [r for r in rows(docs) if r["doc_id"] not in toxic]

    held = rows(clean)
    sets, root = [shingles(r["text"]) for r in held], list(range(len(held)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(held)):
        for b in range(a):
            if sets[a] and (sets[a] & sets[b]).total() >= 0.8 * (sets[a] | sets[b]).total():
                root[find(a)] = find(b)
    unique = stages.drop_near_duplicates(spark, clean, SF)
    kept = {r["doc_id"] for r in unique.collect()}
    classes = {}
    for k, r in enumerate(held):
        classes.setdefault(find(k), []).append(r["doc_id"])
    assert all(len(kept & set(c)) == 1 for c in classes.values()) and len(kept) == len(classes) < len(held)

    plain = lambda t: f" {' '.join(re.findall(r'[^\W_]+', (t or '').lower()))} "
    items = [plain(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {r["doc_id"] for r in unique.collect() if any(i in plain(r["text"]) for i in items)}
    unleaked = stages.drop_benchmark_leaks(spark, unique, SF)
    left = {r["doc_id"] for r in unleaked.collect()}
    assert not left & whole and len(kept - whole - left) <= 1


def test_pipeline_runs_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == docs.columns and got.count() == docs.count() > 0
