"""Each stage against a plain version, on its own input."""

import corpus_pipeline as P
from tessera.llm import decontaminate, jaccard_join, packing, quality, toxicity
from tests.llm.test_jaccard_join import brute


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = docs.collect()
    text = {r["doc_id"]: r["text"] for r in rows}
    names = [n for n, _ in P.STAGES]
    assert names == ["quality", "toxicity", "near_duplicates", "decontamination", "packing"]
    stage = dict(P.STAGES)
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())

    good = stage["quality"](spark, docs, sf)
    p = quality.train(docs, labels).scores([r["text"].encode() for r in rows])
    assert good.columns == docs.columns and ids(good) == sorted(r["doc_id"] for r, s in zip(rows, p, strict=True) if s >= 0.3)

    calm = stage["toxicity"](spark, docs, sf)
    p = toxicity.train(docs, labels).scores([r["text"].encode() for r in rows])
    assert calm.columns == docs.columns and ids(calm) == sorted(r["doc_id"] for r, s in zip(rows, p, strict=True) if s < 0.5)

    small = docs.where("n_chars < 1500")
    kept = stage["near_duplicates"](spark, small, sf)
    want = [d for d, _, c, _ in brute([(r["doc_id"], r["text"]) for r in small.collect()], 5, 80) if d == c]
    assert kept.columns == docs.columns and ids(kept) == sorted(want)

    clean = stage["decontamination"](spark, docs, sf)
    table = decontaminate.build([(str(r["item_id"]), r["text"].encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    found = dict(zip(text, table.search([t.encode() for t in text.values()]), strict=True))
    assert clean.columns == docs.columns and ids(clean) == sorted(i for i, (_, spans, _) in found.items() if not spans)


def test_run(spark, sf):
    out = P.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    assert 0.5 * docs.count() < len(left) < docs.count()
    kept = docs.where(docs.doc_id.isin(list(left)))
    assert jaccard_join.jaccard_classes(kept, count_links=True).where("n_links > 0").count() == 0


def test_no_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_malformed_utf8(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    odd = ["C3", "61FF6220C320776F726473", "EDA0806566672061626364", "68656C6C6FF09F982068656C6C6F"]
    more = spark.createDataFrame([(10**6 + i, h) for i, h in enumerate(odd)], "doc_id long, h string").selectExpr("doc_id", "cast(unhex(h) as string) text", "'en' lang", "'x' source", "cast(1 as bigint) n_chars")
    both = docs.unionByName(more.select(docs.columns))
    model = toxicity.fit([b"foul words here", b"fine words there"] * 20, [1, 0] * 20)
    assert toxicity.toxicity(both, model).count() == both.count() and toxicity.keep_clean(more, model).count() > 0
    # their scores and tokens are those of the text with U+FFFD in place of what is malformed
    plain = spark.createDataFrame([(10**6 + i, bytes.fromhex(h).decode("utf-8", "replace")) for i, h in enumerate(odd)], "doc_id long, text string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(toxicity.toxicity(more, model)) == rows(toxicity.toxicity(plain, model))
    pieces = lambda df: rows(packing.pack(df).select("doc_id", "piece", "length", "ids_crc32"))
    assert pieces(more) == pieces(plain)
    for _, stage in P.STAGES:
        assert stage(spark, both, sf).count() > 0
