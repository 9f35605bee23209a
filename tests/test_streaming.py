from tessera.functions import features as FE
from tessera.plans.linkage import Linkage
from tessera.streaming import incremental


def test_micro_batches_equal_the_batch_run(spark, sf, tmp_path):
    run = Linkage(spark, sf)
    run.s1.repartition(3).write.csv(str(tmp_path / "in"), sep="\t", quote="", header=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    stream = incremental.entity_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    q = incremental.start_linkage(stream, run.pool_pre, run.idf, FE.name_frequency(run.s1_pre), str(tmp_path / "out"), str(tmp_path / "cp"), cap=run.cap, max_posting=run.max_posting)
    q.awaitTermination(600)
    got = {(r["sid"], r["eid"], r["score"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["sid"], r["eid"], r["score"]) for r in run.scored.where("score >= 0.5").collect()}
    assert got == want
