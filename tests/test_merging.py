"""First wins over a stream of crawl files, stopped and started again."""

from pyspark.sql import functions as F

from melisma.operators import dedupe
from melisma.plans import catalog
from melisma.streaming import merging

FOLDER = "/root/testdata/sf0.01"
ORDER = ["conv_id", "turn"]


def test_batches_and_a_restart(spark, tmp_path):
    records, known = catalog.crawled(spark, FOLDER), catalog.known_songs(spark, FOLDER)
    bounds = [0, 20, 25, 60, 10**9]
    source = str(tmp_path / "in")

    def arrive(i):
        records.where(F.col("conv_id").between(bounds[i], bounds[i + 1] - 1)).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(source)
        found = merging.merge_stream(stream, known, ORDER, str(tmp_path / "out")).trigger(availableNow=True).start()
        found.awaitTermination()
        return found.lastProgress

    arrive(0)
    run()
    arrive(1)
    arrive(2)
    run()  # from the state of the first run
    arrive(3)
    run()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out/songs")).select("id", "titulo", "artista", *ORDER).collect())
    added = dedupe.merge(known, records, ORDER)[0].join(known.select("id"), "id", "left_anti").select("id", "titulo", "artista")
    assert sorted(x[:3] for x in got) == sorted(map(tuple, added.collect())) and len(got) > 50
    firsts = {(r["conv_id"], r["turn"]) for r in catalog.dedupe_first_wins(spark, FOLDER).collect()}
    assert {x[3:] for x in got} <= firsts


def test_registered(spark):
    want = sorted(tuple(r) for r in catalog.merged_songs(spark, FOLDER).collect())
    assert sorted(tuple(r) for r in catalog.merged_stream(spark, FOLDER).collect()) == want
