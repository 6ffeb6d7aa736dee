"""The index in segments against full builds."""

import random
from pathlib import Path

import pytest

from melisma.operators import index
from melisma.sources import corpus, segments
from melisma.streaming import increments

WORDS = "road sea miles night love rain fire moon star river song dance".split()


def songs_of(spark, rng, ids):
    rows = [(i, " ".join(rng.choices(WORDS, k=3)), rng.choice(["A", "B"]), " ".join(rng.choices(WORDS, k=12))) for i in ids]
    return rows, corpus.with_defaults(spark.createDataFrame(rows, "id string, titulo string, artista string, letra string"))


def rows(df, columns=None):
    return sorted(tuple(map(str, r)) for r in (df.select(columns) if columns else df).collect())


def same(spark, found, live):
    whole = index.build(corpus.with_defaults(spark.createDataFrame(list(live.values()), "id string, titulo string, artista string, letra string")))
    own = found.index()
    for name in segments.ROWS:
        want = getattr(whole, name)
        assert rows(getattr(own, name), want.columns) == rows(want), name
    assert rows(found.document_frequency(), ["term", "df"]) == rows(index.document_frequency(whole.postings), ["term", "df"])
    total = found.totals().first()
    assert (total["n"], total["length"]) == tuple(whole.docs.selectExpr("count(*)", "sum(doc_len)").first())


def size(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


def test_batches(spark, tmp_path):
    rng, live, folder = random.Random(9), {}, str(tmp_path / "i")
    assert segments.opened(spark, folder) is None
    for batch, n in enumerate((12, 3, 1, 6)):
        ids = {*(str(rng.randrange(30)) for _ in range(n)), *([next(iter(live))] if live else [])}
        some, table = songs_of(spark, rng, sorted(ids))
        live |= {r[0]: r for r in some}
        found = segments.add(spark, folder, table, batch)
        assert sum(s.songs for s in found.active) >= len(live)
        if batch == 2:
            same(spark, segments.opened(spark, folder), live)
    assert len(found.active) < 4 and any(s.name.startswith("m") for s in found.active)
    before = segments.opened(spark, folder, 3)
    again = segments.add(spark, folder, table, 3)  # a batch that is run again
    assert again.active == found.active and before.active != found.active
    same(spark, again, live)


def test_what_a_batch_writes(spark, tmp_path):
    rng, folder = random.Random(3), str(tmp_path / "i")
    segments.add(spark, folder, songs_of(spark, rng, map(str, range(400)))[1].coalesce(1), 0)
    whole = size(f"{folder}/segments")
    found = segments.add(spark, folder, songs_of(spark, rng, ["7", "x"])[1].coalesce(1), 1)
    assert [s.name for s in found.active] == ["b0", "b1"] and size(f"{folder}/segments") - whole < 0.5 * whole


@pytest.mark.parametrize("sizes, start", [([100], 0), ([100, 10], 1), ([100, 10, 9], 1), ([100, 30, 20], 0), ([8, 4, 2, 1], 0), ([80, 4, 1], 2)])
def test_runs(sizes, start):
    assert segments.run_to_merge([segments.Segment("s", i, i, n) for i, n in enumerate(sizes)]) == start


def test_stream(spark, tmp_path):
    rng, live = random.Random(5), {}
    for n, ids in enumerate((["1", "2", "3"], ["3", "4"])):
        some, table = songs_of(spark, rng, ids)
        live |= {r[0]: r for r in some}
        table.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
        stream = increments.segment_stream(source, str(tmp_path / "out")).trigger(availableNow=True).start()  # started again for the second file
        stream.awaitTermination()
    found = segments.opened(spark, str(tmp_path / "out/index"))
    assert found.batch == 1
    same(spark, found, live)
