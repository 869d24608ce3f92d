import os

import numpy as np
from pyspark.sql import functions as F

from kinfold.operators import batching, curate, embed
from kinfold.streaming import batches, ingest


def test_resume_and_first_wins(spark, tmp_path):
    """Files arriving over several runs; keys seen before are not embedded again, and a batch reads its own rows only."""
    inbox, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    inbox.mkdir()
    (inbox / "one.csv").write_text("a,0,AC\nb,1,DE\na,2,ZZZ\n")
    columns = "key string, pos long, length long, embedding array<double>"
    read = []

    def transform(df):
        cleaned = curate.clean_records(df).withColumn("bucket", F.lit(0)).withColumn("batch", F.lit(0))
        out = embed.embed(cleaned).join(df.select("key", "pos"), "key")
        return out.where("status = 'embedded'").select("key", "pos", "length", "embedding")

    def run():
        stream = spark.readStream.schema("key string, pos long, sequence string").csv(str(inbox))
        query = ingest.ingest(stream, table, state, transform=transform)
        query.awaitTermination()
        read.extend(p.numInputRows for p in query.recentProgress if p.numInputRows)
        return {r.key: (r.pos, r.length) for r in ingest.read_stored(spark, table, columns).collect()}

    assert ingest.read_stored(spark, table, columns).collect() == []
    assert run() == {"a": (0, 2), "b": (1, 2)}
    assert run() == {"a": (0, 2), "b": (1, 2)}
    for k, text in enumerate(("b,9,GGGG\nc,10,KLM\n", "a,11,A\nb,12,C\nd,14,DD\nd,13,D\n", "c,20,A\n")):
        (inbox / f"more{k}.csv").write_text(text)
        stored = run()
    assert stored == {"a": (0, 2), "b": (1, 2), "c": (10, 3), "d": (13, 1)}
    assert read == [3, 2, 4, 1]
    # the last batch was written but not committed: it is replayed and replaces itself
    commits = f"{state}/commits"
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{commits}/{name}"):
            os.remove(f"{commits}/{name}")
    assert run() == stored and ingest.read_stored(spark, table, columns).count() == 4


def test_batches_do_not_depend_on_the_cut(spark, tmp_path):
    rng = np.random.default_rng(1)
    lengths = rng.integers(0, 40, 300)
    whole = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "id long, length long")
    want = sorted(map(tuple, batching.stream_batches(whole, ["id"], 7, 90, 35).select("id", "pos", "batch").collect()))
    for cut in ([300], [1, 2, 7, 8, 100, 182], [50] * 6):
        held, at, got = (0, 0, 0), 0, []
        for n in cut:
            batch, held = batches.carry(lengths[at : at + n], held, 7, 90, 35)
            got += batch.tolist()
            at += n
        assert got == [b for _, _, b in want]
    inbox, table = str(tmp_path / "in"), str(tmp_path / "table")
    for first in range(0, 300, 100):
        whole.where(f"id >= {first} and id < {first + 100}").coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(whole.schema).parquet(inbox)
        out = batches.stream_batches(stream, 7, 90, 35, order="id")
        ingest.store_batches(out, table, str(tmp_path / "state")).awaitTermination()
    stored = ingest.read_stored(spark, table, "source string, id long, pos long, batch long")
    assert sorted((r.id, r.pos, r.batch) for r in stored.collect()) == want
