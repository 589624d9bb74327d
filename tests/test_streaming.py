import pytest
from pyspark.sql import functions as F

from tamhis.plans.curate import valid_pairs, curate
from tamhis.plans.retrieval import plain_prompts
from tamhis.profiles import LATIN
from tamhis.schemas import REQUEST
from tamhis.streaming import curation, sink
from tamhis.streaming.curation import CURATED, KEYS, curate_stream, key_table
from tamhis.streaming.requests import prompt_stream
from tamhis.streaming.sink import BatchTable
from workloads import adapters as A

SF = "/root/testdata/sf0.01"


def land(df, path, part):
    """One file per call, later calls with later names."""
    df.coalesce(1).write.mode("append").parquet(f"{path}/part={part:03d}")


def stream(spark, schema, path):
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", True).parquet(path))


@pytest.mark.parametrize("broadcast_bytes", [curation.BROADCAST_BYTES, 0])
def test_incremental_curation_equals_batch(spark, tmp_path, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(curation, "BROADCAST_BYTES", broadcast_bytes)
    raw = A.raw_qa(spark, SF)
    cuts = [0, 250, 500, 750, 1000]
    for part, (low, high) in enumerate(zip(cuts, cuts[1:])):
        land(raw.filter((F.col("row_id") >= low) & (F.col("row_id") < high)), str(tmp_path / "in"), part)
        if part == 1:  # the first run sees two files, the second run the rest
            curate_stream(stream(spark, raw.schema, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), LATIN)
    table = curate_stream(stream(spark, raw.schema, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), LATIN)
    got = sorted(tuple(r) for r in table.read().collect())
    assert got == sorted(tuple(r) for r in curate(raw, LATIN).collect())
    assert len(list((tmp_path / "out").glob("batch_id=*"))) == 4


def test_a_batch_that_runs_twice_takes_effect_once(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"), CURATED)
    rows = spark.createDataFrame([(1, "q", "", "a")], CURATED)
    assert table.read().count() == table.earlier(0).count() == 0
    for _ in range(2):
        table.write(rows, 0)
        assert table.earlier(0).count() == 0
    assert table.read().count() == table.earlier(1).count() == 1


def test_compaction_keeps_the_rows_and_the_newest_batch(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"), KEYS, "key")
    for b in range(4):
        table.write(spark.createDataFrame([(bytes([b, k]),) for k in range(3)], KEYS), b)
    for _ in range(2):
        table.compact()
        assert table.batches() == [3] and table.read().count() == 12 and table.earlier(3).count() == 9
    table.write(spark.createDataFrame([(b"x",)], KEYS), 3)  # runs again
    table.write(spark.createDataFrame([(b"y",)], KEYS), 4)
    assert table.read().count() == 11 and table.probe(5, [b"x", b"q", bytes([1, 2])]).count() == 2
    table.compact()
    assert table.batches() == [4] and sorted(p.name for p in (tmp_path / "t").glob("batch*")) == ["batch_id=4", "batch_id=upto-3"]
    assert table.read().count() == 11 and table.probe(5, []).count() == 0


def scanned(df):
    """Rows that the scans of a query gave out."""
    df.collect()
    leaves, found = df._jdf.queryExecution().executedPlan().collectLeaves(), 0
    for i in range(leaves.size()):
        found += leaves.apply(i).metrics().apply("numOutputRows").value()
    return found


def test_probes_skip_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sink, "GROUP_BYTES", 64 << 10)
    spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", 1024)
    table = BatchTable(spark, str(tmp_path / "t"), KEYS, "key")
    rows = 200_000
    table.write(spark.range(rows).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("key")).repartition(8), 0, rows)
    assert len(list((tmp_path / "t" / "batch_id=0").glob("part-*"))) == 1  # a batch is one file
    wanted = [bytes(r.key) for r in spark.range(0, rows, 50_000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("key")).collect()]
    hit = table.probe(1, wanted)
    assert sorted(bytes(r.key) for r in hit.collect()) == sorted(wanted)
    assert scanned(hit) < rows / 5  # the other row groups are skipped
    other = [bytes(r.key) for r in spark.range(rows, rows + 4).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("key")).collect()]
    assert scanned(table.probe(1, other)) < rows / 10  # most by their Bloom filter


@pytest.mark.parametrize("probes", [0, 100, 1 << 20])
def test_any_number_of_probes_gives_the_same_table(spark, tmp_path, monkeypatch, probes):
    monkeypatch.setattr(curation, "PROBES", probes)
    raw = A.raw_qa(spark, SF)
    for part, (low, high) in enumerate([(0, 400), (400, 600), (600, 1000)]):
        land(raw.filter((F.col("row_id") >= low) & (F.col("row_id") < high)), str(tmp_path / "in"), part)
    table = curate_stream(stream(spark, raw.schema, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), LATIN)
    assert sorted(tuple(r) for r in table.read().collect()) == sorted(tuple(r) for r in curate(raw, LATIN).collect())
    files = list((tmp_path / "out-keys").glob("batch_id=*/part-*"))
    assert 1 <= len(files) <= 3  # a handful, not one for every first byte


def test_curation_after_compaction(spark, tmp_path):
    raw = A.raw_qa(spark, SF)
    for part, (low, high) in enumerate([(0, 300), (300, 600), (600, 1000)]):
        land(raw.filter((F.col("row_id") >= low) & (F.col("row_id") < high)), str(tmp_path / "in"), part)
        table = curate_stream(stream(spark, raw.schema, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), LATIN)
        table.compact()
        key_table(spark, str(tmp_path / "out")).compact()
    assert sorted(tuple(r) for r in table.read().collect()) == sorted(tuple(r) for r in curate(raw, LATIN).collect())


def test_request_stream_without_index(spark, tmp_path):
    rows = [("a", "hello", None, None), ("b", "x", None, None), ("c", "  ", 100, 0.5)]
    land(spark.createDataFrame(rows, REQUEST), str(tmp_path / "in"), 0)
    table = prompt_stream(stream(spark, REQUEST, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r.request_id: r for r in table.read().collect()}
    want = plain_prompts(spark.createDataFrame(rows[:1], REQUEST)).first()["prompt"]
    assert got["a"].prompt == want and got["a"].status == 200
    assert (got["b"].status, got["b"].prompt) == (422, None)
    assert (got["c"].status, got["c"].prompt) == (400, None)


def test_gates_run_on_a_stream_without_state(spark, tmp_path):
    raw = A.raw_qa(spark, SF)
    land(raw, str(tmp_path / "in"), 0)
    pairs = valid_pairs(stream(spark, raw.schema, str(tmp_path / "in")), LATIN)
    query = pairs.writeStream.format("memory").queryName("pairs").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("pairs").count() == valid_pairs(raw, LATIN).count() > 0


def test_tasks_that_hold_a_batch_send_only_its_keys(spark, tmp_path):
    """Each partition of a batch is read by a task of its own, also when all keys go to one file."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([bytes([TaskContext.get().partitionId()])] * batch.num_rows)], ["key"])

    table = BatchTable(spark, str(tmp_path / "t"), KEYS, "key")
    table.write(spark.range(0, 80, 1, 8).mapInArrow(run, KEYS), 0, 80)
    assert table.read().count() == 80 and table.read().distinct().count() == 8
    assert len(list((tmp_path / "t" / "batch_id=0").glob("*.parquet"))) == 1
