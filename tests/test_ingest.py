"""CSV in ranges, keyed tables, ingest of files and streams with what fails set aside."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.plans import service
from evidentia.sources import csv_scan, readers
from evidentia.sources.keyed import KeyedTable
from evidentia.streaming import ingest
from evidentia.tables import stored


@pytest.fixture()
def range_bytes(spark):
    name = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(name)
    yield lambda n: spark.conf.set(name, str(n))
    spark.conf.set(name, old)


def _messy(folder, files=2, rows=25):
    """Quoted line ends, doubled and stray quotes, rows too short and too long, empty lines."""
    rng = random.Random(1)

    def field():
        x = "".join(rng.choice('ab ,"\n\ré') for _ in range(rng.randint(0, 8)))
        if rng.random() < 0.15:
            return "".join(c for c in x if c not in '",\n\r') + ('"x' if rng.random() < 0.3 else "")
        return '"' + x.replace("\r", "").replace('"', '""') + '"'

    for f in range(files):
        with open(folder / f"f{f}.csv", "w", newline="") as out:
            out.write("a,b,text\n")
            for _ in range(rows):
                out.write(",".join(field() for _ in range(rng.choice([3, 3, 3, 2, 4]))) + "\n" + ("\n" if rng.random() < 0.1 else ""))


@pytest.mark.parametrize("size", [40, 400])
def test_csv_in_ranges_equals_a_whole_read(spark, tmp_path, range_bytes, size):
    _messy(tmp_path)
    shape = "a string, b string, text string, _corrupt string"
    whole = spark.read.schema(shape).options(header="true", multiLine="true", escape='"', columnNameOfCorruptRecord="_corrupt").csv(str(tmp_path)).select("*", F.col("_metadata.file_path").alias("s3_key"), F.monotonically_increasing_id().alias("at"))
    want, number = set(), {}
    for r in sorted(whole.where("_corrupt is null or text is null").collect(), key=lambda r: (r.s3_key, r.at)):
        number[r.s3_key] = number.get(r.s3_key, 0) + 1
        want.add((r.s3_key, number[r.s3_key], r.a or "", r.b or "", r.text or ""))
    range_bytes(size)
    got = readers.csv_rows(spark, str(tmp_path))
    assert {(r.s3_key, r.row_index, r.a, r.b, r.text) for r in got.collect()} == want
    if size < 100:  # one file goes to many tasks
        assert len(csv_scan.ranges(csv_scan._lines(spark, str(tmp_path / "f0.csv"))).select("range").collect()) > 5


def test_csv_beyond_the_broadcast_and_blocks(spark, tmp_path, range_bytes, monkeypatch):
    _messy(tmp_path, 1)
    want = {tuple(r) for r in readers.csv_rows(spark, str(tmp_path)).collect()}
    range_bytes(60)
    monkeypatch.setattr(csv_scan, "RANGES", 0)
    monkeypatch.setattr(csv_scan, "BLOCK", 7)
    assert {tuple(r) for r in readers.csv_rows(spark, str(tmp_path)).collect()} == want


def test_a_field_over_many_ranges(spark, tmp_path, range_bytes):
    (tmp_path / "x.csv").write_text('text,n\r\n"' + "line, with \"\"quotes\"\"\r\n" * 40 + '",1\r\nplain,2\r\n')
    range_bytes(64)
    got = {r.n: r for r in readers.csv_rows(spark, str(tmp_path)).collect()}
    assert got["1"].text == 'line, with "quotes"\n' * 40 and (got["2"].text, got["2"].row_index) == ("plain", 2)


def test_csv_without_rows(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,text\n")
    assert readers.csv_rows(spark, str(tmp_path)).collect() == []
    (tmp_path / "x.csv").write_text("")
    assert readers.csv_rows(spark, str(tmp_path)).collect() == []


def test_keyed_table_reads_only_what_may_match(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "id")
    rows = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("id"), (F.col("id") * 2).alias("x"))
    table.upsert(rows(0, 3000))
    assert (table.added, table.files_read) == (3000, 0)
    files = len(table.rows().inputFiles())
    table.upsert(rows(3000, 3200))
    assert table.added == 200 and table.files_read < files / 20  # about one unknown key in 500 looks known
    table.upsert(rows(10, 14).unionByName(rows(3200, 3210)))
    assert table.added == 10 and 0 < table.buckets_read <= 6
    table.upsert(rows(0, 3210))
    assert table.added == 0 and table.rows().count() == 3210 == table.rows().select("id").distinct().count()


def test_keyed_table_of_odd_rows(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "id")
    empty = spark.createDataFrame([], "id bigint, x string")
    table.upsert(empty)
    assert table.rows().count() == 0
    seen = []
    odd = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (-5, None)], "id bigint, x string")
    for _ in range(2):
        table.upsert(odd, lambda df: seen.append(df.count()) or stored(df.where("id > 0"), "some"))
    assert seen == [2, 1] and [(r.id, r.x) for r in table.rows().collect()] == [(1, "b")]


def picky(word):
    """Fails for texts that hold a word, as long as it is set.  A local class, so that tasks get it by value."""

    class Picky:
        def embed(self, texts):
            if word and any(word in t for t in texts):
                raise RuntimeError("no vector")
            return [[float(len(t))] for t in texts]

    return Picky()


def test_one_poisoned_chunk_loses_nothing_else(spark, tmp_path):
    source, target, state, dead = (str(tmp_path / x) for x in ("src", "table", "state", "dead"))
    spark.createDataFrame([(f"{'poison' if i == 7 else 'text'} number {i}",) for i in range(80)], "evidence_text string").coalesce(1).write.parquet(source)
    run = lambda word: ingest.ingest(spark, source, "evidence_text string", target, state, embedder=picky(word), dead=dead, wait=lambda a: 0).awaitTermination()
    run("poison")
    assert spark.read.parquet(target).count() == 79
    (lost,) = ingest.dead_letters(spark, target, dead).collect()
    assert "no vector" in lost.error and lost.times == 1
    assert spark.read.text(f"{state}/_batches/*.json").count() == 1
    run("poison")  # the next run tries it again, in vain
    assert spark.read.parquet(target).count() == 79 and ingest.dead_letters(spark, target, dead).first().times == 2
    run(None)
    assert spark.read.parquet(target).count() == 80 and ingest.dead_letters(spark, target, dead).count() == 0
    assert spark.read.parquet(target).where("text like 'poison%'").first().embedding == [15.0]


def test_a_batch_that_was_cut_off_adds_what_is_missing(spark, tmp_path):
    """Without its record, a batch is done again: chunks that are there stay single."""
    source, target, state = (str(tmp_path / x) for x in ("src", "table", "state"))
    spark.createDataFrame([(f"text number {i}",) for i in range(9)], "evidence_text string").write.parquet(source)
    ingest.ingest(spark, source, "evidence_text string", target, state).awaitTermination()
    ingest.ingest(spark, source, "evidence_text string", target, state + "again").awaitTermination()
    assert spark.read.parquet(target).count() == 9


def test_files_in_a_fixed_number_of_jobs(spark, tmp_path):
    """Files of all kinds and headers, some broken: the others are added, and more files take no more jobs."""
    jobs = []
    for n in (2, 12):
        base = tmp_path / str(n)
        base.mkdir()
        for i in range(n):
            (base / f"a{i}.csv").write_text(f'evidence_text,title\n"fact {i}\nof {n}",t\nx,y,z\n,\n')
            (base / f"b{i}.csv").write_text(f"title,evidence_text\nt,other {i}\n")
            spark.createDataFrame([(f"parquet {i}", i)], "evidence_text string, n int").coalesce(1).write.parquet(str(base / f"p{i}"))
            (base / f"p{i}.parquet").write_bytes(next((base / f"p{i}").glob("*.parquet")).read_bytes())
            (base / f"t{i}.txt").write_text(f"note {i}")
        (base / "bad.parquet").write_text("no parquet")
        (base / "none.parquet").write_text("")
        files = [str(base / f"{k}{i}.{e}") for i in range(n) for k, e in (("a", "csv"), ("b", "csv"), ("p", "parquet"), ("t", "txt"))] + [str(base / "bad.parquet"), str(base / "none.parquet"), str(base / "absent.csv")]
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
        stats = service.ingest(spark, files, str(base / "out"), report=str(base / "report"))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before)
        assert (stats["files"], stats["rows"], stats["skipped"], stats["chunks"]) == (4 * n, 5 * n, n, 4 * n)
        assert sorted(e.rsplit("/", 1)[1] for e in stats["errors"]) == ["absent.csv: FileNotFound", "bad.parquet: not Parquet", "none.parquet: not Parquet"]
        assert spark.read.parquet(str(base / "out")).count() == 4 * n
        left = spark.read.parquet(str(base / "report/rows")).groupBy("reason").count().collect()
        assert {r.reason: r["count"] for r in left} == {"says nothing": n, "more fields than columns": n}
        assert spark.read.parquet(str(base / "report/files")).count() == 4 * n
    assert jobs[1] <= jobs[0] + 5


def test_files_whose_types_clash(spark, tmp_path):
    for i, kind in enumerate(("string", "int")):
        spark.sql(f"SELECT 'fact {i}' AS evidence_text, CAST('1' AS {kind}) AS n").coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        (tmp_path / f"p{i}.parquet").write_bytes(next((tmp_path / f"p{i}").glob("*.parquet")).read_bytes())
    stats = service.ingest(spark, [str(tmp_path / "p0.parquet"), str(tmp_path / "p1.parquet")], str(tmp_path / "out"))
    assert (stats["files"], stats["chunks"], stats["errors"]) == (2, 2, [])
    assert service.ingest(spark, [], str(tmp_path / "out"))["files"] == 0


def test_an_upsert_of_known_keys_looks_at_no_row(spark, tmp_path):
    """Where no key is new, nothing is finished; where some are, only those, and a bucket's rows are in one file or two."""
    from evidentia.sources import sinks
    from evidentia.tables import stored

    met = []

    def finish(new):
        met.append(new.count())
        return stored(new, "new")

    path = str(tmp_path / "t")
    rows = spark.range(5000).repartition(8).selectExpr("cast(id as string) AS k", "id AS v")
    assert sinks.upsert(rows, path, "k", finish).added == 5000
    assert len(list((tmp_path / "t").glob("bucket=*/*.parquet"))) <= 512
    assert sinks.upsert(rows, path, "k", finish).added == 0 and met == [5000]
    more = spark.range(4990, 5010).selectExpr("cast(id as string) AS k", "id AS v")
    assert sinks.upsert(more, path, "k", finish).added == 10 and met == [5000, 10]
    assert spark.read.parquet(path).select("k").distinct().count() == spark.read.parquet(path).count() == 5010


def test_chunks_are_counted_without_being_cut(spark):
    from evidentia.functions import text as T

    df = spark.createDataFrame([(None,), ("",), (" \n",), *[(" " + "\u00e9" * n + " ",) for n in (1, 999, 1000, 1001, 1850, 1851, 4000)]], "t string")
    assert df.where(F.size(T.chunks(F.col("t"))) != T.chunk_count(F.col("t"))).count() == 0
