"""As-of joins of two tables, landing streams, stores of gates, versions of tables and lookups that skip."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import asof, ingest, research_units
from scriptorium.sources import lookup, versions
from scriptorium.streaming import landing


def shown(df):
    return sorted(tuple(r) for r in df.collect())


def plain_asof(left, right):
    for own, key, place in left:
        before = [(at, n, word) for k, at, n, word in right if k is not None and k == key and at is not None and place is not None and at <= place]
        yield (own, key, place, *(max(before)[1:] if before else (None, None)))


@pytest.mark.parametrize("seed", range(4))
def test_asof_equals_brute_force(spark, seed):
    """Hot keys, equal places on both sides, nulls, and keys that only one side has."""
    rng = random.Random(seed)
    key = lambda: rng.choice([0] * 6 + [1, 2, 3, None])
    left = [(i, key(), rng.choice([None, *range(60)])) for i in range(400)]
    right = [(key() if i % 9 else 7, rng.choice([None, *range(0, 60, 7)]), i, f"w{i}") for i in range(40)]
    a = spark.createDataFrame(left, "own long, k long, at long")
    b = spark.createDataFrame(right, "k long, start long, n long, word string")
    found = asof.asof_join(a, b, "k", ("at", "start"), ["n", "word"], "n")
    assert found.columns == ["own", "k", "at", "n", "word"]
    assert shown(found.fillna(-9)) == shown(spark.createDataFrame(list(plain_asof(left, right)), found.schema).fillna(-9))


def test_asof_of_one_key_is_spread_and_carried_over_borders(spark):
    """One paper with a million offsets, one heading far before nearly all of them: many tasks, none with most rows."""
    offsets = spark.range(1_000_000).select(F.lit(1).cast("long").alias("paper_id"), (F.col("id") % 1000).alias("position"), "id")
    nodes = spark.createDataFrame([(1, 0, 0, "first"), (1, 1, 990, "last"), (2, 0, 0, "other")], "paper_id long, ordinal int, start_offset long, heading_raw string")
    auto = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = asof.sections_at(offsets, nodes)
        assert dict(shown(found.groupBy("section").count())) == {"first": 990_000, "last": 10_000}
        parts = shown(spark.read.parquet(*found.inputFiles()).filter("_side = 1").groupBy("_part").count())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", auto)
    assert len(parts) >= 6 and max(n for _, n in parts) < 300_000


def test_asof_of_empty_tables_and_clashing_names(spark):
    left = spark.createDataFrame([(1, 5)], "k long, at long")
    right = spark.createDataFrame([], "k long, start long, word string")
    assert shown(asof.asof_join(left, right, "k", ("at", "start"), ["word"])) == [(1, 5, None)]
    assert shown(asof.asof_join(left.limit(0), right, "k", ("at", "start"), ["word"])) == []
    with pytest.raises(ValueError, match="both sides: at"):
        asof.asof_join(left, right.withColumnRenamed("start", "at"), "k", ("at", "at"), ["at"])


ARRIVAL = "paper_id long, hash string, created_at long"


def arrive(spark, root, name, rows):
    spark.createDataFrame(rows, ARRIVAL).coalesce(1).write.parquet(f"{root}/in/{name}")


def land(spark, root):
    stream = spark.readStream.schema(ARRIVAL).parquet(f"{root}/in/*")
    landing.land(stream, f"{root}/papers", f"{root}/checkpoint").awaitTermination()


def test_landed_batches_keep_the_first_of_each_hash(spark, tmp_path):
    root = str(tmp_path)
    arrive(spark, root, "a", [(3, "x", 9), (2, "x", 9), (4, "y", 1), (5, None, 1)])
    land(spark, root)
    arrive(spark, root, "b", [(1, "x", 0), (6, "z", 5), (7, None, 1)])
    land(spark, root)
    land(spark, root)  # nothing has come
    arrive(spark, root, "c", [(8, "z", 0), (9, "y", 0), (3, "x", 9)])
    land(spark, root)
    papers = landing.landed_papers(spark, f"{root}/papers")
    assert sorted(r[0] for r in papers.select("paper_id").collect()) == [2, 4, 5, 6, 7]
    kept = landing.resolved(spark.read.parquet(f"{root}/in/*"), papers)
    assert {(r.paper_id, r.kept_id) for r in kept.collect()} == {(1, 2), (2, 2), (3, 2), (4, 4), (9, 4), (6, 6), (8, 6), (5, None), (7, None)}


def test_a_batch_that_runs_again_overwrites_its_own_papers(spark, tmp_path):
    """The commit of the last batch is lost, as after a crash; what it wrote is damaged, too."""
    root = str(tmp_path)
    for name, rows in (("a", [(1, "x", 1), (2, "y", 1)]), ("b", [(3, "x", 0), (4, "z", 2)])):
        arrive(spark, root, name, rows)
        land(spark, root)
    wanted = shown(landing.landed_papers(spark, f"{root}/papers").select("paper_id", "hash"))
    for name in ("1", ".1.crc"):
        os.remove(f"{root}/checkpoint/commits/{name}")
    os.remove(f"{root}/papers/epoch=1/_SUCCESS")
    assert landing.landed_papers(spark, f"{root}/papers").count() == 2
    land(spark, root)
    assert shown(landing.landed_papers(spark, f"{root}/papers").select("paper_id", "hash")) == wanted == [(1, "x"), (2, "y"), (4, "z")]


def test_landed_files(spark, tmp_path):
    os.makedirs(tmp_path / "in" / "deep")
    for name, content in (("a.pdf", b"1"), ("deep/b.pdf", b"1"), ("c.pdf", b"2"), ("d.txt", b"3")):
        (tmp_path / "in" / name).write_bytes(content)
    stream = landing.arriving_pdfs(spark, str(tmp_path / "in"))
    landing.land(stream, str(tmp_path / "papers"), str(tmp_path / "checkpoint")).awaitTermination()
    papers = landing.landed_papers(spark, str(tmp_path / "papers"))
    assert {r.hash for r in papers.collect()} == {hashlib.md5(x).hexdigest() for x in (b"1", b"2")} and papers.count() == 2


def gates(spark, rows):
    shape = "paper_id long, markdown_hash string, rule_version string, verdict string, evidence array<struct<kind: string, label: string>>"
    return spark.createDataFrame(rows, shape)


def files_of(path):
    return {os.path.join(folder, n) for folder, _, names in os.walk(path) for n in names}


def test_gates_are_replaced_whole_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "gates")
    research_units.write_gates(path, gates(spark, [(i, "h", "1.0", "single", [("study", "1"), ("wave", "2")]) for i in range(50)]))
    before = files_of(path)
    old = research_units.stored_gates(spark, path, "evidence")
    research_units.write_gates(path, gates(spark, [(7, "h", "1.0", "multi", [("study", "3")]), (8, "h", "1.0", "uncertain", []), (7, "h", "2.0", "single", [])]))
    assert before <= files_of(path) and old.count() == 100
    for _ in range(2):
        now = research_units.stored_gates(spark, path)
        assert now.count() == 51 and shown(now.filter("paper_id = 7").select("rule_version", "verdict")) == [("1.0", "multi"), ("2.0", "single")]
        evidence = research_units.stored_gates(spark, path, "evidence").join(now.select("gate_id", "paper_id"), "gate_id")
        assert evidence.count() == 97 and shown(evidence.filter("paper_id in (7, 8)").select("paper_id", "position", "kind", "label")) == [(7, 0, "study", "3")]
        research_units.compact_gates(spark, path)
        assert len(os.listdir(f"{path}/batches")) == len([n for n in os.listdir(f"{path}/commits") if not n.startswith(".")]) == 1


def nodes(spark, methods, *more):
    return spark.createDataFrame([(i, m, *more) for i, m in enumerate(methods)], "ordinal int, method string" + ", heading_source string" * len(more))


def test_versions_are_read_as_the_newest(spark, tmp_path):
    path = str(tmp_path / "nodes")
    with pytest.raises(LookupError):
        versions.read_versions(spark, path, versions.NODES)
    versions.write_version(nodes(spark, ["rule", None]), path, versions.NODES, 1)
    versions.write_version(nodes(spark, ["inherited"]), path, versions.NODES, 2)
    versions.write_version(nodes(spark, ["child_consensus"], "inferred"), path, versions.NODES, 4)
    wanted = [("", ""), ("child_consensus", "inferred"), ("inherited", ""), ("rule", "")]
    read = lambda: shown(versions.read_versions(spark, path, versions.NODES).select("method", "heading_source").fillna(""))
    assert read() == wanted
    with pytest.raises(Exception, match="refuses a row"):
        versions.write_version(nodes(spark, ["rule", "inherited"]), path, versions.NODES, 1)
    assert read() == wanted
    with pytest.raises(ValueError, match="only 3 are known"):
        versions.read_versions(spark, path, versions.NODES[:3])
    assert versions.migrate(spark, path, versions.NODES) == 2 and read() == wanted
    assert versions.migrate(spark, path, versions.NODES) == 0 and os.listdir(f"{path}/version=4") and not os.listdir(f"{path}/version=1")


def test_a_migration_that_stopped_halfway_is_read_once(spark, tmp_path):
    """A batch that is there in both versions counts in the newer one, if that was written to its end."""
    path = str(tmp_path / "papers")
    papers = spark.createDataFrame([(1, "text"), (2, "")], "paper_id long, markdown string")
    batch = versions.write_version(papers, path, versions.PAPERS, 1)
    versions.write_version(versions.brought_up(papers, versions.PAPERS, 1), path, versions.PAPERS, 2, batch)
    read = lambda: dict(shown(versions.read_versions(spark, path, versions.PAPERS).select("paper_id", "markdown_hash")))
    wanted = {1: hashlib.sha256(b"text").hexdigest(), 2: ""}
    assert read() == wanted
    os.remove(f"{path}/version=2/{batch}/_SUCCESS")
    assert read() == wanted and versions.migrate(spark, path, versions.PAPERS) == 1 and read() == wanted


def scanned(df):
    """Rows that the scans of a frame gave, after it was collected."""
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
        if plan.nodeName().startswith("Scan") or "FileSourceScan" in plan.getClass().getName():
            found += plan.metrics().apply("numOutputRows").value()
    return found


def test_lookups_read_one_row_group(spark, tmp_path):
    path = str(tmp_path / "papers")
    rows = spark.range(100_000).select(F.col("id").alias("paper_id"), ingest.content_hash(F.col("id").cast("string")).alias("hash"))
    lookup.write_by_hash(rows, path, 20_000, 8)
    of = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    for df in (lookup.find_hashes(spark, path, [of(77)]), lookup.find_ids(spark, path, [77])):
        assert shown(df) == [(77, of(77))]
        assert 1 <= scanned(df) <= 20_000
    none = lookup.find_hashes(spark, path, ["0" * 31 + "g", "", None])
    assert shown(none) == [] and scanned(none) <= 20_000
    assert lookup.find_hashes(spark, path, []).count() == 0 and lookup.find_ids(spark, path, list(range(500))).count() == 500
    assert lookup.find_hashes(spark, path, [of(i) for i in range(30)]).count() == 30
