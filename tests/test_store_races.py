"""Writers that meet, and writers that die."""

import json
import os
import signal
import subprocess
import sys
import threading
from pathlib import Path

from pyspark.sql import functions as F

from meridion.plans import fixtures
from meridion.plans.source_queries import COUNTRY_ID, LAND_ID, _countries, _land, _registry
from meridion.sources.adapters import LandAdapter
from meridion.sources.store import Project

SF = "/root/testdata/sf0.001"


def together(n, work):
    """The results of ``n`` threads that begin at once."""
    barrier, out = threading.Barrier(n), [None] * n

    def run(k):
        barrier.wait()
        out[k] = work(k)

    threads = [threading.Thread(target=run, args=(k,)) for k in range(n)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return out


def test_one_of_many_creators_wins(spark, tmp_path):
    made = together(8, lambda k: Project.create(spark, tmp_path / "p")[1])
    assert sorted(o.status for o in made) == ["already_exists"] * 7 + ["none"] and sum(o.changed for o in made) == 1
    assert Project.open(spark, tmp_path / "p")[0].revision() == 1


def test_no_change_of_many_writers_is_lost(spark, tmp_path):
    project, _ = Project.create(spark, tmp_path / "p")
    done = together(8, lambda k: [project.append_layer({"layer_id": f"l{k}.{i}", "role_id": "r", "name": "n"}) for i in range(5)])
    assert all(o.changed for own in done for o in own)
    assert project.revision() == 41 and len(project.state()["layers"]) == 40
    assert sorted(o.revision for own in done for o in own) == list(range(2, 42))
    assert [int(p.stem) for p in sorted((tmp_path / "p" / "commits").glob("*.json"))] == list(range(1, 42)) and not list((tmp_path / "p" / "commits").glob("*.tmp"))


def test_equal_datasets_are_stored_once(spark, tmp_path):
    project, _ = Project.create(spark, tmp_path / "p")
    snap = _land(spark, SF)
    data = _registry().load(spark, LAND_ID, snap)
    done = together(3, lambda k: project.store_snapshot(data, "land", LandAdapter(), snap))
    assert all(o.ok for o in done) and sum(o.changed for o in done) == 1 and project.revision() == 2
    assert project.geometry("land").count() == data.features.count() and not any(project.audit().values())
    other = _registry().load(spark, COUNTRY_ID, _countries(spark, SF))
    tries = together(2, lambda k: project.store_dataset(data if k else other, "same", "a", 1, "periodic"))
    assert sorted(o.status for o in tries) == ["none", "record_exists"]


WRITER = """
import os, sys, time
sys.path.insert(0, {root!r})
from pathlib import Path
from meridion.sources import store
project = store.Project(None, {path!r})
link = os.link
def slow(a, b):
    if Path(b).name >= "000000000004":
        print("there", flush=True)
        time.sleep(60)
    link(a, b)
store.os.link = slow
for k in range(100):
    project.append_layer({{"layer_id": f"x{{k}}", "role_id": "r", "name": "n"}})
"""


def test_a_killed_writer_leaves_the_last_whole_revision(spark, tmp_path):
    project, _ = Project.create(spark, tmp_path / "p")
    root = str(Path(__file__).resolve().parent.parent)
    writer = subprocess.Popen([sys.executable, "-c", WRITER.format(root=root, path=str(tmp_path / "p"))], stdout=subprocess.PIPE, text=True)
    assert writer.stdout.readline().strip() == "there"
    os.kill(writer.pid, signal.SIGKILL)
    writer.wait()
    again, opened = Project.open(spark, tmp_path / "p")
    assert opened.ok and again.revision() == 3 and [x["layer_id"] for x in again.state()["layers"]] == ["x0", "x1"]
    assert list((tmp_path / "p" / "commits").glob("*.tmp"))  # its unfinished file is there, and nobody reads it
    assert again.append_layer({"layer_id": "y", "role_id": "r", "name": "n"}).revision == 4 and project.revision() == 4
    (tmp_path / "p" / "commits" / "000000000004.json").write_text(json.dumps({"state": "{}", "sha256": "0" * 64}))
    assert Project.open(spark, tmp_path / "p")[1].status == "not_a_project"  # a damaged commit is no state


def test_files_of_uris(spark, tmp_path):
    from meridion.sources import shapefile

    (tmp_path / "a.dbf").write_bytes(fixtures.dbase_file([("N", "C", 3)], [[b"a"], [b"b"]]))
    (tmp_path / "a.shp").write_bytes(fixtures.polygon_file([[fixtures.box(0, 0, 1)], None]))
    shapefile.register(spark)
    for prefix in ("", "file://"):
        assert spark.read.format("dbase").load(f"{prefix}{tmp_path}/a.dbf").select(F.trim(F.col("N").cast("string")).alias("n")).collect() == [("a",), ("b",)]
        assert spark.read.format("polygon_shapefile").load(f"{prefix}{tmp_path}/a.shp").count() == 1
