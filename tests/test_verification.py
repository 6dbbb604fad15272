"""Dataset verification on real files, and its rules against loops."""

import random

from kairolake.plans import verification as V

REQUIRED, FILES, DURATIONS = "dataset string, id string, stop_s double", "dataset string, id string, path string, length long", "dataset string, id string, have_s double"


def test_files_of_a_folder_are_named(spark, tmp_path):
    sizes = {"a/videos/whole.mp4": 4000, "a/videos/cut.mp4": 3000, "a/videos/stub.mp4": 90, "a/videos/twice.mp4": 2000, "a/other/twice.mp4": 2500, "a/videos/extra.mp4": 2000, "a/videos/note.txt": 10, "b/x.y.mp4": 5000}
    for name, size in sizes.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    files = V.media_files(spark, f"file://{tmp_path}")
    required = spark.createDataFrame([("a", v, s) for v, s in [("whole", 5.0), ("whole", 9.0), ("cut", 9.0), ("stub", 1.0), ("twice", 1.0), ("gone", 2.0)]] + [("b", "x.y", None), (None, "q", 1.0), ("a", None, 1.0)], REQUIRED)
    durations = spark.createDataFrame([("a", "whole", 8.95), ("a", "cut", 7.0), ("a", "twice", 3.0), ("a", "gone", 9.0), ("a", "nobody", 1.0)], DURATIONS)
    seen = V.verify_files(required, files, durations)
    assert {(r["dataset"], r["id"]): (r["status"], r["copies"]) for r in seen.collect()} == {
        ("a", "whole"): ("ok", 1), ("a", "cut"): ("short", 1), ("a", "stub"): ("pointer", 1), ("a", "twice"): ("ok", 2), ("a", "gone"): ("missing", 0), ("a", "extra"): ("unasked", 1), ("b", "x.y"): ("ok", 1),
    }
    got = {r["dataset"]: r for r in V.dataset_status(seen, files, small_bytes=2000).collect()}
    assert not got["a"]["ready"] and got["b"]["ready"] and got["b"]["advice"] == []
    assert got["a"]["advice"] == ["fetch the missing files", "replace pointers by their content", "import the whole recordings", "keep one file an id"]
    assert (got["a"]["required"], got["a"]["files"], got["a"]["small"], got["a"]["min"], got["a"]["max"], got["a"]["total"], got["a"]["worst_s"]) == (5, 6, 3, 90, 4000, 13590, 1.9)
    assert [(r["id"], r["place"]) for r in V.worst_shortfalls(seen).collect()] == [("cut", 1)]


def test_nothing_there(spark):
    none = spark.createDataFrame([], FILES)
    seen = V.verify_files(spark.createDataFrame([("a", "v", 1.0)], REQUIRED), none, spark.createDataFrame([], DURATIONS))
    row = V.dataset_status(seen, none).first()
    assert (row["required"], row["missing"], row["files"], row["small"], row["ready"], row["total"]) == (1, 1, 0, 0, False, None)
    assert V.verify_files(spark.createDataFrame([], REQUIRED), none, spark.createDataFrame([], DURATIONS)).count() == 0


def test_against_loops(spark):
    rng = random.Random(4)
    some = lambda n, *values: [(f"d{rng.randint(0, 2)}", f"v{rng.randint(0, 60)}", *(v() for v in values)) for _ in range(n)]
    second = lambda: rng.choice([None, *map(float, range(1, 30))])
    required, files, durations = some(200, second), some(120, lambda: "p", lambda: rng.choice([10, 1024, 1025, 9000])), some(120, second)
    seen = V.verify_files(spark.createDataFrame(required, REQUIRED), spark.createDataFrame(files, FILES), spark.createDataFrame(durations, DURATIONS))
    want = {}
    most = lambda values: max((v for v in values if v is not None), default=None)
    for key in {r[:2] for r in required + files}:
        asked, sizes = [r[2] for r in required if r[:2] == key], [r[3] for r in files if r[:2] == key]
        need, have = most(asked), most([r[2] for r in durations if r[:2] == key])
        late = None if need is None or have is None else need - have - 0.1
        state = "unasked" if not asked else "missing" if not sizes else "pointer" if max(sizes) <= 1024 else "unprobed" if need is not None and have is None else "short" if late is not None and late > 0 else "ok"
        want[key] = (state, len(sizes), late)
    assert {(r["dataset"], r["id"]): (r["status"], r["copies"], r["shortfall_s"]) for r in seen.collect()} == want
    assert {s for s, *_ in want.values()} == set(V.STATES)
    worst = sorted(((d, -late, v) for (d, v), (s, _, late) in want.items() if s == "short"))
    got = [(r["dataset"], -r["shortfall_s"], r["id"]) for r in V.worst_shortfalls(seen, 5).orderBy("dataset", "place").collect()]
    assert got == [w for d in ("d0", "d1", "d2") for w in [x for x in worst if x[0] == d][:5]]
