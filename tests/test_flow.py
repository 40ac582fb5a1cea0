"""Streams and walks over ranges: the same rows as from the whole at once."""

import itertools
import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, StringStartsWith

from docloom.operators import budget, meetings, running
from docloom.sources import documents, readers
from docloom.streaming import reorder

PARTS = "recording string, part int, offset double, at timestamp, segments array<struct<start:double,end:double,speaker:string,text:string>>"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


def test_parts_in_order(rocks, tmp_path):
    """Shuffled parts in several batches give the rows of all at once; missing parts are given up; no state is left."""
    rnd, rows, whole = random.Random(3), [], []
    for r in range(6):
        n = rnd.randint(1, 6)
        for p in range(n):
            segments = [{"start": float(i), "end": i + 0.5, "speaker": " A ", "text": rnd.choice([" hm", "yes ", " "])} for i in range(3)]
            if (r, p) in ((2, 0), (4, 1)):
                continue  # never comes
            minute = rnd.randint(0, 9)
            rows.append({"recording": f"r{r}", "part": p, "offset": 300.0 * p, "at": f"2024-01-01T00:0{minute}:00Z", "segments": segments})
            whole += [(f"r{r}", p, s["start"] + 300 * p, s["end"] + 300 * p, "A", s["text"].strip()) for s in segments if s["text"].strip()]
    rows.append(rows[0])  # comes twice
    rnd.shuffle(rows)
    # late in event time, so that the watermark passes all timers
    rows += [{"recording": f"z{i}", "part": 0, "offset": 0.0, "at": f"2024-01-0{i + 2}T00:00:00Z", "segments": []} for i in range(3)]
    for i in range(0, len(rows), 4):
        (tmp_path / "in").mkdir(exist_ok=True)
        (file := tmp_path / "in" / f"{i:04d}.json").write_text("\n".join(json.dumps(r) for r in rows[i : i + 4]))
        os.utime(file, (1_700_000_000 + i,) * 2)  # files are read by their time
    stream = rocks.readStream.schema(PARTS).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(tmp_path / "in"))
    seen = []
    query = (
        reorder.in_order(stream, "1 hour", "30 minutes").writeStream.foreachBatch(lambda df, n: seen.extend((n, *r) for r in df.collect()))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(200)
    assert sorted(r[1:] for r in seen) == sorted(whole)
    for r in {x[1] for x in seen}:  # in order as they come out
        mine = [x[3:5] for x in sorted((x for x in seen if x[1] == r), key=lambda x: (x[0], x[2], x[3]))]
        assert mine == sorted(mine)
    left = {name: [r[0] for r in rocks.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "state")).select("key.recording").collect()] for name in ("due", "waiting")}
    assert left == {"due": ["z2"], "waiting": []}  # the last one's time isn't up yet


def test_roots_over_ranges(spark):
    rnd = random.Random(6)
    rows = [(g, "".join(rnd.choices("ab", k=rnd.randint(1, 7)))) for g in range(4) for _ in range(60)] + [(9, "x" * n) for n in range(3, 40)] + [(None, "a"), (1, None)]
    plain = {(g, k): min((h for f, h in rows if f == g and h and k.startswith(h)), key=len) for g, k in rows if g is not None and k is not None}
    for ranges in (1, 5, 40):
        spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
        got = {(r["g"], r["k"]): r["root"] for r in meetings.roots(spark.createDataFrame(rows, "g int, k string"), "g", "k").collect()}
        assert got == plain
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert meetings.roots(spark.createDataFrame([], "g int, k string"), "g", "k").collect() == []


def plain_pages(rows, capacity, rest):
    """A fold over (height, stays, light): units with what follows, pages with something that isn't light."""
    units, out = [], []
    for h, stays, light in rows:
        if units and units[-1][2]:
            units[-1] = (units[-1][0] + h, units[-1][1] and light, stays, units[-1][3] + 1)
        else:
            units.append((h, light, stays, 1))
    page, used, room, filled = 1, 0, capacity, False
    for h, light, _, n in units:
        if used + h > room and filled:
            page, used, room, filled = page + 1, 0, rest, False
        used, filled = used + h, filled or not light
        out += [page] * n
    return out


def test_pages_of_lists_of_any_length(spark):
    rnd = random.Random(8)
    lists = {g: [(rnd.randint(0, 40), rnd.random() < 0.2, rnd.random() < 0.3) for _ in range(n)] for g, n in (("a", 1), ("b", 3), ("c", 150), ("d", 40))}
    lists["e"] = [(1, False, True)] * 30  # nothing but light rows
    rows = [(g, i, *r) for g, own in lists.items() for i, r in enumerate(own)]
    df = spark.createDataFrame(rows, "g string, i int, h int, stays boolean, light boolean")
    got = {(r["g"], r["i"]): r["page"] for r in budget.paginate_rows(df, "g", ["i"], "h", 60, 45, "stays", "light").collect()}
    assert got == {(g, i): p for g, own in lists.items() for i, p in enumerate(plain_pages(own, 60, 45))}
    assert budget.paginate_rows(df.limit(0), "g", ["i"], "h", 60).collect() == []


def test_million_rows_on_pages(spark):
    long = spark.range(1_000_000).select(F.lit(1).alias("g"), F.col("id").alias("i"), (F.col("id") * 7 % 13 + 1).alias("h"))
    found = budget.paginate_rows(long, "g", ["i"], "h", 5000).groupBy("page").agg(F.sum("h").alias("h"), F.min("i").alias("a"), F.max("i").alias("b")).orderBy("page").collect()
    assert [r["page"] for r in found] == list(range(1, len(found) + 1)) and found[-1]["b"] == 999_999
    assert all(r["h"] <= 5000 < r["h"] + ((r["b"] + 1) * 7 % 13 + 1) and r["b"] + 1 == n["a"] for r, n in itertools.pairwise(found))


def test_running_sums_over_ranges(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice(["hot"] * 8 + ["x", "y", None]), i, rnd.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    got = {r["i"]: (r["s"], r["nxt"]) for r in running.following(running.before(df, "g", ["i"], s=F.col("v")), "g", ["i"], F.when(F.col("v") > 6, F.col("i")), "nxt").collect()}
    assert got == {i: (sum(v for h, j, v in rows if h == g and j < i), next((j for h, j, v in rows if h == g and j > i and v > 6), None)) for g, i, _ in rows}


def test_documents_as_a_source(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in (("a.md", "# One\n\ntext"), ("b.txt", "two"), ("c.vtt", "WEBVTT\n\n00:01 --> 00:02\nhi"), ("d.png", "no"), ("e.docx", "not a zip"), ("sub/f.TXT", "six"), ("plan b.md", "x"), ("empty.md", "")):
        (tmp_path / name).write_text(text)
    documents.register(spark)
    load = lambda **more: spark.read.format("documents").options(**more).load(str(tmp_path))
    plain = readers.blocks(readers.scan(spark, str(tmp_path)))
    assert sorted(map(str, load().drop("name").collect())) == sorted(map(str, plain.collect())) and load().count() > 4
    assert {r["name"] for r in load(recursive="true").collect()} >= {"f.TXT"}
    (tmp_path / "b.txt").chmod(0)
    (tmp_path / "b.txt").unlink()  # what a filter leaves out isn't read
    some = load().where("ext = 'md' and name like 'pl%' and length(coalesce(text, '')) >= 0")
    assert [r["name"] for r in some.select("name").distinct().collect()] == ["plan b.md"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "ext" in plan and not any(line.strip().startswith("Filter") and "ext#" in line for line in plan.split("\n"))
    reader = documents.DocumentsReader(str(tmp_path), False)
    rest = list(reader.pushFilters([EqualTo(("ext",), "md"), StringStartsWith(("name",), "a"), EqualTo(("page",), 1)]))
    assert [type(f).__name__ for f in rest] == ["EqualTo"] and [_n for p in reader.partitions() for _n in p.paths] == [str(tmp_path / "a.md")]


def test_meetings(spark):
    names = ["2024-05-01_0900_Kickoff_transcripcion.vtt", "2024-05-02_1000_2024-05-01_0900_kickoff.md", "2024-05-03_1100_kickoff_b.txt", "2024-05-04_1200_otra.docx", "x.png", "2024-05-04_1200_.md", "old/2023-01-01_0000_kick.md"]
    files = spark.createDataFrame([("f", n) for n in names] + [("g", names[0])], "folder string, name string")
    got = {(r["folder"], r["origin"]): (r["minutes"], r["transcripts"]) for r in meetings.meetings(files, "folder", "name").collect()}
    assert got == {
        ("f", "kick"): ([names[6], names[1]], [names[2], names[0]]),
        ("f", "otra"): ([], [names[3]]),
        ("f", "2024-05-04_1200_"): ([names[5]], []),
        ("g", "kickoff"): ([], [names[0]]),
    }
    keys = files.select(F.lit("Ä/b.c.md").alias("n")).select(meetings.meeting_key(F.col("n"))).first()
    assert keys[0] == "b.c"


def test_links_of_pages_are_followed_by_stretches(spark, monkeypatch):
    """Lists of several stretches, pages longer than one, lists that end anywhere; of the links only those at the stretches' edges are joined."""
    sizes = []

    def kept(df):
        out = real(df)
        sizes.append(out.count())
        return out

    real = budget.kept
    monkeypatch.setattr(budget, "kept", kept)
    step = {"a": lambda u: 3, "b": lambda u: 1 + u % 5, "c": lambda u: 150 if u % 7 == 2 else 2, "d": lambda u: 1000}
    links = [(g, u, u + f(u)) for g, f in step.items() for u in range(2000) if u + f(u) < 2000]
    want = set()
    for g, f in step.items():
        u = 0
        while u < 2000:
            want.add((g, u))
            u += f(u)
    df = spark.createDataFrame(links, "_list string, _u long, next long")
    first = spark.createDataFrame([(g, 0) for g in step], "_list string, _u long")
    got = budget._followed(df, first, 64).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert sizes[0] < len(links) / 2  # c and d alone leave their stretches often

    sizes.clear()
    budget._followed(df.where("_list in ('a', 'b')"), first.where("_list in ('a', 'b')"), 64)
    assert sizes[0] <= 2 * 6 * (2000 // 64 + 1)
