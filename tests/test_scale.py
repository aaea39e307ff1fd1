"""Results on odd tables, and on larger ones the work that a result costs."""

import duckdb
import pytest
from pyspark.sql import functions as F

from meshframe.operators import adjacency as adj
from meshframe.operators import graph as gr
from meshframe.plans import batches, catalogue, edits, parted  # noqa: F401


@pytest.fixture()
def orders(spark, tmp_path):
    """A folder with loops of parts: order 0 has 5 of them, order 1 has 4, order 2 has 3."""
    rows = [(o, k, 10 * o + k) for o, n in enumerate((5, 4, 3)) for k in range(n)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(40).select(F.col("id").alias("p_partkey"), F.lit(1000.0).alias("p_retailprice")).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    got = catalogue.QUERIES[name](spark, folder)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({catalogue.SQL[name]})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_split_of_loop_zero(spark, orders):
    same_as_sql(spark, orders, "face_split_along_edge")


@pytest.mark.parametrize("name", ["common_face", "edges_common_face"])
def test_common_face(spark, orders, name):
    same_as_sql(spark, orders, name)


@pytest.mark.parametrize("name", ["check_rings", "check_topo", "same_edges", "fan_split", "edge_directions", "face_remove_edge"])
def test_loops_are_worked_out_once(spark, orders, name, monkeypatch):
    """Each of the 12 rows of the loops passes the function once, and the result is that of the SQL."""
    from meshframe.plans import adapters

    seen, made = spark.sparkContext.accumulator(0), adapters.loop_fv

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    monkeypatch.setattr(adapters, "loop_fv", lambda s, d: made(s, d).mapInPandas(count, "fid long, pos int, vid long"))
    same_as_sql(spark, orders, name)
    assert seen.value == 12


def test_rings(spark):
    """A tetrahedron, open beside a face turned over and an edge with equal ends, which counts twice at its vertex."""
    from meshframe.frame import MeshFrame
    from meshframe.operators import classify as cls

    points = [(float(k), float(k * k), float(k % 3)) for k in range(8)]
    for faces in ([[1, 2, 3], [1, 4, 2], [2, 4, 3], [1, 3, 4]], [[1, 2, 3], [1, 4, 2], [2, 4, 3], [1, 4, 3]], [[1, 2, 3], [1, 4, 2], [2, 4, 3]], [[1, 2, 3, 3], [5, 6, 7]]):
        use = {}
        for loop in faces:
            for x, y in zip(loop, loop[1:] + loop[:1]):
                use.setdefault((min(x, y), max(x, y)), []).append(1 if x <= y else -1)
        around = {v: [(len(d) * (1 + (e[0] == e[1])), sum(d)) for e, d in use.items() if v in e] for v in range(1, 9)}
        want = (sum(not a for a in around.values()), sum(any(k != 2 for k, _ in a) for a in around.values()), sum(any(k == 2 and d for k, d in a) for a in around.values()))
        m = MeshFrame.from_lists(spark, points, faces=faces)
        m = m.with_tables(V=m.V.withColumns({"gdim": F.lit(2), "gent": F.lit(1).cast("long")}))
        got = {r["rule"]: r["violations"] for r in cls.check(m, list(cls.RINGS)).collect()}
        assert tuple(got[r] for r in cls.RINGS) == want


def test_containing(spark):
    """Groups of one, two and more members, in keys of few and of many members."""
    keys = {1: {1, 2, 3}, 2: {2, 3, 4, 5}, 3: set(range(200)), 4: {7}, 5: {1, 3, 5, 7}}
    groups = {10: {3}, 11: {2, 3}, 12: {1, 3, 5}, 13: {2, 199}, 14: set(range(100)), 15: {1, 2, 3, 4}, 16: {-1, 2}, 17: {2, 4, 5}}
    inc = spark.createDataFrame([(k, m) for k, ms in keys.items() for m in ms] + [(1, 1)], "key long, m long")
    asked = spark.createDataFrame([(g, m) for g, ms in groups.items() for m in ms] + [(11, 2)], "grp long, m long")
    got = [tuple(r) for r in adj.containing(inc, "key", "m", asked).collect()]
    assert sorted(got) == sorted((g, k) for g, a in groups.items() for k, b in keys.items() if a <= b)


def test_containing_meets_pairs(spark):
    """A member that all keys and groups have: rows that meet in vain would be its keys times its groups (here 9 million)."""
    keys = spark.range(3000).select("id", F.explode(F.array(F.lit(0), F.col("id") + 1)).alias("m"))
    out = adj.containing(keys, "id", "m", keys.withColumnRenamed("id", "grp"))
    assert out.count() == 3000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lo#" in plan.split("Join")[1] and "hi#" in plan.split("Join")[1]


def test_levels(spark):
    """A long strip, two components, a loop edge, a node without edges and random graphs, in blocks of few edges."""
    import random
    from collections import deque

    rnd = random.Random(3)
    strip = [(k, k + 1) for k in range(20_000)]
    cases = [(strip, [0], 4096), (strip, [7, 15_000], 8192), ([(1, 2), (2, 3), (3, 3), (10, 11)], [1, 99], 1 << 20)]
    cases.append(([(rnd.randrange(30_000), rnd.randrange(30_000)) for _ in range(40_000)], [5, 6], 20_000))
    for pairs, start, size in cases:
        near = {}
        for a, b in pairs:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        want, todo = dict.fromkeys(start, 0), deque(start)
        while todo:
            a = todo.popleft()
            for b in near.get(a, []):
                if b not in want:
                    want[b] = want[a] + 1
                    todo.append(b)
        e = spark.createDataFrame([(a, b) for a in near for b in near[a]], "src long, dst long")
        got = gr.levels(e, spark.createDataFrame([(s,) for s in start], "node long"), max_rounds=50, size=size)
        assert {r["node"]: r["level"] for r in got.collect()} == want
        assert got.count() == len(want)


def few_rounds(monkeypatch):
    """Levels of a strip of 3,000 nodes in fewer rounds than it has levels."""
    whole = gr.levels
    monkeypatch.setattr(gr, "levels", lambda edges, start: whole(edges, start, max_rounds=20))
    return [(k, k + 1) for k in range(1, 3000)]


def test_renumber_by_levels_rounds(spark, monkeypatch):
    pairs = few_rounds(monkeypatch)
    e = spark.createDataFrame([p for a, b in pairs for p in ((a, b), (b, a))], "src long, dst long")
    got = gr.renumber_by_levels(spark.range(1, 3001).toDF("node"), e, spark.createDataFrame([(1,)], "node long"))
    assert sorted((r["node"], r["new_id"]) for r in got.collect()) == [(k, k) for k in range(1, 3001)]


def test_renumber_profile_rounds(spark, monkeypatch):
    pairs = few_rounds(monkeypatch)
    e = spark.createDataFrame([p for a, b in pairs for p in ((a, b), (b, a))], "src long, dst long")
    got = sorted((r["node"], r["new_id"]) for r in gr.renumber_profile(spark.range(1, 3001).toDF("node"), e).collect())
    assert [n for n, _ in got] == sorted(i for _, i in got) == list(range(1, 3001))
    assert all(abs(a - b) == 1 for (_, a), (_, b) in zip(got, got[1:]))


def test_components_read_edges_once(spark):
    """The rounds take edges as they were worked out first: each of the 400 edges passes the function once."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    pairs = [(k, k + 1) for k in range(200)]
    e = spark.createDataFrame([p for a, b in pairs for p in ((a, b), (b, a))], "src long, dst long").mapInPandas(count, "src long, dst long")
    got = gr.components(spark.range(201).toDF("node"), e)
    assert {r["component"] for r in got.collect()} == {0}
    assert seen.value == 400


@pytest.mark.parametrize("renumber", ["levels", "profile"])
def test_renumbering_reads_edges_once(spark, renumber):
    """Each of the 400 edges passes the function once."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    pairs = [(k, k + 1) for k in range(200)]
    e = spark.createDataFrame([p for a, b in pairs for p in ((a, b), (b, a))], "src long, dst long").mapInPandas(count, "src long, dst long")
    nodes = spark.range(201).toDF("node")
    got = gr.renumber_profile(nodes, e) if renumber == "profile" else gr.renumber_by_levels(nodes, e, spark.createDataFrame([(0,)], "node long"))
    assert sorted(r["new_id"] for r in got.collect()) == list(range(1, 202))
    assert seen.value == 400


def test_files_are_parsed_once(spark, tmp_path):
    """All tables of a mesh come from one parsing of its file."""
    from meshframe.frame import MeshFrame
    from meshframe.sources import formats, native, records

    m = MeshFrame.from_lists(spark, [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)], faces=[[1, 2, 3, 4]])
    formats.write(m, f"{tmp_path}/quad")
    files = spark.sparkContext.accumulator(0)

    def parse(text):
        files.add(1)
        yield from native.parse(text)

    back = records.to_mesh(records.read(spark, f"{tmp_path}/quad", parse), spark)
    assert [back.V.count(), back.E.count(), back.F.count(), back.FE.count(), back.FV.count()] == [4, 4, 1, 4, 4]
    assert files.value == 1


def test_words_take_no_list():
    """Parsing takes little memory beside the text (a list of words takes about ten times as much)."""
    import tracemalloc

    from meshframe.sources import foreign, native

    n = 40_000
    text = f"NATIVE 1.0\nF1 {n} 0 0 0\nvertices\n" + "1.5 2.5 3.5 2 1\n" * n
    gmv = f"gmvinput ascii\nnodev {n}\n" + "1.5 2.5 3.5\n" * n + f"cells {n}\n" + "quad 4 1001 1002 1003 1004\n" * n + "material 1 0\nm\n" + "1\n" * n + "endgmv\n"
    for parse, words, rows in ((native.parse, text, n), (foreign.parse_gmv, gmv, 6 * n)):
        tracemalloc.start()
        assert sum(1 for _ in parse(words)) == rows
        assert tracemalloc.get_traced_memory()[1] < 3 * len(words)
        tracemalloc.stop()


def _broadcasts(tables):
    return [n for n, t in tables.items() if "BroadcastHashJoin" in t._jdf.queryExecution().toString()]


def test_cut_cells_are_joined_by_shuffles(spark):
    """No table that grows with the mesh is sent through the driver, however small its files are."""
    from meshframe.operators import generate, simplex

    m = generate.structured3d(spark, 2, 1, 1).settled("V", "E", "F", "FE", "FV", "R", "RF", "RV")
    out, _ = simplex.split_regions(m, m.RF.where("pos = 0").join(m.FE.select("fid", "eid"), "fid").select("rid", "pos", "eid"))
    assert not _broadcasts({n: out.tables[n] for n in ("F", "FE", "FV", "R", "RF", "RV")})


def test_x3d_is_read_line_by_line(spark, tmp_path):
    """No Python task has the whole text, and pieces of a file have the ids and directions that their order says."""
    from meshframe.operators import generate
    from meshframe.sources import foreign, formats

    formats.write(generate.structured3d(spark, 3, 2, 2), f"file://{tmp_path}/box.x3d")
    back = foreign.read_x3d(spark, f"file://{tmp_path}/box.x3d")
    plan = back.RF._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan and not hasattr(foreign, "parse_x3d")
    text = "".join(f.read_text() for f in sorted((tmp_path / "box.x3d").glob("part-*")))
    lines = [x.split() for x in text.splitlines()]
    at = {x[0]: i for i, x in enumerate(lines) if len(x) == 1}
    seen, use = {}, {}
    for x in lines[at["faces"] + 1 : at["end_faces"]]:
        loop = x[2 : 2 + int(x[1])]
        fid, first = seen.setdefault(tuple(sorted(loop)), (len(seen) + 1, loop))
        use[x[0]] = fid, int(first[(first.index(loop[0]) + 1) % len(loop)] == loop[1])
    want = sorted((int(x[0]), pos, *use[i]) for x in lines[at["cells"] + 1 : at["end_cells"]] for pos, i in enumerate(x[2 : 2 + int(x[1])]))
    assert sorted(map(tuple, back.RF.select("rid", "pos", "fid", "dir").collect())) == want
    assert sorted(map(tuple, back.FV.collect())) == sorted((fid, pos, int(x)) for fid, loop in seen.values() for pos, x in enumerate(loop))
    (tmp_path / "short.x3d").write_text(text.replace("end_nodes", "").replace("\nfaces\n", "\n\nfaces \n"))
    assert foreign.read_x3d(spark, f"file://{tmp_path}/short.x3d").V.count() == back.V.count() == 48 - 12
