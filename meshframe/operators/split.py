"""Splits of edges, faces and simplices that keep every table of a bundle, surface or solid.

What is split goes, and its pieces are new entities, whose ids follow the largest; they are classified like what they are
pieces of. Only rows at what is split are worked out; all others pass as they are, and nothing is derived again. Cells
that are no longer standard ones become polyhedra, with their vertices in the order of ids. Attribute values, set members
and global ids of what goes are dropped; ``inherit`` hands values and memberships on to the pieces.

Every operator also returns ``born``: ``dim, old, new, k``, the k-th piece (from 0) ``new`` of ``old``. Requests for entities
that aren't there do nothing; repeated ones count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import MeshFrame, number
from ..schema import KIND
from ..working import settled, shared_dir
from .batch import ROUNDS, firsts

BORN = "dim int, old long, new long, k int"


def _tops(m: MeshFrame) -> dict[str, int]:
    """The largest id of each kind (0 for none), by key."""
    row = None
    for name, key in KIND.values():
        one = m.tables[name].agg(F.coalesce(F.max(key), F.lit(0)).alias(key))
        row = one if row is None else row.crossJoin(one)  # one row each
    return row.first().asDict()


def _forget(m: MeshFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """Tables of values, sets and global ids without ``gone`` (``dim``, ``id``)."""
    return {t: m.tables[t].join(gone, ["dim", "id"], "left_anti").select(*m.tables[t].columns) for t in ("AV", "SM", "G")}


def _dense(df: DataFrame, key: str, *order: str, rest: list[str]) -> DataFrame:
    return df.select(key, (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).alias("pos"), *rest)


def _more_corners(m: MeshFrame, new: DataFrame) -> dict[str, DataFrame]:
    """``R`` and ``RV`` with the vertices ``new`` (``rid``, ``vid``) on cells, which become polyhedra."""
    hit = new.select("rid").distinct()
    corners = m.RV.join(hit, "rid", "left_semi").select("rid", "vid").union(new.select("rid", "vid")).distinct()
    poly = m.R.join(hit, "rid", "left_semi").withColumn("rtype", F.lit("POLYHEDRON"))
    return {
        "R": m.R.join(hit, "rid", "left_anti").unionByName(poly),
        "RV": m.RV.join(hit, "rid", "left_anti").select("rid", "pos", "vid").unionByName(_dense(corners, "rid", "vid", rest=["vid"])),
    }


def split_edges(m: MeshFrame, edges: DataFrame, points: DataFrame | None = None) -> tuple[MeshFrame, DataFrame]:
    """The bundle with ``n`` new vertices on each edge of ``edges`` (``eid``, ``n``; of several rows the largest ``n``, those
    under 1 do nothing), and ``born``. The vertices are equispaced, or where ``points`` (``eid, k, x, y, z``; k from 1) says.

    Vertices are numbered in the order of (edge, place), pieces likewise, and these run as the edge did. Faces keep
    their ids and the beginnings of their loops."""
    shared_dir(m.V.sparkSession)
    top = _tops(m)
    asked = edges.groupBy("eid").agg(F.max("n").cast("int").alias("n")).where("n > 0")
    cut = m.E.join(asked, "eid").select("eid", "v0", "v1", "gdim", "gent", "n").transform(settled)
    each = cut.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    vid = number(each.where("k > 0").select("eid", "k"), "r", "eid", "k").select("eid", "k", (F.lit(top["vid"]) + F.col("r")).alias("vid")).transform(settled)
    after = vid.select("eid", (F.col("k") - 1).alias("k"), F.col("vid").alias("next"))
    piece = number(each, "r", "eid", "k").withColumn("new", F.lit(top["eid"]) + F.col("r")).join(vid, ["eid", "k"], "left").join(after, ["eid", "k"], "left")
    piece = piece.select("eid", "n", "k", "new", F.coalesce("vid", "v0").alias("v0"), F.coalesce("next", "v1").alias("v1"), "gdim", "gent").transform(settled)
    a, b = (m.V.select(F.col("vid").alias(f"v{i}"), *[F.col(c).alias(f"{c}{i}") for c in "xyz"]) for i in (0, 1))
    t = F.col("k") / (F.col("n") + 1)
    place = cut.join(a, "v0").join(b, "v1").join(vid, "eid").select("eid", "k", "vid", *[(F.col(f"{c}0") + t * (F.col(f"{c}1") - F.col(f"{c}0"))).alias(c) for c in "xyz"], "gdim", "gent")
    if points is not None:
        given = points.select("eid", "k", *[F.col(c).alias(f"to_{c}") for c in "xyz"])
        place = place.join(given, ["eid", "k"], "left").withColumns({c: F.coalesce(f"to_{c}", c) for c in "xyz"})
    use = m.FE.join(cut.select("eid", "n"), "eid").select("fid", "pos", "eid", "dir", "n").transform(settled)
    hit = use.select("fid").distinct().transform(settled)
    # in the order in which the loop meets them
    turned = lambda n: F.when(F.col("dir") == 1, F.col("k")).otherwise(n - F.col("k"))
    whole = m.FE.join(hit, "fid", "left_semi").join(cut.select("eid"), "eid", "left_anti").select("fid", "pos", F.lit(0).alias("s"), "eid", "dir")
    parts = use.drop("n").join(piece.select("eid", "n", "k", "new"), "eid").select("fid", "pos", turned(F.col("n")).alias("s"), F.col("new").alias("eid"), "dir")
    inner = use.join(vid, "eid").select("fid", "pos", turned(F.col("n") + 1).alias("s"), "vid")
    corners = m.FV.join(hit, "fid", "left_semi").select("fid", "pos", F.lit(0).alias("s"), "vid").union(inner)
    more = use.groupBy("fid").agg(F.sum("n").cast("int").alias("more"))
    on = m.RF.join(use.join(vid, "eid").select("fid", "vid"), "fid").select("rid", "vid").distinct().transform(settled)
    born = piece.select(F.lit(1).alias("dim"), F.col("eid").alias("old"), "new", F.col("k").cast("int").alias("k"))
    ends = piece.select(F.col("new").alias("eid"), "v0", "v1", F.least("v0", "v1").alias("lo"), F.greatest("v0", "v1").alias("hi"), "gdim", "gent")
    out = m.with_tables(
        V=m.V.unionByName(place.select(*m.V.columns)),
        E=m.E.join(cut.select("eid"), "eid", "left_anti").unionByName(ends.select(*m.E.columns)),
        F=m.F.join(more, "fid", "left").select("fid", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), "gdim", "gent"),
        FE=m.FE.join(hit, "fid", "left_anti").select("fid", "pos", "eid", "dir").unionByName(_dense(whole.union(parts), "fid", "pos", "s", rest=["eid", "dir"])),
        FV=m.FV.join(hit, "fid", "left_anti").select("fid", "pos", "vid").unionByName(_dense(corners, "fid", "pos", "s", rest=["vid"])),
        **_more_corners(m, on),
        **_forget(m, cut.select(F.lit(1).alias("dim"), F.col("eid").alias("id"))),
    )
    return out, born


def split_faces(m: MeshFrame, faces: DataFrame, points: DataFrame | None = None) -> tuple[MeshFrame, DataFrame]:
    """The bundle with each face of ``faces`` (``fid``) cut into triangles around a new vertex at the mean of its own, or where
    ``points`` (``fid, x, y, z``) says, and ``born``.

    Triangles are numbered in the order of (face, side); one begins at the new vertex and goes on along its side. Cells
    use them as they used the face, at its place. New edges run from the face's vertices to the new one."""
    shared_dir(m.V.sparkSession)
    top = _tops(m)
    cut = m.F.join(faces.select("fid").distinct(), "fid").select("fid", "n", "gdim", "gent")
    cut = number(cut, "r", "fid").select("fid", "n", "gdim", "gent", (F.lit(top["vid"]) + F.col("r")).alias("mid")).transform(settled)
    loop = m.FV.join(cut, "fid").select("fid", "pos", "vid", "n", "mid", "gdim", "gent")
    sides = number(loop, "r", "fid", "pos").withColumns({"spoke": F.lit(top["eid"]) + F.col("r"), "new": F.lit(top["fid"]) + F.col("r")}).transform(settled)
    mean = sides.select("fid", "vid").join(m.V.select("vid", *"xyz"), "vid").groupBy("fid").agg(*[F.avg(c).alias(c) for c in "xyz"])
    if points is not None:
        given = points.select("fid", *[F.col(c).alias(f"to_{c}") for c in "xyz"])
        mean = mean.join(given, "fid", "left").select("fid", *[F.coalesce(f"to_{c}", c).alias(c) for c in "xyz"])
    v = mean.join(cut, "fid").select(F.col("mid").alias("vid"), *"xyz", "gdim", "gent")
    ahead = sides.select("fid", F.pmod(F.col("pos") - 1, F.col("n")).cast("int").alias("pos"), F.col("vid").alias("next"), F.col("spoke").alias("back"))
    full = sides.join(ahead, ["fid", "pos"]).join(m.FE.select("fid", "pos", "eid", "dir"), ["fid", "pos"]).transform(settled)
    use = F.array(*[F.struct(e.alias("eid"), d.cast("int").alias("dir")) for e, d in ((F.col("spoke"), F.lit(0)), (F.col("eid"), F.col("dir")), (F.col("back"), F.lit(1)))])
    fe = full.select(F.col("new").alias("fid"), F.posexplode(use).alias("pos", "u")).select("fid", "pos", "u.eid", "u.dir")
    fv = full.select(F.col("new").alias("fid"), F.posexplode(F.array("mid", "vid", "next")).alias("pos", "vid"))
    gone = cut.select("fid")
    cells = m.RF.join(gone, "fid", "left_semi").select("rid").distinct().transform(settled)
    near = m.RF.join(cells, "rid", "left_semi")
    kept = near.join(gone, "fid", "left_anti").select("rid", "pos", F.lit(0).alias("s"), "fid", "dir")
    put = near.select("rid", F.col("pos").alias("at"), "fid", "dir").join(sides.select("fid", "pos", "new"), "fid").select("rid", F.col("at").alias("pos"), F.col("pos").alias("s"), F.col("new").alias("fid"), "dir")
    on = m.RF.join(cut.select("fid", "mid"), "fid").select("rid", F.col("mid").alias("vid")).transform(settled)
    born = sides.select(F.lit(2).alias("dim"), F.col("fid").alias("old"), "new", F.col("pos").cast("int").alias("k"))
    e = sides.select(F.col("spoke").alias("eid"), F.col("vid").alias("v0"), F.col("mid").alias("v1"), F.least("vid", "mid").alias("lo"), F.greatest("vid", "mid").alias("hi"), "gdim", "gent")
    out = m.with_tables(
        V=m.V.unionByName(v.select(*m.V.columns)),
        E=m.E.unionByName(e.select(*m.E.columns)),
        F=m.F.join(gone, "fid", "left_anti").select("fid", "n", "gdim", "gent").unionByName(sides.select(F.col("new").alias("fid"), F.lit(3).alias("n"), "gdim", "gent")),
        FE=m.FE.join(gone, "fid", "left_anti").select("fid", "pos", "eid", "dir").unionByName(fe),
        FV=m.FV.join(gone, "fid", "left_anti").select("fid", "pos", "vid").unionByName(fv),
        RF=m.RF.join(cells, "rid", "left_anti").select("rid", "pos", "fid", "dir").unionByName(_dense(kept.union(put), "rid", "pos", "s", rest=["fid", "dir"])),
        **_more_corners(m, on),
        **_forget(m, gone.select(F.lit(2).alias("dim"), F.col("fid").alias("id"))),
    )
    return out, born


def bisect_simplices(m: MeshFrame, edges: DataFrame) -> tuple[MeshFrame, DataFrame, DataFrame]:
    """A bundle of triangles or tetrahedra with the edges (``eid``) cut in the middle and every face and cell at them in two,
    ``born``, and what became of every request: ``eid, round, outcome``.

    Requests may share faces and cells; these are made in rounds, later ones on what earlier ones left. Pieces are
    numbered round by round in the order of what they are pieces of, the one at the edge's first end first, and keep the
    orders of their vertices and sides. A new edge runs from a face's third vertex to the new one; the new face in a cell
    takes the place of the side that the other piece has. Refused: an edge that isn't there (``no edge``), or at which
    there is a face that isn't a triangle or a cell that isn't a tetrahedron (``no simplices``)."""
    spark = m.V.sparkSession
    shared_dir(spark)
    solid = not m.R.isEmpty()
    asked = edges.select("eid").distinct().join(m.E.select("eid", F.lit(True).alias("there")), "eid", "left").transform(settled)
    at = m.FE.join(asked.select("eid"), "eid", "left_semi").select("eid", "fid").transform(settled)
    cells = m.RF.join(at, "fid").select("eid", "rid").distinct().transform(settled)
    odd = at.join(m.F.where("n <> 3"), "fid", "left_semi").select("eid").union(cells.join(m.R.where("rtype <> 'TET'"), "rid", "left_semi").select("eid")).distinct().withColumn("odd", F.lit(True))
    judged = asked.join(odd, "eid", "left").withColumn("outcome", F.when(F.col("there").isNull(), "no edge").when(F.col("odd"), "no simplices")).transform(settled)
    log = judged.where("outcome is not null").select("eid", F.lit(0).alias("round"), "outcome")
    # until its turn comes nothing changes an edge; so its middle is known at once
    end = lambda c, i: m.V.select(F.col("vid").alias(c), *[F.col(x).alias(f"{x}{i}") for x in "xyz"])
    known = judged.where("outcome is null").select("eid").join(m.E.select("eid", F.col("v0").alias("a"), F.col("v1").alias("b"), "gdim", "gent"), "eid").join(end("a", 0), "a").join(end("b", 1), "b")
    pending = known.select("eid", "a", "b", "gdim", "gent", *[((F.col(f"{x}0") + F.col(f"{x}1")) / 2).alias(x) for x in "xyz"]).transform(settled)
    # faces and cells that any request can reach: those at the edges and, for their sides, those of these cells
    rids = cells.select("rid").distinct().transform(settled)
    fids = m.RF.join(rids, "rid", "left_semi").select("fid").union(at.select("fid")).distinct().transform(settled)
    keys = {"F": fids, "FE": fids, "FV": fids, "R": rids, "RF": rids, "RV": rids}
    far = {t: m.tables[t].join(k, k.columns[0], "left_anti").select(*m.tables[t].columns) for t, k in keys.items()}
    near = {t: m.tables[t].join(k, k.columns[0], "left_semi").select(*m.tables[t].columns).transform(settled) for t, k in keys.items()}
    new_v, new_e, top = m.V.where("false"), m.E.where("false"), _tops(m)
    born = spark.createDataFrame([], BORN)
    for turn_no in range(1, ROUNDS):
        if pending.isEmpty():
            dead = born.select("dim", F.col("old").alias("id")).distinct()
            tables = {t: far[t].unionByName(near[t]) for t in keys}
            # a piece that was cut in a later round is no entity any more
            ends = m.E.join(log.where("outcome = 'split'"), "eid", "left_anti").unionByName(new_e)
            return m.with_tables(V=m.V.unionByName(new_v), E=ends.select(*m.E.columns), **tables, **_forget(m, dead)), born, log
        hit = near["FE"].join(pending, "eid", "left_semi").select("eid", "fid", "pos", "dir").transform(settled)
        in_cell = near["RF"].join(hit.select("eid", "fid"), "fid").select("eid", "rid", F.col("pos").alias("at"), "fid", F.col("dir").alias("out")).transform(settled)
        item = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("id")).alias("item")
        touched = hit.select("eid", item(2, "fid")).union(in_cell.select("eid", item(3, "rid")))
        turn = firsts(pending, touched).join(pending, "eid")
        turn = number(turn, "r", "eid").select("eid", "a", "b", "gdim", "gent", *"xyz", (F.lit(top["vid"]) + F.col("r")).alias("m"), (F.lit(top["eid"] - 1) + 2 * F.col("r")).alias("ea"), (F.lit(top["eid"]) + 2 * F.col("r")).alias("eb")).transform(settled)
        n_edges = turn.count()
        points = turn.select(F.col("m").alias("vid"), *"xyz", "gdim", "gent")
        # triangles: where the edge stands, the third vertex, and the ids of the halves
        third = near["FV"].select("fid", F.pmod(F.col("pos") - 2, F.lit(3)).cast("int").alias("pos"), F.col("vid").alias("c"))
        tri = hit.join(turn.select("eid", "a", "b", "m", "ea", "eb"), "eid").join(third, ["fid", "pos"]).join(near["F"].select("fid", "gdim", "gent"), "fid")
        base = top["eid"] + 2 * n_edges
        tri = number(tri, "r", "fid").withColumns({"spoke": F.lit(base) + F.col("r"), "fa": F.lit(top["fid"] - 1) + 2 * F.col("r"), "fb": F.lit(top["fid"]) + 2 * F.col("r")}).transform(settled)
        n_faces = tri.count()
        old = near["FE"].select("fid", F.col("pos").alias("p"), F.col("eid").alias("side"), F.col("dir").alias("sdir")).join(tri, "fid").withColumn("k", F.pmod(F.col("p") - F.col("pos"), F.lit(3)))
        # sides follow the split one: the next one is at b where the loop runs from a to b, the one after at a
        at_b = F.when(F.col("dir") == 1, F.col("k") == 1).otherwise(F.col("k") == 2)
        use = lambda f_, e_, d_: F.struct(F.col(f_).alias("fid"), F.col(e_).alias("eid"), d_.cast("int").alias("dir"))
        along, as_was = F.col("dir"), F.col("sdir")
        halves = F.array(use("fa", "ea", along), use("fb", "eb", along))
        behind = F.array(use("fb", "side", as_was), use("fa", "spoke", 1 - along))
        before = F.array(use("fa", "side", as_was), use("fb", "spoke", along))
        uses = F.when(F.col("k") == 0, halves).when(at_b, behind).otherwise(before)
        fe = old.select(F.explode(uses).alias("u"), "p").select("u.fid", F.col("p").alias("pos"), "u.eid", "u.dir")
        corner = near["FV"].select("fid", F.col("pos").alias("p"), "vid").join(tri.drop("pos"), "fid")
        put = lambda keep: F.when(F.col("vid") == F.col(keep), F.col("m")).otherwise(F.col("vid")).alias("vid")
        fv = corner.select(F.col("fa").alias("fid"), F.col("p").alias("pos"), put("b")).union(corner.select("fb", "p", put("a")))
        pieces = turn.select(F.explode(F.array(F.struct(F.col("ea").alias("eid"), F.col("a").alias("v0"), F.col("m").alias("v1")), F.struct(F.col("eb").alias("eid"), F.col("m").alias("v0"), F.col("b").alias("v1")))).alias("u"), "gdim", "gent").select("u.*", "gdim", "gent")
        pieces = pieces.union(tri.select("spoke", "c", "m", "gdim", "gent")).withColumns({"lo": F.least("v0", "v1"), "hi": F.greatest("v0", "v1")})
        f = tri.select(F.explode(F.array("fa", "fb")).alias("fid"), F.lit(3).alias("n"), "gdim", "gent")
        gone_f = tri.select("fid").transform(settled)
        made = [turn.select(F.lit(1).alias("dim"), F.col("eid").alias("old"), F.posexplode(F.array("ea", "eb")).alias("k", "new")), tri.select(F.lit(2).alias("dim"), F.col("fid").alias("old"), F.posexplode(F.array("fa", "fb")).alias("k", "new"))]
        grown = {"vid": n_edges, "eid": 2 * n_edges + n_faces, "fid": 2 * n_faces, "rid": 0}
        if solid:
            own = in_cell.join(turn.select("eid", "a", "b", "m"), "eid").select("rid", "eid", "a", "b", "m").distinct()
            own = number(own, "r", "rid").withColumns({"ra": F.lit(top["rid"] - 1) + 2 * F.col("r"), "rb": F.lit(top["rid"]) + 2 * F.col("r"), "wall": F.lit(top["fid"] + 2 * n_faces) + F.col("r")}).transform(settled)
            n_cells = own.count()
            kind = near["R"].join(own, "rid").select(F.explode(F.array("ra", "rb")).alias("rid"), "rtype", "gdim", "gent")
            spot = near["RV"].join(own, "rid")
            rv = spot.select(F.col("ra").alias("rid"), "pos", put("b")).union(spot.select("rb", "pos", put("a")))
            # of a cell's faces two are cut, one is at a alone and one at b alone
            sides = near["RF"].select("rid", "pos", "fid", "dir").join(own, "rid")
            halves = sides.join(tri.select("fid", "eid", "fa", "fb"), ["fid", "eid"])
            two = halves.select(F.col("ra").alias("rid"), "pos", F.col("fa").alias("fid"), "dir").union(halves.select("rb", "pos", "fb", "dir"))
            rest = sides.join(gone_f, "fid", "left_anti")
            has_a = rest.select("rid", "fid", "a").join(near["FV"].select("fid", F.col("vid").alias("a")), ["fid", "a"], "left_semi").select("rid", "fid", F.lit(True).alias("has_a"))
            rest = rest.join(has_a, ["rid", "fid"], "left").withColumn("has_a", F.coalesce("has_a", F.lit(False))).transform(settled)
            mine = rest.select(F.when(F.col("has_a"), F.col("ra")).otherwise(F.col("rb")).alias("rid"), "pos", "fid", "dir")
            # the wall's loop is that of the face at b with the new vertex instead; so the piece at a uses it as the cell used that face
            model = rest.where("not has_a").select("rid", "pos", "fid", "dir", "b", "m", "wall", "ra", "rb").transform(settled)
            walls = model.select("ra", "pos", "wall", "dir").union(rest.where("has_a").join(model.select("rid", F.col("dir").alias("d")), "rid").select("rb", "pos", "wall", 1 - F.col("d")))
            frame = model.select("fid", "b", "m", "wall", "rid").join(near["FV"].select("fid", "pos", "vid"), "fid")
            wall_fv = frame.select(F.col("wall").alias("fid"), "pos", put("b"))
            follow = near["FV"].select("fid", F.pmod(F.col("pos") - 1, F.lit(3)).cast("int").alias("pos"), F.col("vid").alias("next"))
            spokes = in_cell.select("rid", "eid", "fid").join(tri.select("eid", "fid", "c", "spoke"), ["eid", "fid"]).select("rid", "c", "spoke")
            wall_fe = frame.join(follow, ["fid", "pos"]).join(near["FE"].select("fid", "pos", "eid", "dir"), ["fid", "pos"])
            beside = F.when(F.col("vid") == F.col("b"), F.col("next")).when(F.col("next") == F.col("b"), F.col("vid"))
            wall_fe = wall_fe.withColumn("c", beside).join(spokes, ["rid", "c"], "left")
            wall_fe = wall_fe.select(F.col("wall").alias("fid"), "pos", F.coalesce("spoke", "eid").alias("eid"), F.when(F.col("c").isNull(), F.col("dir")).when(F.col("vid") == F.col("b"), 0).otherwise(1).alias("dir"))
            fe, fv = fe.union(wall_fe), fv.union(wall_fv)
            f = f.union(near["R"].join(own, "rid").select("wall", F.lit(3), "gdim", "gent"))
            out_r = own.select("rid").transform(settled)
            near |= {
                "R": near["R"].join(out_r, "rid", "left_anti").select(*m.R.columns).unionByName(kind.select(*m.R.columns)).transform(settled),
                "RV": near["RV"].join(out_r, "rid", "left_anti").select("rid", "pos", "vid").union(rv).transform(settled),
                "RF": near["RF"].join(out_r, "rid", "left_anti").select("rid", "pos", "fid", "dir").union(two).union(mine).union(walls).transform(settled),
            }
            made.append(own.select(F.lit(3).alias("dim"), F.col("rid").alias("old"), F.posexplode(F.array("ra", "rb")).alias("k", "new")))
            grown |= {"fid": 2 * n_faces + n_cells, "rid": 2 * n_cells}
        near |= {
            "F": near["F"].join(gone_f, "fid", "left_anti").select("fid", "n", "gdim", "gent").union(f).transform(settled),
            "FE": near["FE"].join(gone_f, "fid", "left_anti").select("fid", "pos", "eid", "dir").union(fe).transform(settled),
            "FV": near["FV"].join(gone_f, "fid", "left_anti").select("fid", "pos", "vid").union(fv).transform(settled),
        }
        new_e = new_e.unionByName(pieces.select(*m.E.columns).transform(settled))
        new_v = new_v.unionByName(points.select(*m.V.columns))
        for x in made:
            born = born.unionByName(x.select("dim", "old", "new", F.col("k").cast("int").alias("k")).transform(settled))
        log = log.union(turn.select("eid", F.lit(turn_no).alias("round"), F.lit("split").alias("outcome")))
        pending = pending.join(turn.select("eid"), "eid", "left_anti").transform(settled)
        top = {k: top[k] + grown[k] for k in top}
    raise RuntimeError(f"splits aren't done after {ROUNDS} rounds")


def inherit(before: MeshFrame, after: MeshFrame, born: DataFrame) -> MeshFrame:
    """``after`` with the attribute values of what was split on all its pieces, and the pieces in its sets at its place, in
    order. Pieces that were split again hand on to theirs. Positions of sets with such members are made dense."""
    shared_dir(after.V.sparkSession)
    line = born.select("dim", "old", "new", F.format_string("%06d", "k").alias("path")).transform(settled)
    step = line.select("dim", F.col("old").alias("new"), F.col("new").alias("on"), F.col("path").alias("more"))
    for _ in range(ROUNDS):
        further = line.join(step, ["dim", "new"], "left")
        if further.where("on is not null").isEmpty():
            break
        line = further.select("dim", "old", F.coalesce("on", "new").alias("new"), F.concat("path", F.coalesce("more", F.lit(""))).alias("path")).transform(settled)
    else:
        raise RuntimeError(f"pieces were split over {ROUNDS} times")
    heirs = line.select("dim", F.col("old").alias("id"), "new", "path")
    cols = before.AV.columns
    av = before.AV.join(heirs, ["dim", "id"]).withColumn("id", F.col("new")).select(*cols)
    put = before.SM.join(heirs, ["dim", "id"]).select("set", "pos", "dim", F.col("new").alias("id"), "path")
    hit = put.select("set").distinct()
    rest = after.SM.join(hit, "set", "left_anti").select("set", "pos", "dim", "id")
    mixed = after.SM.join(hit, "set", "left_semi").select("set", "pos", "dim", "id", F.lit("").alias("path")).union(put)
    ranked = number(mixed, "r", "pos", "path", "dim", "id", group="set")
    low = ranked.groupBy("set").agg(F.min("r").alias("low"))
    placed = ranked.join(low, "set").select("set", (F.col("r") - F.col("low")).cast("int").alias("pos"), "dim", "id")
    return after.with_tables(AV=after.AV.select(*cols).union(av), SM=rest.union(placed))
