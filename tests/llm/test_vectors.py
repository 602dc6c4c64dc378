import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewake.llm import embed, graph

SCHEMA = "vec_id long, embedding array<float>, label int, rep long"


def brute(rows, threshold):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    links = {}
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, x) in enumerate(good):
        links.setdefault(k, 0)
        for m, (j, y) in enumerate(good[:k]):
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[k] += 1
                links[m] += 1
                if i is not None and j is not None:
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return sorted([(i, links[k], None if i is None else find(i)) for k, (i, _) in enumerate(good)] + [(i, 0, i) for i, v in rows if not (v and None not in v and np.isfinite(v).all() and any(v))], key=repr)


def test_near_duplicates(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(60):
        base = rng.normal(size=24)
        for _ in range(rng.integers(1, 6)):
            rows.append((len(rows), [float(np.float32(x)) for x in base + rng.normal(size=24) * rng.choice([0, 0.1, 0.22, 0.3])]))
    rows += [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [None] + [1.0] * 23), (5004, [float("nan")] * 24), (5005, [float("inf")] + [0.0] * 23), (5006, [1.0, 0.0]), (5007, [2.0, 0.1]), (-1, rows[3][1])]
    frame = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], SCHEMA).repartition(4)
    for tile in (4096, 17):
        out = embed.near_duplicates(frame, 0.95, tile).collect()
        assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=repr) == brute(rows, 0.95)
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)
    assert embed.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    doubles = frame.selectExpr("vec_id", "cast(embedding as array<double>) as embedding")
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embed.near_duplicates(doubles).collect()), key=repr) == brute(rows, 0.95)


def test_cells_spare_tiles_and_no_link(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 16)) * 4
    rows = [(k, [float(np.float32(x)) for x in centres[k % 6] + rng.normal(size=16) * rng.choice([0.1, 0.6])], 0, 1) for k in range(360)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    expected = brute([(i, v) for i, v, _, _ in rows], 0.95)
    vec = [np.array(v, "<f4").tobytes() for _, v, _, _ in rows]
    classes = spark.createDataFrame([(v, 1, i, v, 16) for i, v in enumerate(vec)], "fp binary, n long, rep long, vec binary, dim int")
    cells, dealt = embed.find_cells(classes, {16: 18}, "<f4", 256)
    met = cells.may_meet(16, 0.95)
    own = {r["rep"]: r["cell"] for r in dealt.collect()}
    unit = embed._units(vec, "<f4")
    p, q = np.nonzero(unit @ unit.T >= 0.95)
    assert all(met[own[a], own[b]] for a, b in zip(p.tolist(), q.tolist(), strict=True)) and cells.spared(16, 0.95) > 0.5
    out = embed.near_duplicates(frame, 0.95, 20).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=repr) == expected


def test_bounds_hold():
    rng = np.random.default_rng(1)
    raw = rng.normal(size=(300, 40)) * np.exp(rng.normal(size=(300, 1)) * 5)
    raw[:, 0] *= rng.choice([1, 30], 300)
    tile = embed._Tile([v.astype("<f8").tobytes() for v in raw])
    exact = tile.unit @ tile.unit.T
    near = (tile.codes.astype(float) @ tile.codes.T.astype(float)) * tile.scale[:, None] * tile.scale[None, :]
    assert (np.abs(near - exact) <= tile.error[:, None] + tile.error[None, :] * (1 + tile.error[:, None])).all()
    for threshold in (0.1, 0.5, 0.9):
        found = np.concatenate([m for _, m in embed.linked(tile, tile, threshold)])
        assert (found == (exact >= threshold))[np.abs(exact - threshold) > 1e-12].all()


def _disk_files(spark):
    return {f.getPath(): f.length() for f in _items(spark, spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())}


def _items(spark, seq):
    return [seq.apply(k) for k in range(seq.size())]


def test_shuffles_grow_with_vectors_not_with_tiles(spark):
    rng = np.random.default_rng(11)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=64)], 0, 1) for k in range(1200)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4).localCheckpoint()
    before = _disk_files(spark)
    assert embed.near_duplicates(frame, 0.95, 20).count() == 1200  # 60 tiles
    written = sum(n for path, n in _disk_files(spark).items() if path not in before)
    assert written < 4 * 1200 * 64 * 4, written


def test_projections_miss_no_link(spark):
    rng = np.random.default_rng(12)
    centre = rng.normal(size=64) * 3
    # Loose vectors, a dense cluster with links among most, and a common direction that brings all cosines near to the threshold.
    base = [rng.normal(size=64) for _ in range(120)] + [centre + rng.normal(size=64) * s for s in (0.2, 0.7) for _ in range(60)]
    vectors = [v + rng.normal(size=64) * s for v in base for s in (0, 0.2)]
    rows = [(k, [float(np.float32(x)) for x in v], 0, 1) for k, v in enumerate(vectors)]
    tile = embed._Tile([np.array(v, "<f4").tobytes() for _, v, _, _ in rows], "<f4")
    exact = tile.unit @ tile.unit.T
    assert tile.low.shape[1] < 32 and (tile.low.astype(float) @ tile.low.T.astype(float) >= exact - 1e-6).all()
    for threshold in (0.5, 0.8, 0.95):
        found = np.concatenate([m for _, m in embed.linked(tile, tile, threshold, 32)])
        assert (found == (exact >= threshold))[np.abs(exact - threshold) > 1e-12].all()
    out = embed.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), 0.95, 50).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=repr) == brute([(i, v) for i, v, _, _ in rows], 0.95)


def test_rows_without_id_link_but_lead_nowhere(spark):
    turn = lambda a: [float(np.cos(a)), float(np.sin(a))]
    # 1 and 2 meet only through the row without id; 3 and 4 link, and both with one that comes first by any order of theirs.
    rows = [(1, turn(0.0)), (None, turn(0.3)), (2, turn(0.6)), (3, turn(2.0)), (4, turn(2.1)), *((None, turn(2.0 + k / 100)) for k in range(1, 10))]
    for tile in (4096, 2):
        out = embed.near_duplicates(spark.createDataFrame([(i, v, 0, 1) for i, v in rows], SCHEMA), 0.95, tile).collect()
        single = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
        assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=repr) == brute(single, 0.95)


def _brute_components(links):
    root = {x: x for e in links for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    return root


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, 2001 + k) for k in range(50)]
    df = spark.createDataFrame([*links, (7, None), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(df).collect()}
    expected = _brute_components([e for e in links if e[0] != e[1]])
    assert got == expected
    assert graph.components(df.filter("false")).count() == 0


@settings(max_examples=100)
@given(st.lists(st.tuples(st.integers(0, 19), st.integers(0, 19)), max_size=30))
def test_union_find(links):
    sets = graph.UnionFind(20)
    for k in range(0, len(links), 7):
        a, b = np.array(links[k : k + 7], np.int64).reshape(-1, 2).T
        sets.join(a, b)
    expected = _brute_components(links)
    assert [int(sets.root[x]) for x in expected] == list(expected.values())
