import itertools
import random

import pytest

from boxweave.operators import atoms, detections, labels, nms, splits, tiling, verify
from boxweave.operators.components import connected


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0) * max(h, 0)
    both = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / both if inter and both > 0 else 0.0


def greedy(rows, t):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], r[1])):
        if all(iou(k[2:6], r[2:6]) < t for k in kept):
            kept.append(r)
    return {r[1] for r in kept}


def random_boxes(seed, n, groups=2, extent=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.randrange(extent), rng.randrange(extent)
        rows.append((rng.randrange(groups), i, x, y, x + rng.randrange(8, 40), y + rng.randrange(8, 40), rng.randrange(20) / 20))
    return rows


BOX = "g int, det_id long, x1 int, y1 int, x2 int, y2 int, confidence double"


@pytest.mark.parametrize("threshold", [0.1, 0.5])
def test_nms_against_brute_force(spark, threshold):
    rows = random_boxes(1, 150)
    df = spark.createDataFrame(rows, BOX)
    want = set().union(*(greedy([r for r in rows if r[0] == k], threshold) for k in (0, 1)))
    assert {r.det_id for r in nms.suppress(df, ["g"], threshold).collect()} == want
    assert {r.det_id for r in nms.suppress_large(df, ["g"], threshold, cell=32).collect()} == want
    more = df.unionAll(spark.createDataFrame([(7, 1000, 0, 0, 9, 9, 0.5)], BOX))
    assert {r.det_id for r in nms.suppress(more, ["g"], threshold, most=10).collect()} == want | {1000}


def test_nms_cases(spark):
    rows = [(0, 0, 10, 10, 50, 50, 0.9), (0, 1, 12, 12, 52, 52, 0.8), (1, 2, 0, 0, 10, 10, 0.5), (1, 3, 0, 0, 10, 5, 0.4), (2, 4, 0, 0, 9, 9, None)]
    df = spark.createDataFrame(rows, BOX)
    assert sorted(r.det_id for r in nms.suppress(df, ["g"], 0.5).collect()) == [0, 2, 4]
    assert sorted(r.det_id for r in nms.suppress(df, ["g"], 0.5, 0.45).collect()) == [0, 2]
    assert nms.suppress(df.limit(0), ["g"]).count() == 0


@pytest.mark.parametrize("threshold", [0.0, 0.3, 1.0])
def test_fold_and_rounds_agree(spark, threshold):
    """Rows that share an id, equal rows, boxes without an area, ties, nulls."""
    rng = random.Random(4)
    rows = random_boxes(3, 60)
    rows += [rng.choice(rows) for _ in range(20)] + [(r[0], rng.choice(rows)[1], *r[2:]) for r in rows[:15]] + [(0, 5, 3, 3, 3, 9, 0.9), (0, 5, 3, 3, 3, 9, 0.9), (1, 7, 10, 10, 30, 30, None)]
    df = spark.createDataFrame([(*r, f"n{i % 3}") for i, r in enumerate(rows)], BOX + ", note string").repartition(3)
    key = lambda found: sorted(map(tuple, found.collect()), key=str)
    folded, rounds = nms.suppress(df, ["g"], threshold, most=10**6), nms.suppress_large(df, ["g"], threshold, cell=32)
    assert folded.columns == rounds.columns == df.columns
    assert key(folded) == key(rounds) == key(nms.suppress(df, ["g"], threshold, most=1))
    assert threshold > 0 or folded.count() == 2
    assert key(nms.suppress(df, ["g"], threshold, 0.5, most=1)) == key(nms.suppress(df, ["g"], threshold, 0.5))


def test_iou_pairs(spark):
    rows = random_boxes(2, 80)
    got = {(r.a_id, r.b_id): (r.inter, r.union_area) for r in nms.iou_pairs(spark.createDataFrame(rows, BOX), ["g"], 16).collect()}
    want = {}
    for a, b in itertools.combinations(rows, 2):
        if a[0] == b[0] and iou(a[2:6], b[2:6]) > 0:
            w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
            size = lambda r: (r[4] - r[2]) * (r[5] - r[3])
            want[a[1], b[1]] = w * h, size(a) + size(b) - w * h
    assert got == want


def tiled(spark, boxes, **kw):
    images = spark.createDataFrame([(1, 3000, 2000)], "image_id int, w int, h int")
    df = spark.createDataFrame([(1, i, *map(float, b)) for i, b in enumerate(boxes)], "image_id int, k int, x1 double, y1 double, x2 double, y2 double")
    return {(r.k, r.tile_x): (r.cx1, r.cx2) for r in tiling.tile_boxes(df, images, 1280, 0.0, **kw).collect()}


def test_majority_and_clip(spark):
    boxes = [(1270, 0, 1290, 20), (1269, 0, 1289, 20), (1280, 0, 1300, 20)]
    assert tiled(spark, boxes) == {(1, 0): (1269, 1289), (2, 1280): (0, 20)}
    assert tiled(spark, boxes[:1], fit=True) == {(0, 0): (1270, 1280), (0, 1280): (0, 10)}


def test_tile_ranges_equal_nested_loops(spark):
    rng = random.Random(3)
    boxes = [(x := rng.uniform(-50, 3100), y := rng.uniform(-50, 2100), x + rng.uniform(0, 900), y + rng.uniform(0, 700)) for _ in range(60)]
    images = spark.createDataFrame([(1, 3000, 2000)], "image_id int, w int, h int")
    df = spark.createDataFrame([(1, i, *map(float, b)) for i, b in enumerate(boxes)], "image_id int, k int, x1 double, y1 double, x2 double, y2 double")
    got = {(r.k, r.tile_x, r.tile_y) for r in tiling.tile_boxes(df, images, 500, 0.4, True).collect()}
    grid = [(x, y) for x in range(0, 3000, 300) for y in range(0, 2000, 300)]
    want = {(i, x, y) for i, b in enumerate(boxes) for x, y in grid if min(b[2], x + 500) > max(b[0], x) and min(b[3], y + 500) > max(b[1], y)}
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(5, 5), (None, 1)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.id: r.component_id for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


RECT = "struct<x1:double,y1:double,x2:double,y2:double>"


def test_atoms_chain_collapse_and_eps(spark):
    tiles = [(i, "chain", (i * 9.0, 0.0, i * 9.0 + 11.0, 10.0)) for i in range(30)]
    tiles += [(100, "far", (0.0, 0.0, 10.0, 10.0)), (101, "far", (9.0, 0.0, 20.0, 10.0)), (102, "far", (8.9, 0.0, 20.0, 10.0))]
    tiles += [(200, "mixed", (0.0, 0.0, 1.0, 1.0)), (201, "mixed", (500.0, 0.0, 501.0, 1.0))]
    images = [("chain", "full", 1, 1), ("far", "subregion", 1, 1), ("mixed", "full", 1, 1), ("mixed", "subregion", 1, 1)]
    df = spark.createDataFrame(tiles, f"tile_id long, page_key string, page_rect {RECT}")
    got = {r.tile_id: r.atom_id for r in atoms.build_atoms(df, spark.createDataFrame(images, "page_key string, kind string, w int, h int")).collect()}
    assert {got[i] for i in range(30)} == {0}
    assert got[100] == 100 and got[101] == 100 or got[101] == 101 or got[101] == got[102]
    assert got[102] == got[100]  # 1.1 shared pixels
    assert got[200] == got[201] == 200


def test_page_split_overshoots(spark):
    files = [(f"{k}{i}", k, o) for k, n, o in (("a", 5, 0), ("b", 4, 1), ("c", 3, 2)) for i in range(n)]
    df = spark.createDataFrame(files, "name string, page_key string, ord long")
    got = splits.page_grouped(df, 0.5).where("split = 'valid'").groupBy("page_key").count().collect()
    assert {r.page_key: r["count"] for r in got} == {"a": 5, "b": 4}


def test_running_before(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(50), rng.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, ord long, n long")
    got = {r.k: r.t for r in splits.running_before(df, "ord", "k", df["n"], "t", 7).collect()}
    total, want = 0, {}
    for k, o, n in sorted(rows, key=lambda r: (r[1], r[0])):
        want[k], total = total, total + n
    assert got == want


def test_set_cover(spark):
    counts = [("X", 0, 1, 5), ("X", 0, 2, 4), ("Y", 1, 1, 2), ("Y", 1, 2, 2), ("Z", 2, 3, 1)]
    df = spark.createDataFrame(counts, "page_key string, ord long, class_id int, n long")
    assert splits.deployment_pages(df, [1, 2, 3, 9]) == ["Y", "Z"]
    assert splits.deployment_pages(df, [1, 2, 3], max_pages=1) == ["Y"]
    assert splits.deployment_pages(df, [9]) == []


def brute_assign(n_atoms, classes, wanted, order, fractions, floors):
    have = {a: {c for x, c in classes if x == a} for a in n_atoms}
    out = {}
    freq = {c: sum(c in s for s in have.values()) for c in wanted}
    for target, floor in (("test", floors[0]), ("valid", floors[1])):
        got = {c: sum(out.get(a) == target and c in have[a] for a in n_atoms) for c in wanted}
        for c in sorted(wanted, key=lambda c: freq[c]):
            need = max(0, floor - got[c])
            short = {k for k in wanted if got[k] < floor}
            free = sorted((a for a in n_atoms if a not in out and c in have[a]), key=lambda a: (-len(have[a] & short), order[a]))
            for a in free[:need]:
                out[a] = target
                for k in have[a] & set(wanted):
                    got[k] += 1
    free = sorted((a for a in n_atoms if a not in out), key=order.get)
    need = [max(0, round(len(n_atoms) * fractions[s]) - sum(v == s for v in out.values())) for s in ("test", "valid")]
    for i, a in enumerate(free):
        out[a] = "test" if i < need[0] else "valid" if i < sum(need) else "train"
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_stratified(spark, seed):
    rng = random.Random(seed)
    ids = list(range(40))
    order = dict(zip(ids, rng.sample(range(1000), 40), strict=True))
    classes = [(a, c) for a in ids for c in range(6) if rng.random() < 0.05 * (c + 1)]
    fractions = {"test": 0.12, "valid": 0.10}
    df = splits.stratified(
        spark.createDataFrame(list(order.items()), "atom_id long, ord long"), spark.createDataFrame(classes, "atom_id long, class_id int"), [0, 1, 2, 5], fractions, 3, 2
    )
    assert {r.atom_id: r.split for r in df.collect()} == brute_assign(ids, classes, [0, 1, 2, 5], order, fractions, (3, 2))


def test_seeded_order_is_the_shuffle(spark):
    want = list("abcdef")
    random.Random(42).shuffle(want)
    assert [r.key for r in splits.seeded_order(spark, "abcdef", 42).orderBy("ord").collect()] == want


def test_label_space():
    s = labels.LabelSpace(["b", "a", "c"], {"z": ["a"], "y": ["c"]})
    assert s.labels == ["y", "z", "b", labels.BACKGROUND] and s.kept_ids == [0, 1, 2] and s.background_id == 3
    assert labels.LabelSpace(["b"], policy="drop").labels == ["b"]
    for bad in ({"classes": ["a"], "policy": "keep"}, {"classes": ["a"], "groups": {"g": ["x"]}}, {"classes": ["a", "a"]}):
        with pytest.raises(ValueError):
            labels.LabelSpace(**bad)


def test_duplicate_class_names_take_the_last(spark):
    classes = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "class_id int, name string")
    assert [tuple(r) for r in labels.policy_table(classes, labels.LabelSpace(["a"])).collect()] == [(1, 0)]


def test_records(spark):
    raw = ['{"id":"a","x1":0,"y1":0,"x2":1,"y2":1,"conf":0}', '{"crop_id":"b","x1":5,"y1":0,"x2":5,"y2":1}', '{"x1":0}', "no json", None,
           '{"id":"","ID":"c","x1":"1","y1":0,"x2":2.5,"y2":1,"conf":null,"confidence":0.5,"class":3,"label":"t"}']
    got = detections.normalize_records(spark.createDataFrame([(r,) for r in raw], "record string")).collect()
    assert sorted((r.crop_id, r.confidence, r.class_id, r.class_name) for r in got) == [("a", 1.0, 0, "symbol"), ("c", 1.0, 3, "t")]


def test_score_lift_stitch(spark):
    images = spark.createDataFrame([(1, 2000, 900)], "image_id long, w long, h long")

    def scorer(tiles):
        assert len(tiles) <= 2
        return [[(10.6, 10.2, 60.7, 60.9, 0.9, 0), (5.0, 5.0, 5.0, 9.0, 0.9, 0), (1.0, 1.0, 3.0, 3.0, 0.1, 0)]] * len(tiles)

    scored = detections.score_tiles(images, scorer, batch_size=2)
    from pyspark.sql import functions as F

    rows = detections.stitch(scored.withColumn("det_id", F.col("tile_x").cast("long")), spark.createDataFrame([], "class_id int, name string"))
    got = sorted((r.x1, r.y1, r.x2, r.y2, r.class_name) for r in rows.collect())
    assert got == [(10, 10, 60, 60, "0"), (970, 10, 1020, 60, "0"), (1930, 10, 1980, 60, "0")]


def test_classify(spark):
    crops = spark.createDataFrame([(str(i),) for i in range(5)], "crop_id string").coalesce(1)
    got = detections.classify(crops, lambda ids: [{"embeddings": [float(i), 1.0], "x": 1} for i in ids], 2).collect()
    assert [(r.crop_id, r.embedding, r.embedding_dim, r.classification) for r in got][4] == ("4", [4.0, 1.0], 2, '{"x": 1}')
    with pytest.raises(Exception, match="returned 0 rows"):
        detections.classify(crops, lambda ids: [], 2).collect()


def test_retry():
    waits, calls = [], []

    def busy():
        calls.append(1)
        raise RuntimeError("409 Already running" if len(calls) < 3 else "503" if len(calls) < 5 else "other")

    with pytest.raises(RuntimeError, match="other"):
        detections.with_retry(busy, sleep=waits.append)()
    assert waits == [2.0, 4.0, 4.0, 8.0]


def test_verify_raises(spark):
    rows = [(1, "a", "p", "train", (0.0, 0.0, 10.0, 10.0)), (2, "b", "p", "valid", (5.0, 0.0, 15.0, 10.0))]
    tiles = spark.createDataFrame(rows, f"tile_id long, tile_name string, page_key string, split string, page_rect {RECT}")
    none = spark.createDataFrame([], "page_key string")
    with pytest.raises(AssertionError, match="shared_pixels: 1"):
        verify.verify(tiles, none)
    verify.verify(tiles.where("tile_id = 1"), none)


def test_choices_by_jobs_equal_those_on_the_driver(spark, monkeypatch):
    rng = random.Random(6)
    counts = [(p, rng.randrange(40), c, rng.randrange(1, 9)) for p in range(60) for c in rng.sample(range(30), rng.randrange(0, 5))]
    ords = {p: o for p, o, _, _ in counts}
    pages = spark.createDataFrame([(p, ords[p], c, n) for p, _, c, n in counts], "page_key long, ord int, class_id int, n int")
    atoms = spark.createDataFrame([(p, p * 7 % 60) for p in range(60)], "atom_id long, ord int")
    classes = pages.selectExpr("page_key AS atom_id", "class_id")
    run = lambda: (splits.deployment_pages(pages, range(0, 30, 2), 2), sorted(map(tuple, splits.stratified(atoms, classes, [3, 4, 8, 9], {"test": 0.2, "valid": 0.1}, 3, 2).collect())))
    held = run()
    # the cover by its definition
    has = {p: {c for q, _, c, _ in counts if q == p and c % 2 == 0} for p in range(60)}
    size = {p: sum(n for q, _, _, n in counts if q == p) for p in range(60)}
    covered, chosen = dict.fromkeys(set().union(*has.values()), 0), []
    while True:
        gain = {p: sum(covered[c] < 2 for c in has[p]) for p in has if p not in chosen}
        p = min(gain, key=lambda p: (-gain[p], size[p], ords.get(p, 0), p))
        if not gain[p]:
            break
        chosen.append(p)
        for c in has[p]:
            covered[c] += 1
    assert held[0] == chosen
    monkeypatch.setattr(splits, "MAX_CANDIDATES", 3)
    assert run() == held
