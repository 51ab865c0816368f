"""Splits: page-grouped sampling, held-out pages, stratified assignment.

Order is explicit: a numeric column ``ord`` says what comes first; equal values
are ordered by the key.  Give the positions of a seeded shuffle for one exact run,
or a hash of the key for any size.
"""

from __future__ import annotations

import heapq
import random
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def seeded_order(spark, keys: Iterable, seed: int, kind: str = "string") -> DataFrame:
    """(key, ord): positions after a seeded shuffle of a list held by the driver."""
    shuffled = list(keys)
    random.Random(seed).shuffle(shuffled)
    return spark.createDataFrame([(k, i) for i, k in enumerate(shuffled)], f"key {kind}, ord long")


def hashed_order(key: Column, seed: int) -> Column:
    return F.xxhash64(key, F.lit(seed))


def running_before(df: DataFrame, order: str, tie: str, value: Column, name: str, buckets: int = 64) -> DataFrame:
    """Sum of ``value`` over the rows that come before, without a window over all
    rows: sums of ranges of ``order``, then sums within a range."""
    cuts = sorted(set(df.approxQuantile(order, [k / buckets for k in range(1, buckets)], 0.01)))
    bucket = sum((F.when(F.col(order) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    rows = df.withColumns({"_bucket": bucket, "_value": value})
    ahead = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = rows.groupBy("_bucket").agg(F.sum("_value").alias("_sum")).select("_bucket", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_bucket").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0))).join(offsets, "_bucket")
    return out.withColumn(name, F.col("_inside") + F.col("_offset")).drop("_bucket", "_value", "_inside", "_offset")


def page_grouped(files: DataFrame, fraction: float) -> DataFrame:
    """files (name, page_key, ord, the same for all of a page) with a split: pages
    are valid while those before have fewer files than the share of all."""
    pages = files.groupBy("page_key").agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
    target = round(files.count() * fraction)
    placed = running_before(pages, "ord", "page_key", F.col("n"), "_before")
    split = F.when(F.col("_before") < target, "valid").otherwise("train").alias("split")
    return files.join(placed.select("page_key", split), "page_key")


def ungrouped(files: DataFrame, fraction: float) -> DataFrame:
    """The first share of files by ord is valid."""
    cut = round(files.count() * fraction)
    placed = running_before(files, "ord", "name", F.lit(1), "_before")
    return placed.withColumn("split", F.when(F.col("_before") < cut, "valid").otherwise("train")).drop("_before")


#: Candidates that the driver holds at most, for set cover and for floors.
MAX_CANDIDATES = 200_000


def _candidates(rows: DataFrame, key: str, order: list[str], per_label: int) -> list | None:
    """Rows (key, order..., has) that a greedy choice could take, in their order; None if
    there are more than MAX_CANDIDATES of them.  Of rows with the same set of labels it
    takes the first, and as many at most as the labels in the set ask for.

    rows: (key, has, order...), a row a key.
    """
    ahead = Window.partitionBy("has").orderBy(*order, key)
    best = rows.where(F.size("has") > 0).withColumn("_rank", F.row_number().over(ahead)).where(F.col("_rank") <= F.size("has") * per_label)
    found = best.select(key, *order, "has").limit(MAX_CANDIDATES + 1).collect()
    return None if len(found) > MAX_CANDIDATES else sorted(found, key=lambda r: (*[r[c] for c in order], r[key]))


def _label_sets(rows: DataFrame, key: str, labels: Sequence[int], *more: Column) -> DataFrame:
    """(key, has, more...): the asked labels of each key, in order."""
    wanted = rows.sparkSession.createDataFrame([(int(c),) for c in labels], "class_id int").withColumn("_wanted", F.lit(True))
    own = rows.join(F.broadcast(wanted), "class_id", "left")
    has = F.sort_array(F.collect_set(F.when(F.col("_wanted"), F.col("class_id")))).alias("has")
    return own.groupBy(key).agg(has, *more)


def deployment_pages(counts: DataFrame, labels: Sequence[int], min_pages: int = 1, max_pages: int | None = None) -> list:
    """Pages that together hold each label at least min_pages times where the
    data can: the page that adds most labels, then the smaller one, then ord.

    counts: (page_key, ord, class_id, n).  The pages that may be chosen come to the
    driver at once, some of each set of labels; if those are too many, each round is
    one aggregation that returns one row.
    """
    sets = stored(_label_sets(counts.where("n > 0"), "page_key", list(dict.fromkeys(labels)), F.sum("n").alias("size"), F.min("ord").alias("ord")), "page-labels")
    found = _candidates(sets, "page_key", ["size", "ord"], min_pages)
    if found is None:
        return _cover_by_rounds(sets, min_pages, max_pages)
    covered = {c: 0 for r in found for c in r["has"]}
    gain = lambda r: sum(covered[c] < min_pages for c in r["has"])
    # a page's gain only falls, so the best is known once its place in the heap is up to date
    heap = [(-gain(r), i) for i, r in enumerate(found)]
    heapq.heapify(heap)
    chosen: list = []
    while heap and (max_pages is None or len(chosen) < max_pages):
        now = -gain(found[heap[0][1]]), heap[0][1]
        if now != heap[0]:
            heapq.heapreplace(heap, now)
        elif now[0] == 0:
            break
        else:
            heapq.heappop(heap)
            chosen.append(found[now[1]]["page_key"])
            for c in found[now[1]]["has"]:
                covered[c] += 1
    return chosen


def _cover_by_rounds(sets: DataFrame, min_pages: int, max_pages: int | None) -> list:
    spark = sets.sparkSession
    key_type = sets.schema["page_key"].dataType.simpleString()
    covered = {r[0]: 0 for r in sets.select(F.explode("has")).distinct().collect()}
    chosen: list = []
    while (short := [c for c, n in covered.items() if n < min_pages]) and (max_pages is None or len(chosen) < max_pages):
        taken = F.broadcast(spark.createDataFrame([(k,) for k in chosen], f"page_key {key_type}"))
        rows = sets.join(taken, "page_key", "left_anti").withColumn("gain", F.size(F.array_intersect("has", F.array(*map(F.lit, short)))))
        best = rows.where("gain > 0").orderBy(F.desc("gain"), "size", "ord", "page_key").limit(1).collect()
        if not best:
            break
        chosen.append(best[0]["page_key"])
        for c in best[0]["has"]:
            covered[c] += 1
    return chosen


def uncovered_labels(counts: DataFrame, labels: Sequence[int], pages: DataFrame, min_pages: int = 1) -> DataFrame:
    """(class_id, n_pages) of the labels that fewer than min_pages of the chosen
    pages hold, whether or not the data has them at all."""
    wanted = counts.sparkSession.createDataFrame([(c,) for c in labels], "class_id int")
    held = counts.where("n > 0").join(pages.select("page_key").distinct(), "page_key", "left_semi")
    have = held.groupBy("class_id").agg(F.countDistinct("page_key").alias("n_pages"))
    return wanted.join(have, "class_id", "left").na.fill(0, ["n_pages"]).where(F.col("n_pages") < min_pages)


def _floors(best: Callable[[int, list, int, dict], list], labels: Sequence[int], frequency: dict, target: str, floor: int, taken: dict) -> None:
    """Give the target its least number of atoms of each label, rare labels first.
    best: the best free (atom_id, labels) of a label; taken: atom_id to (split, labels)."""
    have = {c: sum(s == target and c in own for s, own in taken.values()) for c in labels}
    place = {c: i for i, c in enumerate(labels)}
    for c in sorted(labels, key=lambda c: (frequency.get(c, 0), place[c])):
        need = floor - have[c]
        if need <= 0:
            continue
        for atom, own in best(c, [k for k in labels if have[k] < floor], need, taken):
            taken[atom] = target, own
            for k in own:
                have[k] += 1


def _best_held(found: list) -> Callable[[int, list, int, dict], list]:
    """Choices among candidates that the driver holds."""
    of_label: dict = {}
    for i, r in enumerate(found):
        for c in r["has"]:
            of_label.setdefault(c, []).append(i)

    def best(label: int, short: list, need: int, taken: dict) -> list:
        asked = set(short)
        free = [i for i in of_label.get(label, []) if found[i]["atom_id"] not in taken]
        ranked = heapq.nsmallest(need, free, key=lambda i: (-len(asked.intersection(found[i]["has"])), i))
        return [(found[i]["atom_id"], found[i]["has"]) for i in ranked]

    return best


def _best_stored(sets: DataFrame) -> Callable[[int, list, int, dict], list]:
    """Choices among the table, a job each."""
    spark, key_type = sets.sparkSession, sets.schema["atom_id"].dataType.simpleString()

    def best(label: int, short: list, need: int, taken: dict) -> list:
        gone = F.broadcast(spark.createDataFrame([(k,) for k in taken], f"atom_id {key_type}"))
        free = sets.where(F.array_contains("has", label)).join(gone, "atom_id", "left_anti")
        score = F.size(F.array_intersect("has", F.array(*map(F.lit, short))))
        return [(r["atom_id"], r["has"]) for r in free.orderBy(score.desc(), "ord", "atom_id").limit(need).collect()]

    return best


def stratified(atoms: DataFrame, classes: DataFrame, labels: Sequence[int], fractions: dict[str, float], min_test: int = 5, min_valid: int = 3) -> DataFrame:
    """(atom_id, split): floors of each label for test, then for valid, then the
    rest by ord up to the shares of test and valid; train gets what is left.

    atoms: (atom_id, ord); classes: (atom_id, class_id), distinct.  The atoms that
    floors may take come to the driver at once, some of each set of labels; if those
    are too many, each choice is a job.
    """
    labels = list(labels)
    atoms = stored(atoms, "atoms")
    rows = classes.select("atom_id", "class_id").distinct().join(atoms, "atom_id")
    sets = stored(_label_sets(rows, "atom_id", list(dict.fromkeys(labels)), F.min("ord").alias("ord")), "atom-labels")
    frequency = {r[0]: r[1] for r in sets.select(F.explode("has").alias("c")).groupBy("c").count().collect()}
    found = _candidates(sets, "atom_id", ["ord"], min_test + min_valid)
    best = _best_stored(sets) if found is None else _best_held(found)
    taken: dict = {}
    _floors(best, labels, frequency, "test", min_test, taken)
    _floors(best, labels, frequency, "valid", min_valid, taken)
    n = atoms.count()
    need = {s: max(0, round(n * fractions.get(s, 0.1)) - sum(v[0] == s for v in taken.values())) for s in ("test", "valid")}
    kind = atoms.schema["atom_id"].dataType.simpleString()
    fixed = atoms.sparkSession.createDataFrame([(k, v[0]) for k, v in taken.items()], f"atom_id {kind}, split string")
    free = atoms.join(F.broadcast(fixed), "atom_id", "left_anti")
    placed = running_before(free, "ord", "atom_id", F.lit(1), "_before")
    split = F.when(F.col("_before") < need["test"], "test").when(F.col("_before") < need["test"] + need["valid"], "valid").otherwise("train")
    rest = placed.select("atom_id", split.alias("split"))
    return rest.unionAll(fixed)
