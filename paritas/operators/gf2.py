"""Arithmetic over GF(2) on long tables: a missing row is 0, an odd count is 1.

Every aggregate here is a plain count or xor, so Spark combines on the map side before the shuffle
and a hot detector, fault or shot never gathers in one task as raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def odd(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that occur an odd number of times."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("_c"))
    return counted.where(F.col("_c") % 2 == 1).select(*keys)


# Shots with more faults than this do not take the way of whole columns.
FEW_FAULTS = 64


def columns_of(edges: DataFrame) -> DataFrame:
    """(fault, dets): every column as one array of the detectors that hold it an odd number of times, at most every detector once."""
    unknown = F.when(F.bool_or(F.col("det").isNull()), F.array(F.lit(None))).otherwise(F.array())  # collect_list leaves a null out
    return odd(edges, ["fault", "det"]).groupBy("fault").agg(F.concat(F.collect_list("det"), unknown).alias("dets"))


def by_size(support: DataFrame, shot: str = "shot", least: int = 1) -> tuple[DataFrame, DataFrame]:
    """support(shot, fault) of the shots with ``least`` to FEW_FAULTS rows, and of those with more."""
    sizes = support.groupBy(F.col(shot).alias("_shot")).agg(F.count("*").alias("_n"))
    counted = support.select(shot, "fault").join(sizes, F.col(shot).eqNullSafe(F.col("_shot")))
    return (counted.where((F.col("_n") >= least) & (F.col("_n") <= FEW_FAULTS)).select(shot, "fault"),
            counted.where(F.col("_n") > FEW_FAULTS).select(shot, "fault"))


def gf2_product(support: DataFrame, edges: DataFrame, shot: str = "shot") -> DataFrame:
    """support(shot, fault) times edges(det, fault): the detectors that fire, (shot, det).

    The columns of a shot with a few faults are added up as arrays, so that columns are shuffled and not a row for
    every detector that they touch. The rows of all other shots are counted, on the map side first.
    """
    few, many = by_size(support, shot)
    columns = few.join(columns_of(edges), "fault").groupBy(shot).agg(F.collect_list("dets").alias("_d"))  # at most FEW_FAULTS arrays

    def plus(a: Column, b: Column) -> Column:
        return F.concat(F.array_except(a, b), F.array_except(b, a))

    total = F.aggregate(F.slice("_d", 2, FEW_FAULTS), F.col("_d")[0], plus)
    fired = columns.select(shot, F.explode(total).alias("det"))
    return fired.unionByName(odd(many.join(edges, "fault").select(shot, "det"), [shot, "det"]))


def symmetric_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return odd(a.select(*keys).unionByName(b.select(*keys)), keys)


def residual(fired: DataFrame, committed: DataFrame, edges: DataFrame) -> DataFrame:
    """What is left of the syndrome after the committed faults: fired xor H c."""
    flips = committed.join(edges, "fault").select("shot", "det")
    return odd(fired.select("shot", "det").unionByName(flips), ["shot", "det"])


def residual_of(support: DataFrame, committed: DataFrame, edges: DataFrame) -> DataFrame:
    """The residual where the syndrome is that of known faults: H s xor H c = H (s xor c), so that only the faults that differ meet the edges."""
    return gf2_product(symmetric_difference(support, committed, ["shot", "fault"]), edges)


def predict_class(support: DataFrame, column_class: DataFrame) -> DataFrame:
    """(shot, mask): the observables flipped by each support."""
    return support.join(column_class, "fault").groupBy("shot").agg(F.bit_xor("cls").alias("mask"))


def logical_failure(shots: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(shot, failed) for every shot; a shot without a mask row has mask 0."""
    guess = predicted.select("shot", F.col("mask").alias("_p"))
    fact = truth.select("shot", F.col("mask").alias("_t"))
    joined = shots.select("shot").join(guess, "shot", "left").join(fact, "shot", "left")
    return joined.select("shot", (F.coalesce("_p", F.lit(0)) != F.coalesce("_t", F.lit(0))).alias("failed"))


def satisfies(shots: DataFrame, support: DataFrame, fired: DataFrame, edges: DataFrame,
              dets: DataFrame | None = None) -> DataFrame:
    """(shot, converged): whether H e equals the syndrome, on all detectors or the given ones."""
    left = residual(fired, support, edges)
    if dets is not None:
        left = left.join(dets.select("det"), "det", "left_semi")
    open_shots = left.select("shot").distinct().withColumn("_open", F.lit(True))
    return shots.select("shot").join(open_shots, "shot", "left").select(
        "shot", F.col("_open").isNull().alias("converged"))


def satisfies_both(shots: DataFrame, left: DataFrame, dets: DataFrame) -> DataFrame:
    """(shot, converged, converged_masked) from a residual: whether nothing is left, and whether nothing is left on ``dets``."""
    asked = dets.select("det").distinct().withColumn("_in", F.lit(True))
    open_shots = left.join(asked, "det", "left").groupBy("shot").agg(F.lit(True).alias("_open"), F.bool_or("_in").alias("_masked"))
    return shots.select("shot").join(open_shots, "shot", "left").select(
        "shot", F.col("_open").isNull().alias("converged"), F.col("_masked").isNull().alias("converged_masked"))


def apply_bias(rows: DataFrame, shots: DataFrame, bias: DataFrame, position: str = "det") -> DataFrame:
    """Flips the biased positions in every shot."""
    positions = bias.agg(F.collect_set(position)).scalar()  # at most every detector once
    flips = shots.select("shot").withColumn("_p", positions).select("shot", F.explode("_p").alias(position))
    return odd(rows.select("shot", position).unionByName(flips), ["shot", position])


def biased_totals(rows: DataFrame, shots: DataFrame, bias: DataFrame, position: str = "det") -> DataFrame:
    """(shot, flipped, sum): how many positions ``apply_bias`` leaves flipped in each shot, and their sum; shots without any are absent.

    A shot's rows meet the biased positions, B - 2 (rows in B) more are flipped than there are rows: no shot is given all of
    B, so the work grows with the rows. ``rows`` holds a position of a shot at most once.
    """
    inside = odd(bias, [position]).select(F.col(position).alias("_p"), F.lit(True).alias("_in"))
    met = rows.join(inside, F.col(position).eqNullSafe(F.col("_p")), "left")
    held, value = F.col("_in").isNotNull(), F.coalesce(F.col(position).cast("bigint"), F.lit(0))
    zero = F.lit(0).cast("bigint")
    own = met.select("shot", zero.alias("_flip"), F.lit(1).cast("bigint").alias("n"), held.cast("bigint").alias("b"), value.alias("s"), F.when(held, value).otherwise(zero).alias("sb"))
    flipped = odd(shots, ["shot"]).select("shot", F.lit(1).cast("bigint").alias("_flip"), *[zero.alias(c) for c in ("n", "b", "s", "sb")])
    per = own.unionByName(flipped).groupBy("shot").agg(F.max("_flip").alias("_flip"), *[F.sum(c).alias(c) for c in ("n", "b", "s", "sb")])
    whole = inside.agg(F.struct(F.count("*").alias("n"), F.coalesce(F.sum("_p").cast("bigint"), zero).alias("s"))).scalar()
    out = per.withColumn("_all", whole).select(
        "shot", (F.col("n") + F.col("_flip") * (F.col("_all.n") - 2 * F.col("b"))).alias("flipped"),
        (F.col("s") + F.col("_flip") * (F.col("_all.s") - 2 * F.col("sb"))).alias("sum"))
    return out.where("flipped > 0")


def support_weight(support: DataFrame, faults: DataFrame) -> DataFrame:
    """(shot, weight): sum of the finite log ratios of each support."""
    lam = F.when(F.abs("lam") < float("inf"), F.col("lam")).otherwise(F.lit(0.0))
    return support.join(faults.select("fault", "lam"), "fault").groupBy("shot").agg(F.sum(lam).alias("weight"))


def canonical_support(support: DataFrame) -> DataFrame:
    """(shot, faults): the ascending support array. Its length is at most the number of faults."""
    return support.groupBy("shot").agg(F.sort_array(F.collect_set("fault")).alias("faults"))


def fold_hash(faults: Column) -> Column:
    from paritas.functions.hashing import splitmix64

    return F.aggregate(faults, F.lit(0).cast("bigint"), lambda h, j: splitmix64(h.bitwiseXOR(j.cast("bigint"))))


def support_hash(support: DataFrame) -> DataFrame:
    """(shot, hash): the solution hash, folded over the ascending support."""
    return canonical_support(support).select("shot", fold_hash(F.col("faults")).alias("hash"))


def shared_detectors(support: DataFrame, edges: DataFrame) -> DataFrame:
    """(shot, fault, anchor): each support fault with the smallest fault of a detector they share.

    The star around the smallest fault connects the same faults as all pairs would, without a
    quadratic number of rows on a busy detector. Shots of a few faults compare their columns as arrays; a row per
    detector is made for all others only.
    """
    few, many = by_size(support, least=2)  # one fault shares with no other
    columns = edges.groupBy("fault").agg(F.collect_set("det").alias("dets"))  # at most every detector once
    shots = few.join(columns, "fault").groupBy("shot").agg(F.collect_list(F.struct("fault", "dets")).alias("_c"))  # at most FEW_FAULTS arrays
    number = support.schema["fault"].dataType.simpleString()

    def anchors_of(x: Column) -> Column:
        """The smaller faults, each of which is the first to touch some detector of x."""
        def meet(left: Column, y: Column) -> Column:
            met = F.struct(F.array_except(left["dets"], y["dets"]).alias("dets"), F.array_append(left["found"], y["fault"]).alias("found"))
            return F.when(F.arrays_overlap(left["dets"], y["dets"]), met).otherwise(left)

        none = F.struct(x["dets"].alias("dets"), F.array().cast(f"array<{number}>").alias("found"))
        return F.aggregate(F.filter(F.array_sort("_c"), lambda y: y["fault"] < x["fault"]), none, meet)["found"]

    stars = shots.select("shot", F.explode(F.transform("_c", lambda x: F.struct(x["fault"].alias("fault"), anchors_of(x).alias("found")))).alias("s"))
    near = stars.select("shot", F.col("s.fault").alias("fault"), F.explode("s.found").alias("anchor"))
    touched = many.join(edges, "fault")
    anchors = touched.groupBy("shot", "det").agg(F.min("fault").alias("anchor"))
    far = touched.join(anchors, ["shot", "det"]).where(F.col("fault") != F.col("anchor")).select("shot", "fault", "anchor")
    return near.unionByName(far).distinct()


def support_components(support: DataFrame, edges: DataFrame) -> DataFrame:
    """(shot, fault, component): connected components, named by their smallest fault.

    Faults are connected through stars on shared detectors, one graph per shot; a fault without a
    neighbour is a component of its own. There is no limit on how long a chain may be.
    """
    from paritas.operators.graphs import components

    star = shared_detectors(support, edges).select("shot", F.col("fault").alias("a"), F.col("anchor").alias("b"))
    roots = components(star, ["shot"]).withColumnRenamed("node", "fault")
    return support.select("shot", "fault").distinct().join(roots, ["shot", "fault"], "left").select(
        "shot", "fault", F.coalesce("root", "fault").alias("component"))


def cluster_terms(components: DataFrame, faults: DataFrame) -> DataFrame:
    """(shot, components, sum_sq, total, q_supp) from labelled supports.

    L_c is the sum of finite log ratios in component c and total the sum over all faults.
    """
    finite = faults.where(F.abs("lam") < float("inf"))
    total = finite.agg(F.sum("lam").alias("total")).scalar()
    lam = F.when(F.abs("lam") < float("inf"), F.col("lam")).otherwise(F.lit(0.0))
    sums = components.join(faults.select("fault", "lam"), "fault").groupBy("shot", "component").agg(
        F.sum(lam).alias("_l"))
    out = sums.groupBy("shot").agg(F.count("*").alias("components"), F.sum(F.col("_l") * F.col("_l")).alias("sum_sq"))
    out = out.withColumn("total", total)
    return out.withColumn("q_supp", F.when(F.col("total") > 0, F.sqrt("sum_sq") / F.col("total")))
