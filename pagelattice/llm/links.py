"""Linking similar sets: candidates by common keys, overlaps summed over fragments, components.

A pair of sets may link only where both carry a common key. Members of a key that few carry meet each
other; below a key that many carry, every member is first held against one hub (the smallest id), and
only members that still lie in different components meet afterwards. So a group of thousands of near
copies costs one comparison a member, and no link between different components is lost. Keys with the
same members count once, and parity sketches, which bound the difference of two sets from below, rule
most pairs out before any set is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, is_empty, pieces


#: Slices of delta elements; more of them need less disk and read the deltas more often.
SLICES = 4
#: Counters by which elements are put in order from rare to frequent, 2 bytes each; any number gives the same links.
SLOTS = 1 << 22
#: Members of a key up to which all of them meet; those of other keys meet a hub first.
FEW = 8
#: All members below an element meet once they make at most so many pairs for each of them; before that, in at most
#: so many turns, those in several components are held against so many of them, others each time.
PAIRS = 4
TURNS = 3
HUBS = 2
#: Edges up to which components are found on the driver, which takes two jobs instead of a dozen.
SMALL = 100_000


def small_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, components) of a few edges, as components gives them."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))
    a, b = ends[: len(a)], ends[len(a) :]
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return nodes, nodes[root]
        # Roots hang on smaller ones only, then all paths are shortened.
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is its smallest reachable node.

    Each round hooks every node to its smallest neighbour, shortens the paths by doubling and
    contracts the graph, so the rounds are logarithmic. Everything but the last SMALL edges stays in
    distributed tables.
    """
    edges = scratch.save(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    labels = None
    while many := edges.count():
        if many <= SMALL:
            few = edges.toArrow()
            found = small_components(few["a"].to_numpy(), few["b"].to_numpy())
            table = pa.table({"node": found[0], "root": found[1]})
            hook = scratch.spark.createDataFrame(table, "node bigint, root bigint")
            if labels is None:
                return scratch.save(hook.withColumnRenamed("root", "component"), "labels")
            step = hook.withColumnRenamed("node", "component")
            composed = labels.join(step, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
            composed = scratch.save(composed, "labels")
            scratch.drop(edges, labels)
            return composed
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root"))
        hook = scratch.save(hook, "hook")
        while True:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            once = hook.join(up, "root").select("node", F.col("higher").alias("root"))
            # A second step at once, by the old pointers; what it doesn't move has come to a root.
            jumped = once.join(up, "root").select(
                "node", F.col("higher").alias("root"), (F.col("higher") != F.col("root")).alias("moved")
            )
            jumped = scratch.save(jumped, "jump")
            scratch.drop(hook)
            still = not is_empty(jumped.where("moved"))
            hook = jumped.drop("moved")
            hook._pagelattice_path = jumped._pagelattice_path  # noqa: SLF001
            if not still:
                break
        # A star around the smallest id is done after one round; only edges between roots go on.
        a = hook.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        rest = edges.join(a, "a").join(b, "b").where("ra <> rb")
        rest = scratch.save(
            rest.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges"
        )
        if labels is None:
            composed = hook.withColumnRenamed("root", "component")
        else:
            step = hook.select(F.col("node").alias("component"), "root")
            composed = labels.join(step, "component", "left").select(
                "node", F.coalesce("root", "component").alias("component")
            )
        composed = scratch.save(composed, "labels")
        scratch.drop(edges, hook, *([labels] if labels is not None else []))
        edges, labels = rest, composed
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def extended(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """labels(node, component), as components gives them, after more links(a, b): only those between components count."""
    at = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    links = links.join(at, "a", "left").join(at.select(F.col("a").alias("b"), F.col("ca").alias("cb")), "b", "left")
    links = links.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
    links = scratch.save(links.distinct(), "between")
    if is_empty(links):
        return labels
    step = components(links, scratch).withColumnRenamed("component", "root")
    both = labels.join(step.withColumnRenamed("node", "component"), "component", "full")
    # A component that no label names is a node that had no link so far.
    return scratch.save(
        both.select(F.coalesce("node", "component").alias("node"), F.coalesce("root", "component").alias("component")), "labels"
    )


def odd_bits(a: str, b: str) -> F.Column:
    """The bits in which two parity sketches differ; the longer one is folded to the length of the shorter."""

    def folded(x: str, y: str) -> F.Column:
        half = F.size(y)
        halves = F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > half, halves).otherwise(F.col(x))

    bits = F.zip_with(folded(a, b), folded(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    bits = F.aggregate(bits, F.lit(0), lambda total, x: total + x)
    return F.when(F.greatest(F.size(a), F.size(b)) <= 2 * F.least(F.size(a), F.size(b)), bits).otherwise(0)


def slot_counts(sets: DataFrame) -> np.ndarray:
    """How many elements of sets(items) fall in each of SLOTS slots, 32767 at most: no element is in more sets than its slot's count says below that."""
    slots = sets.select(F.explode("items").alias("e")).groupBy(F.pmod("e", F.lit(SLOTS)).cast("int").alias("slot")).count()
    slots = slots.select("slot", F.least("count", F.lit(32767)).cast("smallint").alias("many")).toArrow()
    counts = np.zeros(SLOTS, np.int16)
    counts[slots["slot"].to_numpy()] = slots["many"].to_numpy()
    return counts


LISTED = "hub bigint, outer boolean, id bigint, n bigint, d bigint, element bigint, left bigint, counts boolean, other boolean"


def _listed(rarity: Broadcast):
    """LISTED rows of (hub, id, n, good, far, more, keep, delta, keep_delta); left: how many of a list come from an element on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = rarity.value
        for batch in pieces(batches):
            at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            good, far = (at[name].to_numpy(zero_copy_only=False) for name in ("good", "far"))
            for outer, name, most in ((True, "more", "keep"), (False, "delta", "keep_delta")):
                sizes = at[name].value_lengths().to_numpy()
                items = at[name].flatten().to_numpy()
                row = np.repeat(np.arange(len(sizes)), sizes)
                seen = known[items % len(known)]
                order = np.lexsort((items, seen, row))
                items, seen = items[order], seen[order]
                place = np.arange(len(items)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                first = place < at[most].to_numpy()[row]
                counts = first & far[row] if outer else first
                other = np.ones(len(row), bool) if outer else ~good[row]
                # Far ones meet in the first elements of both, and never in what only one set has.
                wanted = (counts | ~far[row]) & (seen > 1) if outer else counts | other
                row = row[wanted]
                values = [np.full(len(row), outer), items[wanted], sizes[row] - place[wanted], counts[wanted], other[wanted], sizes[row].astype(np.int64)]
                outers, element, left, counts, other, d = map(pa.array, values)
                whose = [at[c].take(pa.array(row)) for c in ("hub", "id", "n")]
                arrays = [whose[0], outers, *whose[1:], d, element, left, counts, other]
                yield pa.RecordBatch.from_arrays(arrays, [field.split()[0] for field in LISTED.split(", ")])

    return run


def linked(
    slices: list[DataFrame],
    meta: DataFrame,
    fragments: Callable[[DataFrame], DataFrame],
    percent: int,
    scratch: Scratch,
    spent: DataFrame | None = None,
) -> DataFrame:
    """(node, component) over links of at least percent % Jaccard among ids that share a key.

    slices: the keys, in parts that share no key, each (id, key, chosen), where what is not chosen only meets
    what is; meta: (id unique, n, sig binary, sketch array<bigint>), with sketches as parity_sketch makes them;
    fragments(ids) gives (id, part, items array<bigint>) of those ids' sets, cut at the same places of the
    global order. spent is the table behind the slices, if it may go once they are read.

    1. Members of a key that at most FEW carry are compared with each other, those of other keys with the
       key's hub: the elements that only one of the two has are counted fragment by fragment and summed
       per pair.
    2. Larger keys whose members now lie in several components are open. Their members are held against one
       reference h, the root of the key's largest component, and the elements kept in which they differ
       (the delta). Those that link to h are linked with it. Members are near or far: a near one has
       percent % of its elements in H, as all that link to h have. A far one, a, must share percent % of A
       with whatever it links to, so more than H holds of it: the rest lies in A - H, and whoever links to
       it has one of the rarer elements of that. For near members a and b, A ^ B is the difference of their
       deltas; if b does not link to h, a and b can only link by sharing more than half of a's delta, and
       so one of the rarer elements of it. Those meet, by element, with hubs of the element while that is
       a crowd, then with what is left in other components. So elements of H are listed only for near members.
       What is rare is told by slot_counts before anything is listed: all lists are in one order, so two far ones
       share one of the rarer elements of both, and the more frequent ones of a far one are not listed at all.
    """
    copies = meta.where("n > 0").groupBy("sig").agg(F.min("id").alias("rep"), F.max("id").alias("last"))
    copies = scratch.save(copies.where("rep < last").select("sig", "rep"), "copies")
    same = meta.where("n > 0").join(copies, "sig").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    same = scratch.save(same, "same")
    # A hub is the smallest id of its key, so it is never a copy of a smaller one; copies need no spoke.
    # Keys are dealt with in slices, so that only a slice of them is on the exchanges' disks at a time.
    met = []
    for part in slices:
        hubs = part.groupBy("key").agg(
            F.min(F.when(F.col("chosen"), F.col("id"))).alias("hub"), F.min("id").alias("first"), F.max("id").alias("last")
        )
        hubs = scratch.save(hubs.where("hub is not null and first < last").select("key", "hub"), "hubs")
        some = part.join(hubs, "key").where("id <> hub").join(same.select(F.col("a").alias("id")), "id", "left_anti")
        met.append(scratch.save(some.select("key", "hub", "id").distinct(), "met"))
        scratch.drop(hubs)
    if spent is not None:
        scratch.drop(spent)
    members = reduce(DataFrame.unionByName, met)
    alike = members.groupBy("key", "hub").agg(
        F.count("*").alias("many"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")
    )
    alike = alike.groupBy("hub", "many", "x", "y").agg(F.min("key").alias("key"))
    members = scratch.save(members.join(alike.select("key", "many"), "key"), "members")
    scratch.drop(*met)

    def whole(labels: DataFrame) -> DataFrame:
        """labels of all nodes, after those of one set of several copies each: the smallest of them stands for all."""
        at = named(labels, "b", "component")
        hung = same.unionByName(copies.select(F.col("rep").alias("a"), F.col("rep").alias("b"))).join(at, "b", "left")
        alone = labels.join(copies.select(F.col("rep").alias("node")), "node", "left_anti")
        return scratch.save(hung.select(F.col("a").alias("node"), F.coalesce("component", "b").alias("component")).unionByName(alone), "whole")

    def named(df: DataFrame, *names: str) -> DataFrame:
        return df.select(*[F.col(c).alias(n) for c, n in zip(df.columns, names, strict=True)])

    if is_empty(members):
        return whole(components(same.limit(0), scratch))
    spokes = members.select(F.col("hub").alias("a"), F.col("id").alias("b"))
    few = members.where(F.col("many") < FEW)
    within = few.select("key", F.col("id").alias("a")).join(few.select("key", F.col("id").alias("b")), "key").where("a < b").select("a", "b")

    # Only members are compared; the rest of meta is not read again.
    ids = members.select("id").union(members.select("hub")).distinct()
    known = scratch.save(meta.join(ids, "id", "left_semi").select("id", "n", "sketch"), "known")
    sizes = known.select("id", "n")

    def cuts(pairs: DataFrame) -> DataFrame:
        ids = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "id")
        return scratch.save(fragments(ids), "fragments")

    def differences(pairs: DataFrame, cut: DataFrame) -> DataFrame:
        """pairs(a, b) by fragment: the elements that only a has (more) and that only b has (less)."""
        met = pairs.join(named(cut, "a", "part", "left"), "a").join(named(cut, "b", "part", "right"), ["b", "part"])
        more, less = F.array_except("left", "right"), F.array_except("right", "left")
        return scratch.save(met.select("a", "b", "part", more.alias("more"), less.alias("less")), "differences")

    def measured(deltas: DataFrame) -> DataFrame:
        """(a, b, na, nb, d, beyond, good): summed over fragments, beyond for a's alone, and whether the pair links."""
        total = deltas.groupBy("a", "b").agg(F.sum(F.size("more") + F.size("less")).alias("d"), F.sum(F.size("more")).alias("beyond"))
        total = total.join(named(sizes, "a", "na"), "a").join(named(sizes, "b", "nb"), "b")
        return total.withColumn("good", (100 + percent) * F.col("d") <= (100 - percent) * (F.col("na") + F.col("nb")))

    def verified(pairs: DataFrame, name: str, cut: DataFrame | None = None) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = pairs.join(named(known, "a", "na", "sa"), "a").join(named(known, "b", "nb", "sb"), "b")
        fit = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
        near = (100 + percent) * odd_bits("sa", "sb") <= (100 - percent) * (F.col("na") + F.col("nb"))
        pairs = scratch.save(pairs.where(fit).where(near).select("a", "b"), "pairs")
        if is_empty(pairs):
            return pairs
        mine = cuts(pairs) if cut is None else cut
        apart = differences(pairs, mine)
        good = scratch.save(measured(apart).where("good").select("a", "b"), name)
        scratch.drop(pairs, apart, *([mine] if cut is None else []))
        return good

    # Copies are in no key's members, so they hang on their smallest one in the end only.
    labels = components(verified(spokes.unionByName(within), "first"), scratch)

    def placed(df: DataFrame, node: str, name: str) -> DataFrame:
        at = df.join(named(labels, node, "at"), node, "left")
        return at.withColumn(name, F.coalesce("at", node)).drop("at")

    large = members.where(F.col("many") >= FEW)
    group = large.select("key", "id").unionByName(large.select("key", F.col("hub").alias("id")).distinct())
    group = scratch.save(placed(group, "id", "component"), "groups")
    scratch.drop(members)
    held = group.groupBy("key", "component").agg(F.count("*").alias("many"))
    held = held.groupBy("key").agg(
        F.max(F.struct("many", "component")).alias("top"), F.count("*").alias("several")
    )
    held = held.where("several > 1").select("key", F.col("top.component").alias("b"))
    open_spokes = group.join(held, "key").where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    open_spokes = scratch.save(open_spokes, "open")
    scratch.drop(group)
    if is_empty(open_spokes):
        return whole(labels)
    cut = cuts(open_spokes)
    deltas = differences(open_spokes, cut)
    far = 100 * (F.col("na") - F.col("beyond")) < percent * F.col("na")
    open_spokes = scratch.save(measured(deltas).withColumn("far", far), "tested")
    # By A - H whatever has a far side, by whole deltas the near ones among each other.
    # More than x = (|a| + k (|H| - |A|)) / 2 elements are common, k = (1 - J) / (1 + J): leave x of the most
    # frequent out, and a common element still remains.
    outside = F.floor(
        ((100 + percent) * F.col("d") + (100 - percent) * (F.col("nb") - F.col("na"))) / (2 * (100 + percent))
    )
    # And as d(A, B) <= m for the largest possible B, |b| >= |a| - m, and at least |a| - m elements are common.
    largest = F.floor((100 - percent) * (F.col("na") + F.floor(100 * F.col("na") / percent)) / (100 + percent))
    outside = F.greatest(outside, F.col("d") - largest - 1)
    # Beyond H a far one shares J |A| elements less those of H at least.
    least = F.ceil(percent * F.col("na") / 100) - (F.col("na") - F.col("beyond"))
    # Joined and listed once: the slices below read it many times.
    lists = deltas.groupBy("a", "b").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("more", "less")]).join(open_spokes, ["a", "b"])
    lists = lists.select(
        F.col("b").alias("hub"), F.col("a").alias("id"), F.col("na").alias("n"), "good", "far", "more", (F.col("beyond") - least + 1).alias("keep"),
        F.when(F.col("far"), F.array().cast("array<bigint>")).otherwise(F.concat("more", "less")).alias("delta"), (F.col("d") - outside).alias("keep_delta"),
    )
    rarity = scratch.spark.sparkContext.broadcast(slot_counts(cut))
    flagged = scratch.save(lists.mapInArrow(_listed(rarity), LISTED), "flagged")
    scratch.drop(deltas)
    # Only elements that some a counts on and some other b has.
    key = ["hub", "outer", "element"]
    parts = []
    for i in range(SLICES):
        part = flagged.where(F.pmod("element", F.lit(SLICES)) == i)
        seen = part.groupBy(*key).agg(F.count("*").alias("seen"), F.max("counts").alias("counts"), F.max("other").alias("other"))
        seen = scratch.save(seen.where("seen > 1 and counts and other").select(*key), "seen")
        parts.append(scratch.save(part.join(seen, key, "left_semi"), "shared"))
        scratch.drop(seen)
    both = scratch.save(reduce(DataFrame.unionByName, parts), "ranked")
    scratch.drop(flagged, *parts)
    # Those that link to the reference hang on it from here on; only the others are still to be met.
    labels = extended(labels, open_spokes.where("good").select("a", "b"), scratch)
    for turn in range(TURNS):
        # Below an element, all meet some of them, until what is left in several components makes few pairs.
        met = scratch.save(placed(both, "id", "component"), "turn")
        groups = met.groupBy(*key).agg(
            F.min("component").alias("lo"), F.max("component").alias("hi"), F.count_if("counts").alias("r"), F.count_if("other").alias("o"),
            F.array_distinct(F.array(*[F.min_by("id", F.struct(~F.col("other"), F.xxhash64("id", F.lit(i)))) for i in range(HUBS * turn, HUBS * turn + HUBS)])).alias("b"),
        )
        groups = scratch.save(groups.where("lo < hi and r > 0 and o > 0"), "crowds")
        load = groups.agg(F.sum(F.col("r") * F.col("o")), F.sum(F.col("r") + F.col("o"))).first()
        both = scratch.save(met.drop("component").join(groups.select(*key), key, "left_semi"), "left")
        if not load[0] or load[0] <= PAIRS * load[1]:
            break
        spoke = placed(placed(both.join(groups, key).select(F.col("id").alias("a"), F.explode("b").alias("b")).distinct(), "a", "ca"), "b", "cb")
        labels = extended(labels, verified(spoke.where("ca <> cb"), "turned", cut), scratch)
        scratch.drop(met, groups)
    # A linked pair's first common element leaves room for all elements that they must share.
    most = F.floor((100 - percent) * (F.col("na") + F.col("nb")) / (100 + percent))
    room = 2 * F.least("la", "lb") >= F.col("da") + F.col("db") - most
    fit = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    both = scratch.save(placed(both, "id", "component"), "last")
    values = ["id", "n", "d", "left", "component"]
    one = named(both.where("counts").select(*key, *values), *key, "a", "na", "da", "la", "ca")
    two = named(both.where("other").select(*key, *values), *key, "b", "nb", "db", "lb", "cb")
    one = one.join(two, key).where((F.col("ca") != F.col("cb")) & room & fit & (F.abs(F.col("da") - F.col("db")) <= most))
    return whole(extended(labels, verified(one.select("a", "b"), "rest", cut), scratch))
