"""Links between nodes that share buckets, and a filter for passes over whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.components import _contract, components
from palimpsest.llm.shared import Shipped, stash

#: Bits of a membership filter, at least and at most (64 MB).
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 29
#: Leaders of a bucket in each round.
LEADERS = (1, 8)
#: Nodes of a part of a bucket, about, and pairs that are sifted at once.
PART, SIFTING = 1024, 1 << 16
#: Nodes whose keys a task sorts at once, about, and keys that are dealt at once.
DEALT, HANDFUL = 25_000, 1 << 18
#: Rows, or bytes, that a task compares at once, about, and pairs that it joins at once.
ROWS, BYTES, JOINED = 30_000, 1 << 24, 1 << 18


def _stars(ranked: DataFrame, label: DataFrame | None, features: DataFrame, near: Callable[[Column, Column], Column], leaders: int, seed: int) -> DataFrame:
    """(a, b), a < b: the pairs of a bucket's leaders with its nodes of other components that are near. A bucket's nodes fall into as many
    parts as it has leaders, each led by the node that meets most, at seed 0, or by one that the seed draws: what meets most is often
    joined by a passage that many nodes have, and like none of them."""
    rows = ranked.withColumn("root", F.col("node")) if label is None else ranked.join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
    draw = F.xxhash64(F.lit(seed), "node")
    rank = F.struct(F.shiftright(draw, 8) if seed else F.col("meets"), "node", "root")
    best = F.array(*[F.max(F.when(F.pmod(draw, F.lit(leaders)) == i, rank)) for i in range(leaders)])
    lead = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.array_compact(best).alias("leads")).where("lo <> hi")
    lead = lead.select("key", F.explode("leads").alias("lead")).select("key", F.col("lead.node").alias("lead"), F.col("lead.root").alias("other"))
    pairs = rows.join(lead, "key").where("root <> other").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
    pairs = pairs.join(features.select(F.col("node").alias("a"), F.col("f").alias("x")), "a")
    return pairs.join(features.select(F.col("node").alias("b"), F.col("f").alias("y")), "b").where(near(F.col("x"), F.col("y"))).select("a", "b")


class Met:
    """A confirm() for grouped() that can also compare nodes where they meet, so that pairs that are no links leave no rows."""

    def __init__(self, pairs: Callable[[DataFrame], DataFrame], full: Callable[[DataFrame], DataFrame], sift: Callable, test: Callable, lists: DataFrame, rough: Callable, narrow: Callable[[DataFrame], DataFrame]):
        """pairs: as confirm(). full: from nodes to them and further columns. sift: of the columns of f (by name), a batch's last
        columns and places i and j in it, how far pairs are apart, about, and a number below 0 where they cannot be links; test: whether they are.
        lists: (node, keys, ...), repeats allowed, the further columns longs; rough: of these by name and places i and j, whether pairs may be
        links. narrow: features() of the nodes told, which are those of all later calls."""
        self.pairs, self.full, self.sift, self.test, self.lists, self.rough, self.narrow = pairs, full, sift, test, lists, rough, narrow

    def __call__(self, pairs: DataFrame) -> DataFrame:
        return self.pairs(pairs)


def _deal(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """(part, key, node, ...): of each part of the keys the columns' bytes; from (node, keys, ...)."""

    def packed(rows: list[np.ndarray]) -> pa.RecordBatch:
        cols = [np.concatenate(x) for x in zip(*rows, strict=True)]
        part = (cols[0].view(np.uint64) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
        order = np.argsort(part, kind="stable")
        part = part[order]
        at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        off = pa.py_buffer((np.append(at, len(part)) * 8).astype(np.int32))
        blobs = [pa.Array.from_buffers(pa.binary(), len(at), [None, off, pa.py_buffer(c[order])]) for c in cols]
        return pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int64)), *blobs], ["part", *(f"c{i}" for i in range(len(blobs)))])

    held, n = [], 0
    for batch in batches:
        own = pc.list_value_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
        key = batch.column(1).flatten().to_numpy()
        if len(key):
            held.append((key, *(np.repeat(c.to_numpy(), own) for i, c in enumerate(batch.columns) if i != 1)))
            n += len(key)
        if n >= HANDFUL:
            yield packed(held)
            held, n = [], 0
    if held:
        yield packed(held)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of each part, whose rows come together."""
    now, held = None, []
    for batch in batches:
        part = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
        for a, b in zip(edges, np.append(edges[1:], len(part)), strict=True):
            if held and part[a] != now:
                yield [np.frombuffer(b"".join(x), np.int64) for x in held]
                held = []
            now = part[a]
            held = held or [[] for _ in batch.columns[1:]]
            for into, c in zip(held, batch.columns[1:], strict=True):
                into.extend(c.slice(a, b - a).to_pylist())
    if held:
        yield [np.frombuffer(b"".join(x), np.int64) for x in held]


def _pairs(after: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i < j of the rows of one group, about SIFTING at a time; after: how many of a row's group follow it."""
    done, a = np.cumsum(after), 0
    while a < len(after):
        b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + SIFTING, "right")))
        i = np.repeat(np.arange(a, b), after[a:b])
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after[a:b]) - after[a:b], after[a:b])
        a = b


def _meeting(lists: DataFrame, rough: Callable, name: str) -> DataFrame:
    """(key, node, c): the nodes of keys that c nodes have, without those that can be linked with no other of a bucket of PART nodes at most."""
    parts, names = lists.count() // DEALT + 1, [c for c in lists.columns if c not in ("node", "keys")]
    most = PART

    def met(batches):
        for key, node, *more in _gathered(batches):
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            once = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
            key, node, order = key[once], node[once], order[once]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            c = np.diff(np.append(first, len(key)))
            c, last = np.repeat(c, c), np.repeat(first + c, c)
            pick = np.flatnonzero(c > 1)
            key, node, c, col = key[pick], node[pick], c[pick], {x: y[order[pick]] for x, y in zip(names, more, strict=True)}
            keep = c > most
            for i, j in _pairs(np.where(keep, 0, last[pick] - pick - 1)):
                on = rough(col, i, j)
                keep[i[on]] = keep[j[on]] = True
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, node, c)], ["key", "node", "c"])

    columns = ", ".join(f"c{i} binary" for i in range(len(names) + 2))
    dealt = lists.select("node", "keys", *names).mapInArrow(lambda batches: _deal(batches, parts), f"part long, {columns}")
    return stash(dealt.repartition("part").sortWithinPartitions("part").mapInArrow(met, "key long, node long, c long"), f"{name}-buckets")


def _links(batches: Iterator[pa.RecordBatch], sift: Callable, test: Callable) -> Iterator[pa.RecordBatch]:
    """(a, b) that are links, of rows (zone, key, lo, hi, part, node, root, keys, ...) that come by zone, key, lo and hi. Rows of a zone are
    compared at once if they are not too many, those of a key, lo and hi always."""
    held, n, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        n, size = n + len(batch), size + batch.nbytes
        if n < ROWS and size < BYTES:
            continue
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        new = [np.diff(rows.column(k).to_numpy()) != 0 for k in range(4)]
        cut = 0
        for edges in (new[0], new[0] | new[1] | new[2] | new[3]):
            cut = cut or int(np.flatnonzero(edges)[-1]) + 1 if edges.any() else cut
        if cut:  # the last group may go on
            yield from _compared(rows.slice(0, cut), sift, test)
        rest = rows.slice(cut)
        held, n, size = [rest], len(rest), rest.nbytes
    if n:
        yield from _compared(pa.Table.from_batches(held).combine_chunks().to_batches()[0], sift, test)


def _joining(i: np.ndarray, j: np.ndarray, apart: np.ndarray, team: np.ndarray, test: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among the pairs i, j that join all teams that any of them joins; team: a number for each place, changed as links join them.
    In rounds, each team's closest pairs are tested, ever more of them; pairs that earlier links have brought into one team are not."""
    most = 1
    while True:
        left = team[i] != team[j]
        i, j, apart = i[left], j[left], apart[left]
        if not len(i):
            return
        side = np.concatenate([team[i], team[j]])
        order = np.lexsort((np.concatenate([apart, apart]), side))
        first = np.flatnonzero(np.append(True, np.diff(side[order]) != 0))
        rank = np.empty(len(side), np.int64)
        rank[order] = np.arange(len(side)) - np.repeat(first, np.diff(np.append(first, len(side))))
        now = np.minimum(rank[: len(i)], rank[len(i) :]) < most
        p, q = i[now], j[now]
        linked = test(p, q)
        p, q = p[linked], q[linked]
        if len(p):
            yield p, q
            moved, to = _contract(team[p], team[q])
            at = np.minimum(np.searchsorted(moved, team), len(moved) - 1)
            team[:] = np.where(moved[at] == team, to[at], team)
        i, j, apart = i[~now], j[~now], apart[~now]
        most *= 2


def _compared(rows: pa.RecordBatch, sift: Callable, test: Callable) -> Iterator[pa.RecordBatch]:
    col = {name: rows.column(name) for name in rows.schema.names}
    key, lo, hi, part, node, root = (col[c].to_numpy() for c in ("key", "lo", "hi", "part", "node", "root"))
    own = pc.list_value_length(col["keys"]).to_numpy(zero_copy_only=False)
    keys = np.zeros((len(node), max(1, int(own.max()))), np.int64)
    inside = np.arange(keys.shape[1]) < own[:, None]
    keys[inside] = col["keys"].flatten().to_numpy()
    new = np.append(True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))
    first = np.flatnonzero(new)
    after = np.repeat(np.append(first[1:], len(key)), np.diff(np.append(first, len(key)))) - np.arange(len(key)) - 1
    team = np.unique(root, return_inverse=True)[1]

    def joined(found: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for p, q in _joining(*map(np.concatenate, zip(*found, strict=True)), team, lambda p, q: test(col, p, q)):
            yield pa.RecordBatch.from_arrays([pa.array(node[p]), pa.array(node[q])], ["a", "b"])

    found, n = [], 0
    for i, j in _pairs(after):
        keep = (team[i] != team[j]) & ((lo[i] == hi[i]) | (part[i] != part[j]))
        i, j = i[keep], j[keep]
        apart = sift(col, i, j)
        keep = apart >= 0
        i, j, apart = i[keep], j[keep], apart[keep]
        once = np.zeros(len(i), bool)
        for x in range(0, len(i), 4096):  # only under the least key that both have
            p, q = i[x : x + 4096], j[x : x + 4096]
            both = (keys[p][:, :, None] == keys[q][:, None, :]) & inside[p][:, :, None] & inside[q][:, None, :]
            once[x : x + 4096] = np.where(both.any(axis=2), keys[p], (1 << 63) - 1).min(axis=1) == key[p]
        found.append([x[once] for x in (i, j, apart)])
        n += int(once.sum())
        if n >= JOINED:
            yield from joined(found)
            found, n = [], 0
    if n:
        yield from joined(found)


def _met(member: DataFrame, label: DataFrame, features: DataFrame, confirm: Met, name: str) -> DataFrame:
    """(a, b): the links of nodes of one bucket and different components. A bucket is cut by a hash into parts of about PART nodes; a
    task compares the nodes of two parts, so a large bucket is dealt over many tasks and its rows grow with the number of its parts. Other
    buckets go by zones, the least key of any of their nodes: those of near copies come together, whose links are then found once."""
    sift, test = confirm.sift, confirm.test
    within = member.select("key", "node").join(label, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = within.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    mixed = mixed.select("key", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    within = within.join(mixed, "key")
    zones = within.join(within.groupBy("node").agg(F.min("key").alias("least")), "node").groupBy("key").agg(F.min("least").alias("least"))
    within = within.join(zones, "key").withColumn("zone", F.when(F.col("parts") > 1, F.col("key")).otherwise(F.col("least")))
    mine = within.groupBy("node").agg(F.max("root").alias("root"), F.collect_list(F.struct("zone", "key", "parts")).alias("in"))
    mine = stash(mine, f"{name}-mixed")
    item = mine.join(features, "node").join(confirm.full(mine.select("node")), "node").withColumn("keys", F.col("in.key"))
    more = [F.col(f"f.{c}") for c in features.schema["f"].dataType.names] + [F.col(c) for c in item.columns if c not in ("node", "root", "in", "f", "keys")]
    item = item.withColumn("at", F.explode("in")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("at.parts")).cast("int"))
    item = item.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("at.parts") - 1)))
    item = item.select(F.col("at.zone").alias("zone"), F.col("at.key").alias("key"), F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "node", "root", "keys", *more)
    return item.repartition("zone", "lo", "hi").sortWithinPartitions("zone", "key", "lo", "hi").mapInArrow(lambda batches: _links(batches, sift, test), "a long, b long")


def grouped(member: DataFrame, features: DataFrame, near: Callable[[Column, Column], Column], confirm: Callable[[DataFrame], DataFrame], name: str, held: tuple[Callable[[DataFrame], DataFrame], Callable[[Column, Column], Column]] | None = None, keys: tuple[DataFrame, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """Components of nodes over confirmed links: (node, root) of the nodes that have a link.

    member: (key, node), repeats allowed; only nodes of one key are compared. features: (node, f), a struct that near() compares,
    cheaply; confirm() takes pairs (a, b) and returns those that are links. In rounds, nodes of each bucket that holds several
    components are compared with leaders in it: as many pairs as LEADERS says for each row, whatever the bucket's size. Last, where a bucket still holds several components, nodes of different ones are
    compared with each other. Within a component no further link is looked for.
    Buckets are joined, never dealt by hand, so that Spark splits a large one over tasks.

    held: a function from nodes to (node, full), and the test of two such values. The last comparison then makes that test where it
    meets the nodes, and gives out links alone: a large group whose members are alike, but not enough, would leave pairs by the
    square of its size to confirm. A Met as confirm() does so in numpy, by parts of buckets, finds the buckets itself, and has leaders only
    in those of more than PART nodes; what it tests joins the same components, but pairs joined already are passed over. keys: (node, g), g holding all keys of a node, and the first key that two such values share,
    so that two nodes that meet often are compared once.
    """
    if isinstance(confirm, Met):
        member = _meeting(confirm.lists, confirm.rough, name)
        features = confirm.narrow(member.select("node").distinct())
        led = member.where(F.col("c") > PART)  # smaller buckets are compared in one task each
    else:
        shared = member.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key", "c")
        member = stash(member.join(shared, "key").groupBy("key", "node").agg(F.max("c").alias("c")), f"{name}-buckets")  # only nodes that meet another
        led = member
    meets = led.groupBy("node").agg(F.sum("c").alias("meets"))
    ranked = led.select("key", "node").join(meets, "node")
    label = None
    for seed, leaders in enumerate(LEADERS):
        pairs = stash(_stars(ranked, label, features, near, leaders, seed), f"{name}-pairs")
        links = stash(confirm(pairs), f"{name}-links")
        known = links if label is None else links.unionByName(label.select(F.col("node").alias("a"), F.col("root").alias("b")))
        label = stash(components(known), f"{name}-joined")
    if isinstance(confirm, Met):
        return components(label.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(stash(_met(member, label, features, confirm, name), f"{name}-links")))
    within = member.select("key", "node").join(label, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = within.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    within = within.join(mixed, "key").join(features, "node")
    once = test = F.lit(True)
    if keys:
        within = within.join(keys[0], "node")
        once = F.col("key") == keys[1](F.col("g"), F.col("h"))
    else:
        within = within.withColumn("g", F.lit(None).cast("long"))
    if held:
        within = stash(within, f"{name}-mixed")
        full = stash(held[0](within.select("node").distinct()), f"{name}-full")
        within = within.join(full, "node")
        test = held[1](F.col("s"), F.col("t"))
    else:
        within = within.withColumn("full", F.lit(None).cast("long"))
    a = within.select("key", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("f").alias("x"), F.col("full").alias("s"), "g")
    b = within.select(F.col("key").alias("key2"), F.col("node").alias("b"), F.col("root").alias("rb"), F.col("f").alias("y"), F.col("full").alias("t"), F.col("g").alias("h"))
    cross = a.join(b, (F.col("key") == F.col("key2")) & (F.col("ra") < F.col("rb")) & once & near(F.col("x"), F.col("y")) & test)
    cross = stash(cross.select("a", "b").distinct(), f"{name}-pairs")
    if not cross.head(1):
        return label
    more = cross if held else stash(confirm(cross), f"{name}-links")
    return components(label.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def _places(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = x.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(32) & np.uint64(bits - 1)).astype(np.int64), ((h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32) & np.uint64(bits - 1)).astype(np.int64)


class Filter:
    """Whether a number may be among those told: sometimes yes wrongly, never no wrongly."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for p in _places(x, len(self.bits) * 8):
            out &= (self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
        return out


def membership(ids: DataFrame, count: int | None = None, number: Callable[..., np.ndarray] | None = None) -> Shipped:
    """A Filter of a long column, or of the numbers that a function makes of all columns, none null, in the same worker; built where the rows
    are and shipped: 16 bits a row, rounded up to a power of two, and MOST_BITS at most. Beyond that many rows it lets more strangers pass, which callers drop by a join; it never loses a row."""
    column = ids.columns[0]
    ids = ids.where(F.col(column).isNotNull())
    size = LEAST_BITS
    while size < min(MOST_BITS, 16 * (ids.count() if count is None else count)):
        size *= 2

    def run(batches):
        for batch in batches:
            col = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            p = np.concatenate(_places(number(*col) if number else col[0], size))
            cell, bit = p >> 6, np.uint64(1) << (p & 63).astype(np.uint64)
            u, inv = np.unique(cell, return_inverse=True)
            bits = np.zeros(len(u), np.uint64)
            np.bitwise_or.at(bits, inv, bit)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(bits.view(np.int64))], ["cell", "bits"])

    cells = ids.mapInArrow(run, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    got = cells.toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[got.column("cell").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return Shipped(ids.sparkSession, Filter(bits.view(np.uint8)))
