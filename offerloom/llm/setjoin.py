"""Verified links between sets of hashes: a blocked sparse product of the sets' incidence matrix within candidate groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: A block holds about so many sets and so many members of sets at most (or one larger set).
BLOCK_SETS, BLOCK_MEMBERS = 500, 3_000_000
#: Pairs of a block of columns of the incidence matrix that are written out at once, about.
PAIRS = 1 << 21


#: Sets of up to so many members have a parity signature of so many bits: bit h % bits is flipped for each member h.
#: Bits in which two sets' signatures differ are at most the members that only one of them has. A longer signature
#: folds to a shorter one, so any two can be compared.
SIGNATURES = ((800, 512), (6400, 4096), (1 << 62, 32768))
#: Buckets of up to so many sets are compared together, larger ones one by one.
SMALL_BUCKET = 16
#: A key of more sets is compared in blocks of sets.
HOT_KEY = 20_000


def signature(h: np.ndarray) -> bytes:
    bits = next(b for most, b in SIGNATURES if len(h) <= most)
    out = np.zeros(bits, np.uint8)
    np.bitwise_xor.at(out, (h % np.uint64(bits)).astype(np.int64), 1)
    return np.packbits(out, bitorder="little").tobytes()


def signatures(h: np.ndarray, begins: np.ndarray) -> list[bytes]:
    """The signature of each set h[begins[i]:begins[i + 1]]."""
    n = np.diff(begins)
    out: list = [b""] * len(n)
    low = 0
    for most, bits in SIGNATURES:
        own = np.flatnonzero((n > low) & (n <= most))
        low = most
        for at in range(0, len(own), max(1, (1 << 20) // bits)):
            part = own[at : at + max(1, (1 << 20) // bits)]
            rows = np.repeat(np.arange(len(part)), n[part])
            members = np.concatenate([h[begins[i] : begins[i + 1]] for i in part]) % np.uint64(bits)
            flips = np.bincount(rows * bits + members.astype(np.int64), minlength=len(part) * bits) & 1
            packed = np.packbits(flips.astype(np.uint8).reshape(len(part), bits), axis=1, bitorder="little")
            for k, i in enumerate(part):
                out[i] = packed[k].tobytes()
    return out


def _folded(sigs: list[bytes], bits: int) -> np.ndarray:
    """(sets, words) of signatures folded to bits."""
    out = np.zeros((len(sigs), bits // 64), np.uint64)
    for i, x in enumerate(sigs):
        a = np.frombuffer(x, "<u8")
        out[i] = np.bitwise_xor.reduce(a.reshape(-1, bits // 64), axis=0)
    return out


def _close(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets may have a Jaccard of percent or more: of the differing members at most this share is allowed."""
    differ = np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)
    return (differ * (100 + percent) <= (n + m) * (100 - percent)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def close_sets(node: np.ndarray, n: np.ndarray, sigs: list[bytes], side: np.ndarray, bucket: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges that join those sets of each bucket (ascending) which the signatures don't tell apart."""
    out: list[tuple[int, int]] = []
    low = 0
    for most, bits in SIGNATURES:
        here = np.flatnonzero((n > low) & (n * percent <= 100 * most))
        low = most
        if len(here) < 2:
            continue
        b = bucket[here]
        begin = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        size = np.diff(np.append(begin, len(b)))
        if (size < 2).all():
            continue
        words = _folded([sigs[i] for i in here], bits)
        m = n[here]
        small = np.flatnonzero((size > 1) & (size <= SMALL_BUCKET))
        for k in range(2, SMALL_BUCKET + 1):
            of = begin[small[size[small] == k]]
            for i, j in zip(*np.triu_indices(k, 1)) if len(of) else ():
                x, y = of + i, of + j
                ok = _close(words[x], words[y], m[x], m[y], percent) & ~((side[here[x]] == side[here[y]]) & (side[here[x]] > 0))
                out += zip(node[here[x[ok]]].tolist(), node[here[y[ok]]].tolist())
        for g in np.flatnonzero(size > SMALL_BUCKET):
            left = np.arange(begin[g], begin[g] + size[g])
            while len(left):  # from one set on, all that can be reached among those not yet reached
                front, left = left[:1], left[1:]
                while len(front) and len(left):
                    at, front = front[0], front[1:]
                    ok = _close(words[left], words[at], m[left], m[at], percent) & ~((side[here[left]] == side[here[at]]) & (side[here[at]] > 0))
                    out += zip(node[here[left[ok]]].tolist(), [int(node[here[at]])] * int(ok.sum()))
                    front, left = np.concatenate((front, left[ok])), left[~ok]
    return out


#: Rows of one key that a task holds; a key of more is emitted as hot without a look at its sizes.
HELD_ROWS = 1_000_000
#: Postings of frequent keys are dealt by so many salts, which the lower SALT_BITS of m hold (0: not salted).
SALTS, SALT_BITS = 64, 7


#: Keys are counted in so many bins to tell which are frequent.
LOAD_BINS = 1 << 16


def salted(postings: DataFrame) -> DataFrame:
    """(h, node, m), as shared_keys takes them, of postings (h, node, n): keys of crowded bins are salted by node.

    A bin is crowded if it holds HELD_ROWS more than twice the mean, so a key that is much for a task is in one. Bins are
    summed up before they are dealt; the driver gets LOAD_BINS counts at most, and the crowded bins' numbers are sent.
    """
    spark, name = postings.sparkSession, F.pmod("h", F.lit(LOAD_BINS))
    loads = postings.groupBy(name.alias("bin")).agg(F.count("*").alias("rows")).collect()
    most = 2 * sum(r["rows"] for r in loads) / LOAD_BINS + HELD_ROWS
    crowded = spark.createDataFrame([(r["bin"],) for r in loads if r["rows"] > most], "bin long")
    marked = postings.withColumn("bin", name).join(F.broadcast(crowded.withColumn("crowded", F.lit(True))), "bin", "left")
    salt = F.when(F.col("crowded"), F.pmod("node", F.lit(SALTS)) + 1).otherwise(0)
    return marked.select("h", "node", F.shiftleft("n", SALT_BITS).bitwiseOR(salt).alias("m"))


def shared_keys(postings: DataFrame, percent: int) -> DataFrame:
    """(h, node, n, df) from postings (h, node, m = n << SALT_BITS | salt): nodes with a partner of fitting size under h.

    One exchange, in which frequent keys are salted. Where a key is whole in a task, nodes without a partner whose
    size allows a Jaccard of percent go, and df is its number of nodes; a salted key has all its nodes and df 0.
    """

    def fitting(h, node, m):
        fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])))
        h, node, n, salted = h[fresh], node[fresh], m[fresh] >> SALT_BITS, (m[fresh] & ((1 << SALT_BITS) - 1)) > 0
        owner = np.cumsum(np.concatenate(([True], h[1:] != h[:-1]))) - 1
        df = np.bincount(owner)[owner]
        some = (df > 1) | salted
        h, node, n, salted, owner, df = (x[some] for x in (h, node, n, salted, owner, df))
        order = np.lexsort((n, owner))
        o, s = owner[order], n[order]
        near = (o[1:] == o[:-1]) & (100 * s[:-1] >= percent * s[1:])
        keep = np.zeros(len(h), bool)
        keep[order[1:]] |= near
        keep[order[:-1]] |= near
        keep |= salted
        return [x[keep] for x in (h, node, n, np.where(salted, 0, df))]

    def out(columns):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "node", "n", "df"])

    def run(batches):
        held, rows, hot = [], 0, None
        for batch in batches:
            part = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if hot is not None:
                at = int(np.searchsorted(part[0], hot, side="right"))
                if at:
                    yield out([part[0][:at], part[1][:at], part[2][:at] >> SALT_BITS, np.full(at, 1 << 40)])
                    part = [x[at:] for x in part]
                hot = hot if not len(part[0]) else None
            if not len(part[0]):
                continue
            held.append(part)
            rows += len(part[0])
            if rows < 50_000:
                continue
            h, node, m = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield out(fitting(h[:cut], node[:cut], m[:cut]))
            h, node, m = h[cut:], node[cut:], m[cut:]
            if len(h) > HELD_ROWS and not m[0] & ((1 << SALT_BITS) - 1):
                hot = h[0]
                yield out([h, node, m >> SALT_BITS, np.full(len(h), 1 << 40)])
                held, rows = [], 0
            elif len(h) > HELD_ROWS:
                yield out(fitting(h, node, m))  # salted: each row stands for itself
                held, rows = [], 0
            else:
                held, rows = [[h, node, m]], len(h)
        if held:
            yield out(fitting(*(np.concatenate(x) for x in zip(*held))))

    salt = F.col("m").bitwiseAND((1 << SALT_BITS) - 1)
    return postings.select("h", "node", "m").repartition("h", salt).sortWithinPartitions("h", "node").mapInArrow(run, "h long, node long, n long, df long")


#: A linked set of n members has 1 + n // SHARE keys or more in common with each set it is linked with.
SHARE = 32


def key_count(n, percent: int):
    """So many keys, the first ones in the order of all, a set of n members gives.

    Two sets with a Jaccard of percent or more have that share of the larger one's members in common. The first
    k = 1 + n // SHARE of these, for the smaller set's n, are among the first n - ceil(percent n / 100) + k of each.
    """
    return n - (percent * n + 99) // 100 + 1 + n // SHARE


def close_edges(postings: DataFrame, nodes: DataFrame, folder: str, percent: int = 80, by_count: bool = False) -> DataFrame:
    """Edges (u, v) between nodes (node, n, sig) that share a key and may be linked by their sizes and signatures.

    All linked pairs that share a key are connected by these edges, directly or over others. postings are those of
    shared_keys. by_count says that they are key_count keys of each set: sets that share fewer than a link takes go. A key
    of more than HOT_KEY nodes is split into pairs of blocks. What is written on the way is put into folder.
    """
    shared = stored(shared_keys(postings, percent), "shared-keys", folder, compression="zstd")
    salted = shared.where("df = 0").select("h", "node", "n").distinct()
    counts = salted.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    shared = shared.where("df > 0").unionByName(salted.join(counts, "h").select("h", "node", "n", "df"))
    if by_count:
        fewest = 1 + F.floor(F.floor((F.col("n") * percent + 99) / 100) / SHARE)  # that the smallest set it may be linked with needs
        shared = shared.join(shared.groupBy("node").agg(F.count("*").alias("keys"), F.min("n").alias("n")).where(F.col("keys") >= fewest).select("node"), "node", "left_semi")
    sigs = nodes.select("node", "sig")
    cool = shared.where(F.col("df") <= HOT_KEY).join(sigs, "node").select(F.col("h").cast("string").alias("group"), F.lit(0).alias("side"), "node", "n", "sig")
    hot = shared.where(F.col("df") > HOT_KEY).select(F.col("h").alias("comp"), "node", "n", F.lit(1).alias("copies")).dropDuplicates(["comp", "node"])
    blocked = with_blocks(hot, sets=HOT_KEY // 2).join(sigs, "node").select("group", "side", "node", "n", "sig")

    def run(batches):
        held: list = []

        def work(rows):
            if not rows:
                return None
            node, n, side = (np.array([r[k] for r in rows], np.int64) for k in (2, 3, 1))
            names = {g: i for i, g in enumerate(dict.fromkeys(r[0] for r in rows))}
            edges = list(dict.fromkeys(close_sets(node, n, [r[4] for r in rows], side, np.array([names[r[0]] for r in rows]), percent)))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges)], names=["u", "v"]) if edges else None

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            if len(held) > 20_000:
                last = held[-1][0]
                cut = next((i for i in range(len(held) - 1, -1, -1) if held[i][0] != last), -1) + 1
                if cut and (out := work(held[:cut])):
                    yield out
                held = held[cut:]
        if out := work(held):
            yield out

    dealt = cool.unionByName(blocked).repartition("group").sortWithinPartitions("group", "node").select("group", "side", "node", "n", "sig")
    return dealt.mapInArrow(run, "u long, v long").where("u <> v").distinct()


def with_blocks(nodes: DataFrame, sets: int = BLOCK_SETS) -> DataFrame:
    """(comp, node, n, copies) with the blocks it is compared in: group, side (0 both, 1 left, 2 right).

    A small component is one group. In a larger one sets are dealt into size classes, each 5/4 of the one before,
    and by hash into blocks; linked sets are in the same or in neighbouring classes, so each pair of blocks of such
    classes is a group. No component, however large, has to fit into one task.
    """
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)) + 1e-9)
    sized = nodes.withColumn("level", level)
    per = sized.groupBy("comp", "level").agg(F.count("*").alias("sets"), F.sum("n").alias("members"))
    whole = per.groupBy("comp").agg(F.sum("sets").alias("all_sets"), F.sum("members").alias("all_members"))
    small = (F.col("all_sets") <= sets) & (F.col("all_members") <= BLOCK_MEMBERS)
    one = whole.where(small).select("comp").withColumn("one", F.lit(True))
    counts = per.join(whole.where(~small).select("comp"), "comp", "left_semi").withColumn("blocks", F.greatest(F.ceil(F.col("sets") / sets), F.ceil(F.col("members") / BLOCK_MEMBERS)))
    around = counts.select("comp", F.col("level").alias("l"), "blocks").withColumn("level", F.explode(F.array(F.col("l") - 1, F.col("l"), F.col("l") + 1)))
    near = around.groupBy("comp", "level").agg(F.sum(F.when(F.col("l") == F.col("level"), F.col("blocks")).otherwise(0)).alias("own"), F.sum(F.when(F.col("l") < F.col("level"), F.col("blocks")).otherwise(0)).alias("below"), F.sum(F.when(F.col("l") > F.col("level"), F.col("blocks")).otherwise(0)).alias("above")).where("own > 0")
    singles = sized.join(one, "comp").select("comp", "node", "n", "copies", F.concat_ws("/", "comp").alias("group"), F.lit(0).alias("side"))
    b = F.pmod(F.xxhash64("node"), F.col("own"))

    def name(level, x, other, y):
        return F.concat_ws("/", "comp", level, x, other, y)

    def upto(n, f):
        return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), f)).otherwise(F.array().cast("array<struct<group:string,side:int>>"))

    def part(group, side):
        return F.struct(group.alias("group"), side.cast("int").alias("side"))

    lv = F.col("level")
    pairs = F.concat(
        upto(F.col("own"), lambda x: part(name(lv, F.least(F.col("b"), x), lv, F.greatest(F.col("b"), x)), F.when(F.col("b") == x, 0).when(F.col("b") < x, 1).otherwise(2))),
        upto(F.col("above"), lambda x: part(name(lv, F.col("b"), lv + 1, x), F.lit(1))),
        upto(F.col("below"), lambda x: part(name(lv - 1, x, lv, F.col("b")), F.lit(2))),
    )
    blocks = sized.join(near, ["comp", "level"]).withColumn("b", b).select("comp", "node", "n", "copies", F.explode(pairs).alias("p")).select("comp", "node", "n", "copies", "p.group", "p.side")
    return singles.unionByName(blocks)


def _pairs(c: np.ndarray, i: np.ndarray, d: np.ndarray, j: np.ndarray, columns: int, shape: tuple[int, int]) -> np.ndarray:
    """The sum of the sparse product of entries (column c, row i) and (column d, row j), both ascending by column."""
    times = np.bincount(d, minlength=columns)
    begins = np.cumsum(times) - times
    n = times[c]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins[c], n)
    return np.bincount(np.repeat(i, n) * shape[1] + j[at], minlength=shape[0] * shape[1]).reshape(shape)


def _absent(c: np.ndarray, i: np.ndarray, columns: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The entries (column, row) that are not among (c, i)."""
    gone = np.ones((columns, rows), bool)
    gone[c, i] = False
    return np.nonzero(gone)


def linked(sets: list[np.ndarray], side: np.ndarray, percent: int = 80) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The links of a group: which pairs (a matrix of left and right sets) have a Jaccard of percent or more.

    A sparse product of the incidence matrix with itself: for each column the pairs of sets that have it are written out
    and counted. Of a column that most sets have, as near copies do, the pairs of sets that lack it are, as
    x y = 1 - (1 - x) - (1 - y) + (1 - x)(1 - y). The counts are summed up over blocks of columns, rare ones first, of
    about PAIRS pairs each. A pair is discarded as soon as its sum and the members that are still to come, of the set that
    has fewer of them, are below what its sizes ask for; sets without a pair left are skipped.
    """
    left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
    shape = (len(left), len(right))
    n = np.array([len(s) for s in sets], np.int64)
    a, b = n[left][:, None], n[right][None]
    need = -(-percent * (a + b) // (100 + percent))
    alive = (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (left[:, None] != right[None])
    owner = np.repeat(np.arange(len(sets)), n)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rare_first = np.flatnonzero(times > 1)[np.argsort(times[times > 1], kind="stable")]  # a column of one set adds to no intersection
    place = np.full(len(times), -1)
    place[rare_first] = np.arange(len(rare_first))
    column = place[column]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    rest = np.bincount(owner, minlength=len(sets))
    alive &= np.minimum(rest[left][:, None], rest[right][None]) >= need
    total = np.zeros(shape, np.int64)
    at_left, at_right = np.full(len(sets), -1), np.full(len(sets), -1)
    at_left[left], at_right[right] = np.arange(shape[0]), np.arange(shape[1])
    in_left, in_right = (np.bincount(column[at[owner] >= 0], minlength=len(rare_first)) for at in (at_left, at_right))
    work, lacking = in_left * in_right, (shape[0] - in_left) * (shape[1] - in_right)
    by_lack = lacking < work
    sum_before = np.cumsum(np.minimum(work, lacking))
    cuts = np.searchsorted(sum_before, np.arange(1, sum_before[-1] // PAIRS + 1) * PAIRS, side="left") + 1 if len(sum_before) else []
    bounds = np.unique(np.concatenate(([0], cuts, [len(rare_first)]))).astype(np.int64)
    for begin, end in zip(bounds, bounds[1:]):
        if not alive.any():
            break
        lo, hi = np.searchsorted(column, (begin, end))
        o, c = owner[lo:hi], column[lo:hi] - begin
        rest = rest - np.bincount(o, minlength=len(sets))
        some_left, some_right = alive.any(axis=1), alive.any(axis=0)
        for lack in (False, True):
            mine = np.flatnonzero(by_lack[begin:end] == lack)
            if not len(mine):
                continue
            number = np.full(end - begin, -1)
            number[mine] = np.arange(len(mine))
            own = number[c] >= 0
            k, who = number[c[own]], owner[lo:hi][own]
            i, j = at_left[who], at_right[who]
            x, y = (k[i >= 0], i[i >= 0]), (k[j >= 0], j[j >= 0])
            if lack:
                x, y = _absent(*x, len(mine), shape[0]), _absent(*y, len(mine), shape[1])
                total += len(mine) - np.bincount(x[1], minlength=shape[0])[:, None] - np.bincount(y[1], minlength=shape[1])[None]
            (kx, ix), (ky, iy) = ((q[r[w]], w[r[w]]) for (q, w), r in ((x, some_left), (y, some_right)))
            total += _pairs(kx, ix, ky, iy, len(mine), shape)
        alive &= total + np.minimum(rest[left][:, None], rest[right][None]) >= need
    return left, right, alive & (total >= need)


def roots(m: int, left: np.ndarray, right: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """The first set of each set's component within a group."""
    where_left, where_right = np.full(m, -1), np.full(m, -1)
    where_left[left], where_right[right] = np.arange(len(left)), np.arange(len(right))
    root = np.full(m, -1)
    for first in range(m):
        if root[first] >= 0:
            continue
        root[first] = first
        front = np.array([first])
        while len(front):
            reach = np.zeros(m, bool)
            rows, columns = where_left[front], where_right[front]
            reach[right[ok[rows[rows >= 0]].any(axis=0)]] = True
            reach[left[ok[:, columns[columns >= 0]].any(axis=1)]] = True
            front = np.flatnonzero(reach & (root < 0))
            root[front] = first
    return root


#: Bits of the filter by which texts that no group needs are left out early; a fuller filter lets more pass.
FILTER_BITS = 1 << 23


def wanted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The (id, text) of docs whose id may be one of ids, by a filter of FILTER_BITS bits, before they are dealt."""
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words = ids.select(F.floor(bit / 32).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(32)).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bitmap = np.zeros(FILTER_BITS // 32, np.uint32)
    bitmap[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).astype(np.uint32)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for batch in batches:
            at = batch.column("bit").to_numpy(zero_copy_only=False).astype(np.int64)
            some = (sent.value[at // 32] >> (at % 32).astype(np.uint32)) & 1
            yield batch.filter(pa.array(some.astype(bool))).select(["id", "text"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text", bit.alias("bit")).mapInArrow(run, f"id {kind}, text string")


def verified(rows: DataFrame, sets_of, percent: int = 80) -> DataFrame:
    """(u, v, links) from rows (group, side, node, copies, text); sets_of gives the sets of a list of texts.

    v is the first node of u's component within the group, links the documents that u is linked with there. Rows
    are dealt and sorted by group; a task holds one group at a time, of two blocks at most.
    """

    def groups(batches) -> Iterator[list]:
        held, key = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != key and held:
                    yield held
                    held = []
                key = row[0]
                if not held or held[-1][2] != row[2]:  # a text that is there twice counts once
                    held.append(row)
        if held:
            yield held

    def check(batches):
        out: list[tuple] = []
        for group in groups(batches):
            if len(group) > 1:
                nodes, copies = np.array([r[2] for r in group], np.int64), np.array([r[3] for r in group], np.int64)
                left, right, ok = linked(sets_of([r[4] for r in group]), np.array([r[1] for r in group]), percent)
                links = np.zeros(len(group), np.int64)
                links[left] = ok @ copies[right]
                if len(left) < len(group) or len(right) < len(group):
                    links[right] = copies[left] @ ok
                first = roots(len(group), left, right, ok)
                some = np.flatnonzero(links)
                out += zip(nodes[some].tolist(), nodes[first[some]].tolist(), links[some].tolist())
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["u", "v", "links"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["u", "v", "links"])

    dealt = rows.select("group", "side", "node", "copies", "text").repartition("group").sortWithinPartitions("group", "node")
    return dealt.mapInArrow(check, "u long, v long, links long")
