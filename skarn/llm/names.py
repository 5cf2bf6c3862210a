"""Names within an edit distance of two of each other: a join on anagram keys.

The key of a name is the multiset of its letters, which does not change when letters change places. An insertion, a
deletion and a substitution change it by one letter on either side at most, so names within distance `most` have a
multiset in common once up to `most` letters are taken from each. Each distinct name emits the key of every multiset that
is left over, with the letters taken; keys meet in an equi-join. Of all keys that two names share, just one is taken
for them: the one where no letter was taken from both. What has met is verified in order, with a bit-parallel distance.

Keys of multisets in which far more pairs would meet than there are names on both sides (anagrams of one another by the
thousands) are left to a second join, on the letters left in their order as well: names within the distance still share
such a key, and names with the same letters in another order do not meet.

Names are joined as distinct texts with what is known of their rows summed up first, so a name that a third of all rows
have is one row. Nothing is collected or broadcast.

The distance is optimal string alignment: insertions, deletions and substitutions of a code point and exchanges of two
neighbouring ones, none of which is edited again.

Defined results: null and empty names take no part; repeated rows count each; null ids are counted, are no first id and
add nothing to the sums; other columns are ignored; an empty table gives an empty result. A name may be of any length:
its keys grow with the square of its distinct letters, not with its length (those of names in thousands of anagrams do)."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.words import mix
from skarn.runtime import dealt, ship, table, written


@dataclass(frozen=True)
class NameConfig:
    #: The greatest distance; keys are made for 1 and 2.
    most: int = 2
    #: A key's pairs may be this many times its names, and this many in all, before they also have to agree in order.
    pairs_per_name: int = 50
    least_pairs: int = 100_000

    def __post_init__(self):
        if self.most not in (1, 2):
            raise ValueError("distances of 1 or 2 only")


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def points(names: list[str]) -> list[np.ndarray]:
    return [np.frombuffer(n.encode("utf-32-le"), np.uint32) for n in names]


def multiset_keys(name: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, letters taken) of all multisets with up to `most` letters taken: a key is the sum of its letters' hashes, the
    letters are two code points plus one each in a number, 0 for none."""
    letters, count = np.unique(name, return_counts=True)
    h = mix(letters.astype(np.uint64) + np.uint64(0x51ED270B))
    total = (mix(name.astype(np.uint64) + np.uint64(0x51ED270B))).sum(dtype=np.uint64)
    own = letters.astype(np.uint64) + np.uint64(1)
    keys, taken = [np.array([total]), total - h], [np.zeros(1, np.uint64), own]
    if most > 1:
        i, j = np.triu_indices(len(letters))
        keep = (i != j) | (count[i] > 1)
        i, j = i[keep], j[keep]
        keys.append(total - h[i] - h[j])
        taken.append((own[i] << np.uint64(32)) | own[j])
    return _signed(np.concatenate(keys)), _signed(np.concatenate(taken))


def ordered_keys(name: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys of multisets, hashes of the letters left in order) for every choice of up to `most` places to take out."""
    h = mix(name.astype(np.uint64) + np.uint64(0x51ED270B))
    total, n = h.sum(dtype=np.uint64), len(name)
    base = np.uint64(0x9E3779B97F4A7C15)
    power = np.ones(n + 1, np.uint64)
    power[1:] = base
    power = np.cumprod(power, dtype=np.uint64)
    # run[i]: the polynomial of the first i letters.
    run = np.zeros(n + 1, np.uint64)
    for i, x in enumerate(h):
        run[i + 1] = run[i] * base + x
    between = lambda a, b: run[b] - run[a] * power[b - a]  # noqa: E731  letters a to b
    out = {(int(total), int(run[n]))}
    with np.errstate(over="ignore"):
        for k in range(1, most + 1):
            for gone in combinations(range(n), min(k, n)):
                v, at = np.uint64(0), 0
                for g in (*gone, n):
                    v = v * power[g - at] + between(at, g)
                    at = g + 1
                out.add((int(total - h[list(gone)].sum(dtype=np.uint64)), int(v)))
    keys = np.array(sorted(out), np.uint64).reshape(-1, 2)
    return _signed(np.ascontiguousarray(keys[:, 0])), _signed(np.ascontiguousarray(mix(keys[:, 1])))


def _emitted(names: DataFrame, cfg: NameConfig, ordered: bool = False) -> DataFrame:
    """(id, key, taken) or (id, key, order) of names (id, name)."""

    def run(it):
        import pyarrow as pa

        for batch in it:
            ids = np.asarray(batch.column(0))
            held, n = [], 0
            for i, name in zip(ids.tolist(), points(batch.column(1).to_pylist()), strict=True):
                a, b = (ordered_keys if ordered else multiset_keys)(name, cfg.most)
                held.append((np.full(len(a), i), a, b))
                n += len(a)
                if n > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=["id", "key", "more"])
                    held, n = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=["id", "key", "more"])

    return names.mapInArrow(run, "id long, key long, more long")


def _band(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The distance of two long names, or most + 1: rows of the table over the 2 * most + 1 diagonals that matter."""
    far, width = most + 1, 2 * most + 1
    x, y = a.tolist(), b.tolist()
    before, row = None, [d - most if d >= most else far for d in range(width)]
    for i, c in enumerate(x, 1):
        new = [far] * width
        for d in range(width):
            j = i + d - most
            if j < 0 or j > len(y):
                continue
            if not j:
                new[d] = min(i, far)
                continue
            v = row[d] + (c != y[j - 1])
            if d + 1 < width:
                v = min(v, row[d + 1] + 1)
            if d:
                v = min(v, new[d - 1] + 1)
            if before and i > 1 and j > 1 and c == y[j - 2] and x[i - 2] == y[j - 1] != c:
                v = min(v, before[d] + 1)
            new[d] = min(v, far)
        if min(new) > most:
            return far
        before, row = row, new
    d = len(y) - len(x) + most
    return row[d] if 0 <= d < width else far


def distances(left: list[str], right: list[str], most: int) -> np.ndarray:
    """The distance of each pair, or more than `most`. Bit-parallel over the first name, for many pairs at once: bit i of
    a word tells how the table's column changes at letter i."""
    out = np.full(len(left), most + 1, np.int64)
    a, b = points(left), points(right)
    n, m = (np.array([len(x) for x in y], np.int64) for y in (a, b))
    near = np.abs(n - m) <= most
    for i in np.flatnonzero(near & ((n > 64) | (m > 64))).tolist():
        out[i] = _band(a[i], b[i], most)
    out[near & (n == 0)] = m[near & (n == 0)]
    own = np.flatnonzero(near & (n > 0) & (n <= 64) & (m <= 64))
    own = own[np.lexsort((m[own], n[own]))]
    for lo in range(0, len(own), 8192):
        part = own[lo : lo + 8192]
        k, wide = len(part), int(max(m[part].max(), 1))
        rows, cols = np.full((k, 64), 0xFFFFFFFF, np.uint32), np.full((k, wide), 0xFFFFFFFE, np.uint32)
        for names, into, size in ((a, rows, n[part]), (b, cols, m[part])):
            flat = np.concatenate([names[i] for i in part.tolist()])
            at = np.repeat(np.cumsum(size) - size, size)
            into[np.repeat(np.arange(k), size), np.arange(len(flat)) - at] = flat
        one = np.uint64(1)
        up, down, diagonal, last = np.full(k, ~np.uint64(0)), np.zeros(k, np.uint64), np.zeros(k, np.uint64), np.zeros(k, np.uint64)
        score, top = n[part].copy(), (n[part] - 1).astype(np.uint64)
        for j in range(wide):
            same = np.packbits(rows == cols[:, j : j + 1], axis=1, bitorder="little").view("<u8")[:, 0]
            swapped = (((~diagonal & same) << one) & last)
            diagonal = (((same & up) + up) ^ up) | same | down | swapped
            right_up, right_down = down | ~(diagonal | up), diagonal & up
            step = ((right_up >> top) & one).astype(np.int64) - ((right_down >> top) & one).astype(np.int64)
            score += np.where(j < m[part], step, 0)
            right_up, right_down = (right_up << one) | one, right_down << one
            up, down, last = right_down | ~(diagonal | right_up), right_up & diagonal, same
        out[part] = score
    return out


def _verified(pairs: DataFrame, most: int) -> DataFrame:
    """(left, right, distance) of pairs (left, right, left_name, right_name) within the distance."""

    def run(it):
        import pyarrow as pa
        import pyarrow.compute as pc

        for whole in it:
            # Two names in a row are at most some kilobytes here as a rule; long ones pass a few at a time.
            size = np.cumsum(np.asarray(pc.add(pc.binary_length(whole.column(2)), pc.binary_length(whole.column(3))), np.int64)) // (8 << 20)
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), whole.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                batch = whole.slice(lo, hi - lo)
                d = distances(batch.column(2).to_pylist(), batch.column(3).to_pylist(), most)
                keep = pa.array(np.flatnonzero(d <= most))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(d.astype(np.int32)).take(keep)], names=["left", "right", "distance"])

    return pairs.select("left", "right", "left_name", "right_name").mapInArrow(run, "left long, right long, distance int")


def _nothing_in_both(a: Column, b: Column) -> Column:
    """No letter was taken on both sides."""
    x, y = (lambda c: c.bitwiseAND(0xFFFFFFFF)), (lambda c: F.shiftrightunsigned(c, 32))
    differ = lambda p, q: (p == 0) | (p != q)
    return differ(x(a), x(b)) & differ(x(a), y(b)) & differ(y(a), x(b)) & differ(y(a), y(b))


def near_names(left: DataFrame, right: DataFrame, cfg: NameConfig | None = None) -> DataFrame:
    """(left_name, right_name, distance) of all names (column `name`) of two frames within the distance.

    Distinct names get their 64-bit hash as id, and names come back for ids by joins; should two share one, the pairs of
    both are verified, so nothing is lost or wrong."""
    cfg = cfg or NameConfig()
    ship(left.sparkSession)
    sides = [d.where("name is not null and name <> ''").select("name").distinct().select(F.xxhash64("name").alias("id"), "name") for d in (left, right)]
    keys = [written(_emitted(s.repartition("id"), cfg), "keys") for s in sides]
    counts = [k.groupBy("key").agg(F.count("*").alias(c)) for k, c in zip(keys, ("n", "m"), strict=True)]
    # Keys with many pairs for their names; few, as each has thousands of names.
    both = counts[0].where(F.col("n") > 1).join(counts[1].where(F.col("m") > 1), "key")
    hot = written(both.where((F.col("n") * F.col("m") > cfg.least_pairs) & (F.col("n") * F.col("m") > cfg.pairs_per_name * (F.col("n") + F.col("m")))).select("key"), "hot")
    some = not hot.isEmpty()
    a, b = (k.join(hot, "key", "left_anti") if some else k for k in keys)
    a, b = a.select("key", F.col("id").alias("left"), F.col("more").alias("x")), b.select("key", F.col("id").alias("right"), F.col("more").alias("y"))
    met = a.join(b, (a["key"] == b["key"]) & _nothing_in_both(F.col("x"), F.col("y"))).select("left", "right")
    if some:
        ordered = []
        for s, k, name in zip(sides, keys, ("left", "right"), strict=True):
            own = s.join(k.join(hot, "key", "left_semi").select("id").distinct(), "id")
            # Of all that these names have in common: a key left in order may come of fewer letters than a hot one.
            ordered.append(_emitted(own.select("id", "name"), cfg, ordered=True).select(F.col("id").alias(name), "key", "more"))
        met = met.unionByName(ordered[0].join(ordered[1], ["key", "more"]).select("left", "right"))
    met = met.distinct()
    named = met.join(sides[0].select(F.col("id").alias("left"), F.col("name").alias("left_name")), "left")
    named = named.join(sides[1].select(F.col("id").alias("right"), F.col("name").alias("right_name")), "right")
    found = _verified(named, cfg.most)
    back = found.join(sides[0].select(F.col("id").alias("left"), F.col("name").alias("left_name")), "left")
    return back.join(sides[1].select(F.col("id").alias("right"), F.col("name").alias("right_name")), "right").select("left_name", "right_name", "distance")


def misspelt(vendor_id: Column, name: Column) -> Column:
    """The stored name with two neighbouring code points exchanged where the unsigned crc32 h of the id is even and the
    name has two at least: those at h mod (length - 1) and the next, from 0."""
    h, n = F.crc32(vendor_id.cast("string").cast("binary")), F.length(name)
    at = (h % (n - 1)).cast("int")
    swapped = F.concat(F.substring(name, F.lit(1), at), F.substring(name, at + 2, F.lit(1)), F.substring(name, at + 1, F.lit(1)), F.substring(name, at + 3, n))
    return F.when((h % 2 == 0) & (n >= 2), swapped).otherwise(name)


def op13_names(spark, sf_dir: str) -> DataFrame:
    """Vendors with misspelt names against clients: per vendor and distance the clients whose names are near."""
    clients = dealt(table(spark, sf_dir, "clients").select("client_id", "name"))
    vendors = dealt(table(spark, sf_dir, "vendors").select("vendor_id", "name")).select("vendor_id", misspelt(F.col("vendor_id"), F.col("name")).alias("name"))
    crc = F.crc32(F.col("client_id").cast("string").cast("binary"))
    known = written(clients.groupBy("name").agg(F.count("*").alias("n_clients"), F.min("client_id").alias("first_client_id"), F.sum(crc).alias("clients_crc")), "clients")
    found = near_names(known, vendors)
    per = found.join(known, found["left_name"] == known["name"]).groupBy("right_name", "distance")
    per = per.agg(F.sum("n_clients").alias("n_clients"), F.min("first_client_id").alias("first_client_id"), F.sum("clients_crc").alias("clients_crc"))
    return vendors.join(per, vendors["name"] == per["right_name"]).select("vendor_id", "distance", "n_clients", "first_client_id", "clients_crc")
