"""SimHash near-dedup with vantage-point trees.

Distinct fingerprints are dealt to shards by a vantage-point tree over Hamming distance: a node sends what
lies within the median distance of its vantage point to the left, the rest to the right. A fingerprint lives in one
shard, and visits every shard that its ball of the linking radius can reach, by the triangle inequality.
In a shard the tree goes on, over residents and visitors, down to small leaves whose pairs
are compared exactly. A shard hands on a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import aside, cut, drop, partitions
from .graph import connected_components

SEED = 42
#: Fingerprints from which the upper tree takes its vantage points and medians; all are dealt by it.
SAMPLE = 20_000
#: Residents of a shard, about, and depth of the upper tree at least, for there to be work for several executors.
#: Each level of it sends half as many fingerprints again to visit, so shards are as large as a task takes with ease.
SHARD, LEAST_DEPTH = 64_000, 4
#: Residents of a small leaf, and pairs that are compared at once, about.
LEAF, BLOCK = 192, 131_072

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, width: int = 4) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; of the whole sequence if it is shorter; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    flat, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(flat, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.fromiter((h(flat[a:b], SEED) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, len(words) - width + 1)


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash over word shingles, repeats included; 0 without words."""
    return majority(shingle_hashes(text, width))


def _fingerprints(width: int):
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in batches:
            got = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(got)], schema=schema)

    return run


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def vantage(items: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int, np.ndarray]:
    """A vantage point of ``items``, the median distance from it and all distances; of five candidates the one that spreads them most."""
    best = None
    some = items if len(items) <= 512 else rng.choice(items, 512, replace=False)
    for p in rng.choice(items, min(5, len(items)), replace=False):
        d = distance(some, p)
        if best is None or d.std() > best[0]:
            best = (d.std(), p)
    d = distance(items, best[1])
    return best[1], int(np.median(d)), d


def grow(items: np.ndarray, depth: int, seed: int = 1) -> list:
    """The upper tree as nested lists [point, median, left, right]; leaves are shard numbers."""
    rng, count = np.random.default_rng(seed), [0]

    def node(items, depth):
        if depth and len(items) > 1:
            p, t, d = vantage(items, rng)
            if (d <= t).any() and (d > t).any():
                return [int(p), t, node(items[d <= t], depth - 1), node(items[d > t], depth - 1)]
        count[0] += 1
        return count[0] - 1

    return node(items, depth)


def deal(tree, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, resident) for every shard that each fingerprint lives in or visits.

    A visitor crosses a median in one direction only, which changes from level to level: each pair is found once, and
    visitors spread over the shards.
    """
    out: list[tuple[np.ndarray, int, np.ndarray]] = []

    def walk(node, rows, resident, leftward):
        if not len(rows):
            return
        if not isinstance(node, list):
            out.append((rows, node, resident))
            return
        d = distance(fps[rows], np.uint64(node[0]))
        left = d <= node[1]
        reach_left, reach_right = d <= node[1] + radius, d > node[1] - radius
        # visitors go wherever their ball reaches; residents also to the far side, if that is the way here
        go_left = np.where(resident, left | (reach_left & leftward), reach_left)
        go_right = np.where(resident, ~left | (reach_right & (not leftward)), reach_right)
        walk(node[2], rows[go_left], (resident & left)[go_left], not leftward)
        walk(node[3], rows[go_right], (resident & ~left)[go_right], not leftward)

    walk(tree, np.arange(len(fps)), np.ones(len(fps), bool), True)
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
    return np.concatenate([r for r, _, _ in out]), np.concatenate([np.full(len(r), s) for r, s, _ in out]), np.concatenate([x for _, _, x in out])


class Forest:
    """Union-find over positions, rooted at the smallest."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            rr = self.up[r]
            if (rr == r).all():
                self.up[x] = r
                return r
            r = self.up[rr]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))


class Spanning(Forest):
    """A forest that keeps those of the joined pairs that tie two trees, which span all."""

    def __init__(self, n: int):
        super().__init__(n)
        self.kept = [np.zeros((0, 2), np.int64)]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            open_ = ra != rb
            a, b, low, high = a[open_], b[open_], np.minimum(ra, rb)[open_], np.maximum(ra, rb)[open_]
            order = np.lexsort((low, high))
            first = order[np.unique(high[order], return_index=True)[1]]
            self.up[high[first]] = low[first]
            self.kept.append(np.stack((a[first], b[first]), axis=1))


def shard_links(fps: np.ndarray, resident: np.ndarray, radius: int, leaf: int = LEAF, seed: int = 2, forest: Forest | None = None) -> np.ndarray:
    """Root position for each fingerprint of a shard, over all links with at least one resident end; closer ones of a block are joined first."""
    forest, rng = forest or Forest(len(fps)), np.random.default_rng(seed)
    home = np.flatnonzero(resident)

    def compare(h, q):
        """Exact comparisons of q with h. A dense leaf's members are tied through a centre first, which spares the pairs among them."""
        while len(h) > leaf:
            # all of h lies within so small a ball that no vantage point splits it
            c = h[0]
            near = distance(fps[h], fps[c]) <= radius
            forest.join(h[near], np.full(near.sum(), c))
            far = h[~near]
            nq = q[distance(fps[q], fps[c]) <= radius]
            forest.join(nq, np.full(len(nq), c))
            # a query in another component may still touch any of the near ones
            others = q[forest.roots(q) != forest.roots(np.array([c]))[0]]
            block(h[near], others)
            h = far
        block(h, q)

    def block(h, q):
        step = max(1, BLOCK // max(1, len(h)))
        for at in range(0, len(q), step):
            i, j = np.divmod(np.flatnonzero(np.bitwise_count(fps[q[at : at + step], None] ^ fps[None, h]) <= radius), len(h))
            x, y = q[at : at + step][i], h[j]
            x, y = x[x != y], y[x != y]
            close = distance(fps[x], fps[y]) <= radius // 2
            forest.join(x[close], y[close])
            forest.join(x[~close], y[~close])

    stack = [(home, np.arange(len(fps)))]
    while stack:
        h, q = stack.pop()
        if not len(h) or not len(q):
            continue
        if len(h) <= leaf:
            block(h, q)
            continue
        p, t, d = vantage(fps[h], rng)
        left = d <= t
        if left.all() or not left.any():
            below = d < t
            if not below.any():
                compare(h, q)
                continue
            t, left = t - 1, below
        dq = distance(fps[q], p)
        stack.append((h[left], q[dq <= t + radius]))
        stack.append((h[~left], q[dq > t - radius]))
    return forest.roots(np.arange(len(fps)))


def _deal_batches(tree, radius: int):
    schema = pa.schema([("shard", pa.int32()), ("fp", pa.int64()), ("resident", pa.bool_())])

    def run(batches):
        for b in batches:
            fps = np.asarray(b.column(0)).view(np.uint64)
            rows, shard, resident = deal(tree, fps, radius)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(fps[rows].view(np.int64)), pa.array(resident)], schema=schema)

    return run


def _link_shard(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        fps = np.asarray(table.column("fp").combine_chunks()).view(np.uint64)
        resident = np.asarray(table.column("resident").combine_chunks().to_numpy(zero_copy_only=False))
        order = np.argsort(fps, kind="stable")
        fps, resident = fps[order], resident[order]
        root = shard_links(fps, resident, radius)
        tied = np.flatnonzero(root != np.arange(len(fps)))
        return pa.Table.from_arrays([pa.array(fps[tied].view(np.int64)), pa.array(fps[root[tied]].view(np.int64))], schema=schema)

    return run


def _close_in_shard(radius: int):
    """Pairs within the radius that span all such pairs of a shard."""
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        fps = np.asarray(table.column("fp").combine_chunks()).view(np.uint64)
        resident = np.asarray(table.column("resident").combine_chunks().to_numpy(zero_copy_only=False))
        order = np.argsort(fps, kind="stable")
        fps, forest = fps[order], Spanning(len(fps))
        shard_links(fps, resident[order], radius, forest=forest)
        pairs = np.concatenate(forest.kept)
        return pa.Table.from_arrays([pa.array(fps[pairs[:, k]].view(np.int64)) for k in (0, 1)], schema=schema)

    return run


def _in_shards(classes: DataFrame, radius: int, shard: int) -> DataFrame:
    """(shard, fp, resident) of distinct fingerprints, by a vantage-point tree grown from a sample of them."""
    n = classes.count()
    sample = classes.where(F.pmod(F.xxhash64("fp"), F.lit(1_000_000_007)) < F.lit(_share(n, SAMPLE, 1_000_000_007))).select("fp").limit(2 * SAMPLE).toPandas()["fp"]
    depth = max(LEAST_DEPTH, int(np.ceil(np.log2(max(1.0, n / shard)))))
    tree = grow(np.sort(sample.to_numpy(np.int64)).view(np.uint64), depth)
    return classes.select("fp").mapInArrow(_deal_batches(tree, radius), "shard int, fp long, resident boolean")


def _share(n: int, most: int, of: int) -> int:
    """Of ``of`` equal parts of ``n`` rows, those that hold about ``most`` rows; one at least."""
    return max(1, min(of, round(of * most / max(n, 1))))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, shard: int = SHARD) -> DataFrame:
    """One row for each row of ``docs``: id, fingerprint (16 hex digits), component_id.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest id reachable. Texts
    without words have fingerprint zero and link like others; fewer words than ``width`` make one
    shingle. Null ids get a class but never name one, unless no other row is in it. Repeated rows share
    their class; an empty table gives an empty result. Only the id and the text are read.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    fp = cut(slim.mapInArrow(_fingerprints(width), "id long, fp long"), "fingerprints")
    classes = cut(fp.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    links = cut(_in_shards(classes, radius, shard).groupBy("shard").applyInArrow(_link_shard(radius), "a long, b long"), "links")
    parts = connected_components(links)
    labelled = classes.join(parts, classes["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    whole = cut(labelled.join(named, "component").select("fp", "component_id"), "classes")
    return fp.join(whole, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Similar texts, of a Jaccard similarity of their sets of shingles, are linked in two steps. First by the method above: fingerprints of the sets go through the
# vantage-point tree, with a radius that most such pairs lie within, and of what lies within it a pair is a link if the sets themselves are as similar.
# A fingerprint is a draw, and some pairs lie farther apart; a spanning forest of close ones leaves out some as well. Those are found exactly, among what is then apart: all sets are put in one
# order of shingles, those that few texts have first; two sets of a similarity then share a shingle among the first few of each, so texts
# that meet there are all the candidates, and again a link stands only if the sets themselves are as similar. How many texts have a shingle is
# counted over all of them. A shingle that no other text has takes a place and makes no candidate, so that only a text most of whose
# shingles others have as well has candidates at all.

#: Differing bits within which 95 % of the pairs of similarity 0.8 are expected, and more of closer ones: 9.7 on average, with a deviation of 2.9.
BALL = 14
#: Texts from which the most common shingles are told, and how many are kept, at most. They come last, in the order of the sample; others are counted. They change the order, never the result.
COMMON_SAMPLE, COMMON = 16_000, 400_000
#: Bytes of text whose shingles are counted in one group, and shingles that a task deals out together, about.
COUNTED, DEALT = 8 << 20, 400_000
#: Members of a group of which all pairs are taken at once; in larger ones each is tied to some before it, and only what stays apart is paired.
ALL_PAIRS = 16
#: Members next in size that each is tied to first.
NEXT = 3
#: Texts that candidates are made of, up to which their hashes are broadcast.
BROADCAST_TEXTS = 1_000_000


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Distinct word shingles' hashes, sorted."""
    return np.unique(shingle_hashes(text, width))


def set_key(hashes: np.ndarray) -> int:
    """A signed 64-bit hash of a whole set."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED + 1)).astype(np.int64))


def sketch(hashes: np.ndarray) -> bytes:
    """How many hashes begin with each prefix of some bits, about two on average; empty where a count does not fit a byte."""
    bits = min(16, max(4, int(np.ceil(np.log2(max(1, len(hashes)) / 2)))))
    counts = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def may_be_similar(x: bytes, y: bytes, similarity: float) -> bool:
    """False only if sets of these sketches share too few hashes: no more than the smaller count of each prefix."""
    if not x or not y:
        return True
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) > len(b):
        a, b = b, a
    b = b.reshape(len(a), -1).sum(axis=1, dtype=np.int64)
    return int(np.minimum(a, b).sum(dtype=np.int64)) >= np.ceil(similarity / (1 + similarity) * (int(a.sum(dtype=np.int64)) + int(b.sum())) - 1e-9)


def wanted_shingles(n: int, similarity: float) -> int:
    """How many of the first shingles of a set of n must be looked at: n - ceil(similarity * n) + 1."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def parted(hashes: np.ndarray, common: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(others, the ``common`` (sorted) by ``rank``) of a set."""
    if not len(common) or not len(hashes):
        return hashes, hashes[:0]
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    late = common[at] == hashes
    own = np.flatnonzero(late)
    return hashes[~late], hashes[own[np.argsort(rank[at[own]], kind="stable")]]


def _all_shingles(width: int):
    schema = pa.schema([("h", pa.int64())])

    def run(batches):
        for b in batches:
            for t in b.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), width).view(np.int64))], schema=schema)

    return run


def _read_sets(width: int, similarity: float, held):
    """For each text its set's key, fingerprint, sketch and size, how many of its shingles are not common, and those common ones that are among its first."""
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("node", pa.int64()), ("fp", pa.int64()), ("sketch", pa.binary()), ("size", pa.int64()), ("own", pa.int64()), ("late", pa.binary())])

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column("text"):
                s = shingle_set(t.as_py(), width)
                own, late = parted(s, *held.value)
                rows.append((set_key(s), int(np.uint64(majority(s)).astype(np.int64)), sketch(s), len(s), len(own), late[: max(0, wanted_shingles(len(s), similarity) - len(own))].tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), *[pa.array([r[k] for r in rows], schema.field(k + 2).type) for k in range(6)]], schema=schema)

    return run


def _deal_shingles(width: int, groups: int, held):
    """Shingles that are not common, many in a row: (grp, nodes, hashes, which node each is of). Of texts with one set, one counts."""
    schema = pa.schema([("grp", pa.int64()), ("nodes", pa.binary()), ("hashes", pa.binary()), ("of", pa.binary())])

    def dealt(sets: dict[int, np.ndarray]):
        nodes = np.fromiter(sets, np.int64, len(sets))
        hashes, of = np.concatenate(list(sets.values())), np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets.values()])
        grp = (hashes % np.uint64(groups)).astype(np.int64)
        order = np.argsort(grp, kind="stable")
        names, first = np.unique(grp[order], return_index=True)
        rows = []
        for part in np.split(order, first[1:]):
            there, local = np.unique(of[part], return_inverse=True)
            rows.append((nodes[there].tobytes(), hashes[part].tobytes(), local.astype(np.int32).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(names), *[pa.array([r[k] for r in rows], pa.binary()) for k in range(3)]], schema=schema)

    def run(batches):
        sets, many = {}, 0
        for b in batches:
            for t in b.column("text"):
                s = shingle_set(t.as_py(), width)
                own, _ = parted(s, *held.value)
                if len(own) and (node := set_key(s)) not in sets:
                    sets[node] = own
                    many += len(own)
                if many > DEALT:
                    yield dealt(sets)
                    sets, many = {}, 0
        if sets:
            yield dealt(sets)

    return run


def _shared(table: pa.Table) -> pa.Table:
    """(node, times, token) of a group's shingles that two nodes or more have, with how many do."""
    schema = pa.schema([("node", pa.int64()), ("times", pa.int32()), ("token", pa.int64())])
    columns = [[np.frombuffer(x.as_py(), kind) for x in table.column(c)] for c, kind in (("nodes", "<i8"), ("hashes", "<u8"), ("of", "<i4"))]
    node, token = np.concatenate([n[of] for n, _, of in zip(*columns, strict=True)]), np.concatenate(columns[1])
    order = np.lexsort((node, token))
    node, token = node[order], token[order]
    once = np.concatenate(([True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])))
    node, token = node[once], token[once]
    starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    times = np.diff(np.append(starts, len(token)))
    keep = np.repeat(times > 1, times)
    return pa.Table.from_arrays([pa.array(node[keep]), pa.array(np.repeat(times, times)[keep].astype(np.int32)), pa.array(token[keep].view(np.int64))], schema=schema)


def _first_shingles(similarity: float):
    """(token, node, place) of those first shingles of each node that others have too; size and position go as one number."""
    schema = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("place", pa.int64())])

    def run(batches):
        for b in batches:
            out = [(np.zeros(0, np.int64),) * 3]
            for node, size, own, late, near in zip(*[b.column(c).to_pylist() for c in ("node", "size", "own", "late")], b.column("near"), strict=True):
                shared = np.asarray(near.values.field("token")) if near.is_valid else out[0][0]
                alone = own - len(shared)
                first = shared[: max(0, wanted_shingles(size, similarity) - alone)]
                last = np.frombuffer(late, "<i8")
                token = np.concatenate((first, last))
                at = np.concatenate((alone + np.arange(len(first)), own + np.arange(len(last))))
                out.append((token, np.full(len(token), node), (size << 32) + at))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=schema)

    return run


def can_reach(place_a: np.ndarray, place_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets whose first shared shingle stands at these places (size, position) can have the similarity."""
    na, nb, ia, ib = place_a >> 32, place_b >> 32, place_a & 0xFFFFFFFF, place_b & 0xFFFFFFFF
    need = np.ceil(similarity / (1 + similarity) * (na + nb) - 1e-9)
    return (np.minimum(na, nb) >= similarity * np.maximum(na, nb) - 1e-9) & (np.minimum(na - ia, nb - ib) >= need)


#: Pairs that a task gathers, to hand each on once.
GATHERED = 2_000_000


class _Pairs:
    """Gathers pairs, and gives batches of distinct ones: texts that are alike share many groups, so a pair comes again and again."""

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def __init__(self):
        self.held, self.count = [], 0

    def add(self, x: np.ndarray, y: np.ndarray):
        self.held.append(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1))
        self.count += len(x)
        if self.count > GATHERED:
            self.held = [np.unique(np.concatenate(self.held), axis=0)]
            self.count = len(self.held[0])
            if self.count > GATHERED // 2:
                yield from self.rest()

    def rest(self):
        pairs = np.unique(np.concatenate(self.held), axis=0) if self.held else np.zeros((0, 2), np.int64)
        self.held, self.count = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], schema=self.schema)


def tied(token: np.ndarray, place: np.ndarray, turn: np.ndarray, since: int):
    """Yields (i, j) of rows from ``since`` on, sorted by token and place, with rows before them in their group: all before it for the first members, the nearest for others."""
    for k in range(1, min(ALL_PAIRS, len(token))):
        i = np.arange(max(since, k), len(token))
        i = i[(token[i] == token[i - k]) & ((turn[i] < ALL_PAIRS) | (k <= NEXT))]
        yield i, i - k


def _near_pairs(similarity: float):
    """Candidates among rows (token, node, place), sorted, of which only the last few are held."""

    def run(batches):
        out, old, hub = _Pairs(), [np.zeros(0, np.int64)] * 4, None
        for b in batches:
            if not b.num_rows:
                continue
            token, node, place = (np.concatenate((o, np.asarray(b.column(c)))) for o, c in zip(old, ("token", "node", "place"), strict=False))
            since = len(old[0])
            starts = np.concatenate(([True], token[1:] != token[:-1]))
            first = np.maximum.accumulate(np.where(starts, np.arange(len(token)), 0))
            turn = np.arange(len(token)) - first
            hubs = np.stack((node[first], place[first]))
            if since:  # the group that is open goes on
                on = first == first[since - 1]
                turn[on] += old[3][-1] - turn[since - 1]
                hubs[:, on] = hub
            for i, j in tied(token, place, turn, since):
                ok = (node[i] != node[j]) & can_reach(place[i], place[j], similarity)
                yield from out.add(node[i[ok]], node[j[ok]])
            # the first of a group as well, so that links of those that are alike make a star and no chain
            i = since + np.flatnonzero(turn[since:] >= ALL_PAIRS)
            ok = (node[i] != hubs[0, i]) & can_reach(place[i], hubs[1, i], similarity)
            yield from out.add(node[i[ok]], hubs[0, i[ok]])
            old, hub = [x[-ALL_PAIRS:] for x in (token, node, place, turn)], hubs[:, -1:]
        yield from out.rest()

    return run


def overlaps(x: bytes, others: list[bytes]) -> np.ndarray:
    """How many hashes sets of sketches ``others`` can share with that of sketch ``x``; no limit where one has no sketch."""
    out, a = np.full(len(others), np.iinfo(np.int64).max), np.frombuffer(x, np.uint8)
    by: dict[int, list[int]] = {}
    for k, y in enumerate(others):
        by.setdefault(len(y), []).append(k)
    for length, own in by.items():
        if not len(a) or not length:
            continue
        m = np.frombuffer(b"".join([others[k] for k in own]), np.uint8).reshape(len(own), length).astype(np.int64)
        n = min(len(a), length)
        fold = lambda z, n=n: z.reshape(-1, n, z.shape[1] // n).sum(axis=2)
        out[own] = np.minimum(fold(a.astype(np.int64)[None]), fold(m)).sum(axis=1)
    return out


def _apart_pairs(similarity: float, best: bool):
    """Candidates of one group that are in different parts, from rows (token, node, place, part, sketch) sorted by token: with ``best``, for each row the one that may share most, else all."""

    def pairs(node, place, part, sketches):
        sketches = sketches.tolist()
        for i in range(len(node)):
            j = np.flatnonzero((part != part[i]) & (node != node[i]))
            j = j[can_reach(np.full(len(j), place[i]), place[j], similarity)]
            shared = overlaps(sketches[i], [sketches[k] for k in j])
            sizes = (place[i] >> 32) + (place[j] >> 32)
            ok = np.flatnonzero(shared >= np.ceil(similarity / (1 + similarity) * sizes - 1e-9))
            if best and len(ok):
                ok = ok[[int(np.argmax(shared[ok] / sizes[ok]))]]
            yield np.full(len(ok), node[i]), node[j[ok]]

    def run(batches):
        out, open_ = _Pairs(), []

        def closed():
            for x, y in pairs(*(np.concatenate(c) for c in list(zip(*open_, strict=True))[1:])):
                yield from out.add(x, y)

        for b in batches:
            if not b.num_rows:
                continue
            token, *rest = (np.asarray(b.column(c)) for c in ("token", "node", "place", "part"))
            rest.append(np.array([*b.column("sketch").to_pylist(), None], object)[:-1])
            cuts = np.flatnonzero(token[1:] != token[:-1]) + 1
            for lo, hi in zip(np.concatenate(([0], cuts)), np.append(cuts, len(token)), strict=True):
                if open_ and open_[0][0] != token[lo]:
                    yield from closed()
                    open_ = []
                open_.append((token[lo], *(c[lo:hi] for c in rest)))
        if open_:
            yield from closed()
        yield from out.rest()

    return run


def _sets(width: int):
    schema = pa.schema([("node", pa.int64()), ("hashes", pa.binary())])

    def run(batches):
        for b in batches:
            sets = [shingle_set(t.as_py(), width) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)

    return run


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sorted sets."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return both / (len(x) + len(y) - both)


def _kept_pairs(fits):
    """Rows (a, b, left, right) of which ``fits(left, right)`` holds, as (a, b)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            ok = pa.array([fits(x.as_py(), y.as_py()) for x, y in zip(batch.column("left"), batch.column("right"), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], schema=schema)

    return run


def _with_both(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
    left = pairs.join(of.select(F.col("node").alias("a"), F.col(column).alias("left")), "a")
    return left.join(of.select(F.col("node").alias("b"), F.col(column).alias("right")), "b").select("a", "b", "left", "right")


def _true_links(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those (a, b) of ``pairs`` whose sets of shingles are ``similarity`` alike."""
    nodes = lambda df: df.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sketches = cut(classes.select("node", "sketch").join(nodes(pairs), "node", "left_semi"), "sketches")
    pairs = cut(_with_both(pairs, sketches, "sketch").mapInArrow(_kept_pairs(lambda x, y: may_be_similar(x, y, similarity)), "a long, b long"), "pairs")
    drop(sketches)
    ends = nodes(pairs)
    wanted = cut(classes.join(ends, "node").select("node", F.col("least.th").alias("th")), "wanted")
    # only texts that may be a candidate's are read into sets again
    hashes = wanted.select("th").distinct()
    some = docs.join(F.broadcast(hashes) if wanted.count() <= BROADCAST_TEXTS else hashes, "th", "left_semi")
    sets = some.mapInArrow(_sets(width), "node long, hashes binary").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])
    sets = cut(sets, "sets")
    alike = lambda x, y: jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= similarity - 1e-9
    links = cut(_with_both(pairs, sets, "hashes").mapInArrow(_kept_pairs(alike), "a long, b long"), "links")
    drop(sets, wanted, pairs)
    return links


def _ball_pairs(classes: DataFrame, radius: int = BALL, shard: int = SHARD) -> DataFrame:
    """(a, b), a < b, of (node, fp): pairs of nodes whose fingerprints lie within the radius, by the vantage-point tree; they span all such pairs of a shard."""
    named = cut(classes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "fingerprints")
    near = cut(_in_shards(named, radius, shard).groupBy("shard").applyInArrow(_close_in_shard(radius), "x long, y long").distinct(), "near")
    of = lambda name, node: named.select(F.col("fp").alias(name), F.col("first").alias(node))
    apart = near.join(of("x", "s"), "x").join(of("y", "t"), "y").select("s", "t")
    same = classes.join(named.where("n > 1").select("fp", "first"), "fp").where("node <> first").select(F.col("node").alias("s"), F.col("first").alias("t"))
    return apart.union(same).select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct()


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Those (a, b) of ``pairs`` whose ends are not in one component of ``parts``."""
    of = lambda node, part: parts.select(F.col("node").alias(node), F.col("component").alias(part))
    both = pairs.join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left")
    return both.where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


def _stars(parts: DataFrame) -> DataFrame:
    """Links (a, b) that stand for those that made the components."""
    return parts.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """(id, th, first) for each row of ``docs``: th a hash of its text, first the (id, th) of its class that comes first, null ids last."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    n, n_bytes = slim.agg(F.count("*"), F.sum(F.octet_length("text"))).head()
    some = slim.where(F.pmod(F.col("th"), F.lit(1_000_000_007)) < F.lit(_share(n, COMMON_SAMPLE, 1_000_000_007)))
    often = some.mapInArrow(_all_shingles(width), "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    often = often.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    common, times = np.asarray(often.column("h").combine_chunks()).view(np.uint64), np.asarray(often.column("n").combine_chunks())
    order = np.argsort(common)
    held = spark.sparkContext.broadcast((common[order], times[order]))
    sets = cut(slim.mapInArrow(_read_sets(width, similarity, held), "id long, th long, node long, fp long, sketch binary, size long, own long, late binary"), "sets")
    # texts of one set are one from here on
    best = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    classes = cut(sets.groupBy("node").agg(F.min(best).alias("least"), *[F.first(c).alias(c) for c in ("fp", "sketch", "size", "own", "late")]), "distinct")
    close = cut(_ball_pairs(classes), "close")
    found = connected_components(_true_links(close, slim, classes, width, similarity))
    groups = max(partitions(spark), (n_bytes or 0) // COUNTED)
    dealt = slim.mapInArrow(_deal_shingles(width, groups, held), "grp long, nodes binary, hashes binary, of binary")
    shared = dealt.groupBy("grp").applyInArrow(_shared, "node long, times int, token long")
    lists = shared.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("times", "token"))).alias("near"))
    firsts = classes.select("node", "size", "own", "late").join(lists, "node", "left").where("near IS NOT NULL OR octet_length(late) > 0")
    firsts = cut(firsts.mapInArrow(_first_shingles(similarity), "token long, node long, place long"), "firsts")
    # by size, then node: one order in all groups, so that texts that share many are tied in all of them to the same
    sort = lambda df: df.repartition("token").sortWithinPartitions("token", F.shiftright("place", 32), "node")
    pairs = _apart(sort(firsts).mapInArrow(_near_pairs(similarity), "a long, b long").distinct(), found).join(close, ["a", "b"], "left_anti")
    pairs = cut(pairs, "pairs")
    parts = connected_components(_stars(found).union(_true_links(pairs, slim, classes, width, similarity)))
    tried = close.union(pairs)
    large = cut(firsts.groupBy("token").count().where(F.col("count") > ALL_PAIRS).select("token"), "large")
    for best in (True, False) if not large.isEmpty() else ():
        # what is still apart in large groups meets the one most like it, and what is apart then pair by pair
        rows = firsts.join(large, "token").join(parts, "node", "left").select("token", "node", "place", F.coalesce("component", "node").alias("part"))
        rows = cut(rows, "rows")
        apart = rows.groupBy("token").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("token")
        some = sort(rows.join(apart, "token").join(classes.select("node", "sketch"), "node")).select("token", "node", "place", "part", "sketch")
        rest = cut(some.mapInArrow(_apart_pairs(similarity, best), "a long, b long").distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        parts = connected_components(_stars(parts).union(_true_links(rest, slim, classes, width, similarity)))
        drop(rows)
        tried = tried.union(rest)
    labelled = classes.join(parts, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    named = labelled.groupBy("component").agg(F.min("least").alias("first"))
    whole = cut(labelled.join(named, "component").select("node", "first"), "classes")
    drop(firsts, large, pairs, close)
    return sets.select("id", "th", "node").join(whole, "node").select("id", "th", "first")


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row for each row of ``docs``: id, component_id, by chains of texts that are ``similarity`` alike in their word shingles.

    The similarity is the Jaccard similarity of the two sets of word shingles, as 64-bit hashes; all pairs that have it link, and no
    others. Texts without words are alike. Null ids get a class but never name one, unless no
    other row is in it. Repeated rows share their class; an empty table gives an empty result.
    """
    return _classes(docs, id_col, text_col, width, similarity).select(F.col("id").alias(id_col), F.col("first.id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each class of :func:`similar_classes`, that with the smallest id; all columns as they were.

    Null ids come after all others. Rows are told apart by id and text, so an id that repeats with another text stands for itself;
    of rows that repeat both, one stays.
    """
    kept = cut(_classes(docs, id_col, text_col, width, similarity), "decided")
    gone = kept.where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th")))).select(F.col("id").alias("gone_id"), F.col("th").alias("gone_th")).distinct()
    rows = aside(docs, id=F.col(id_col).cast("long"), th=F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    out = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("th") == F.col("gone_th")), "left_anti")
    if not kept.groupBy("id", "th").count().where("count > 1").isEmpty():
        turn = F.row_number().over(W.partitionBy("id", "th").orderBy(F.monotonically_increasing_id()))
        out = out.withColumn("turn", turn).where("turn = 1")
    return out.select("row.*")
