"""SimHash near-duplicates by segment popcounts.

A 64-bit fingerprint is cut into segments of two bits; the number of set bits of each segment
makes a vector, and the Manhattan distance of two vectors is never more than the number of bits
in which the fingerprints differ. The vectors are cut into groups. If two fingerprints differ
in at most D bits, then in one of G groups the distance is at most D // G, at most 2 here, so
some grid point is at most 1 from both. Each fingerprint therefore enters, for every group,
its own grid cell and the cells at distance 1; fingerprints that meet in a cell are compared
bit by bit.

A cell gives no pairs but the edges of a spanning forest of its links, so a large cell of near
copies costs a few scans and one edge per member. Equal texts are one fingerprint from the
start. Components come from contracting the edges until none is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import ship
from .common import add_columns, materialize, texts_of, tidy
from .decontaminate import shared

ship(__name__)

SEED = 42
SEGMENT_BITS = 2
WORDS = 4
MOST_BITS = 4
GROUPS = 2
#: Rows of a cell up to which all of them are compared; beyond, a forest is grown.
FEW = 128
#: Nodes of a group of candidates whose sets one task compares; larger groups meet in blocks.
BLOCK = 2048


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words, repeats included; A-Z is lower-cased first."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, "u8")
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]).tolist()
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    if len(parts) < words:
        return np.array([digest(joined, SEED)], "u8")
    return np.array(
        [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :], strict=False)],
        "u8",
    )


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if more than half of the hashes have it; 0 without hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, "i8")
    for at in range(0, len(hashes), 65536):
        octets = hashes[at : at + 65536].astype(">u8").view("u1").reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1).sum(axis=0, dtype="i8")
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _mixed(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Another 64 bits from each hash, for wider fingerprints."""
    h = hashes + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def add_fingerprints(df: DataFrame, words: int = WORDS, extra: int = 0, text: str = "text") -> DataFrame:
    """Add ``fp`` and, for ``extra`` more fingerprints, ``wide`` (their bits as bigints).

    Null counts as empty; texts without words have fingerprint 0.
    """

    def make():
        def fn(batch: pa.RecordBatch) -> dict:
            fps, wide = [], []
            for x in texts_of(batch, text):
                h = shingle_hashes(x, words)
                fps.append(_signed(fingerprint(h)))
                wide.append([_signed(fingerprint(_mixed(h, s))) for s in range(1, extra + 1)])
            return {"fp": pa.array(fps, pa.int64()), "wide": pa.array(wide, pa.list_(pa.int64()))}

        return fn

    return add_columns(df, make, "fp bigint, wide array<bigint>")


def grid_cells(fps: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(row index, cell number) of every cell that each fingerprint enters."""
    segments = 64 // SEGMENT_BITS
    pairs = (fps.view("u8")[:, None] >> (np.arange(segments, dtype="u8") * np.uint64(2))) & np.uint64(3)
    counts = np.array([0, 1, 1, 2], "i4")[pairs.astype("i4")]
    rows, cells = [], []
    everyone = np.arange(len(fps))
    for g, own in enumerate(np.array_split(np.arange(segments), groups)):
        power = 3 ** np.arange(len(own), dtype="i8")
        base = counts[:, own] @ power
        offset = g * 3 ** len(np.array_split(np.arange(segments), groups)[0])
        rows.append(everyone)
        cells.append(base + offset)
        for j, s in enumerate(own):
            for step, possible in ((1, counts[:, s] < 2), (-1, counts[:, s] > 0)):
                rows.append(everyone[possible])
                cells.append(base[possible] + step * power[j] + offset)
    return np.concatenate(rows), np.concatenate(cells)


def near(a: np.ndarray, b: np.ndarray, most: int, wide_most: int) -> np.ndarray:
    """Whether rows of fingerprints link: first column within ``most`` bits, the rest together."""
    diff = np.bitwise_count((a ^ b).view("u8"))  # signed numbers would count their absolute value
    close = diff[..., 0] <= most
    return close & (diff[..., 1:].sum(axis=-1) <= wide_most) if diff.shape[-1] > 1 else close


def cell_forest(fps: np.ndarray, most: int, wide_most: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of one cell's links, as row numbers.

    Each row is compared with those that no tree has reached yet; a large group of near
    copies is reached from a few rows.
    """
    edges, left = [], np.arange(len(fps))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = near(fps[left], fps[at][None], most, wide_most)
            if hit.any():
                edges += [(int(at), int(x)) for x in left[hit]]
                queue += left[hit].tolist()
                left = left[~hit]
    return edges


def links(distinct: DataFrame, most: int, groups: int, wide_most: int) -> DataFrame:
    """Edges (a, b) between the nodes of ``distinct`` (``node, fp, wide``) that link.

    The edges connect exactly the nodes that links connect; every edge is a link.
    """
    if most // groups > 2:
        raise ValueError("too few groups for this distance")
    extra = len(distinct.select("wide").first()[0]) if not distinct.isEmpty() else 0
    names = ["node", *[f"p{i}" for i in range(extra + 1)]]

    def enter(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            wide = np.asarray(batch.column("wide").flatten(), "i8").reshape(len(fps), extra)
            rows, cells = grid_cells(fps, groups)
            data = np.column_stack([batch.column("node").to_numpy(), fps, wide])[rows]
            yield pa.RecordBatch.from_pydict(
                {"cell": pa.array(cells.astype("i4"))}
                | {n: pa.array(np.ascontiguousarray(c)) for n, c in zip(names, data.T, strict=True)}
            )

    def forest(rows: np.ndarray) -> list[tuple[int, int]]:
        rows = np.unique(rows, axis=0)
        found = cell_forest(rows[:, 1:], most, wide_most)
        return [(int(rows[i, 0]), int(rows[j, 0])) for i, j in found]

    def out(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*edges, strict=True) if edges else ((), ())
        return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def meet(batches):
        held, held_cell = np.zeros((0, extra + 2), "i8"), None
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            data = np.column_stack([batch.column(n).to_numpy() for n in names])
            cells = np.concatenate([np.full(len(held), held_cell or 0, "i4"), cells])
            data = np.concatenate([held, data])
            cuts = np.flatnonzero(np.diff(cells)) + 1
            begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(cells)]])
            # The last cell may go on in the next batch.
            held, held_cell = data[begins[-1] :], cells[-1]
            begins, size = begins[:-1], (ends - begins)[:-1]
            # Cells of few rows are compared all at once, each row with those some steps on.
            few = np.repeat(size <= FEW, size)
            one, two = [], []
            for step in range(1, min(FEW, int(size.max(initial=0)))):
                at = np.flatnonzero(few[:-step] & (cells[: len(few) - step] == cells[step : len(few)]))
                hit = at[near(data[at, 1:], data[at + step, 1:], most, wide_most)]
                one.append(hit)
                two.append(hit + step)
            one, two = np.concatenate([[], *one]).astype("i8"), np.concatenate([[], *two]).astype("i8")
            # Where many rows link to many, a forest says the same with fewer edges.
            cell_of = np.repeat(np.arange(len(size)), size)
            dense = np.bincount(cell_of[one], minlength=len(size)) > size
            sparse = ~dense[cell_of[one]]
            edges = list(zip(data[one[sparse], 0].tolist(), data[two[sparse], 0].tolist(), strict=True))
            grown = dense | (size > FEW)
            for start, n in zip(begins[grown], size[grown], strict=True):
                edges += forest(data[start : start + n])
            yield out(edges)
        yield out(forest(held))

    columns = ", ".join(f"{n} bigint" for n in names)
    entered = distinct.select("node", "fp", "wide").mapInArrow(tidy(enter), f"cell int, {columns}")
    met = entered.repartition("cell").sortWithinPartitions("cell").mapInArrow(tidy(meet), "a bigint, b bigint")
    ordered = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return ordered.filter("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): a root for every node of ``edges``, equal within a component.

    Each round hooks every node to its smallest neighbour, renames the edges and drops those
    inside a tree. The number of nodes that still have edges at least halves in most rounds,
    and the driver sees one number per round.
    """
    edges = materialize(edges, "edges")
    names = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("_least"))
        hook = materialize(
            hook.select(F.col("a").alias("_node"), F.least("a", "_least").alias("_up")), "hooks"
        )
        if names is None:
            names = hook.select(F.col("_node").alias("node"), F.col("_up").alias("root"))
        else:
            names = names.join(hook, F.col("root") == F.col("_node"), "left").select(
                "node", F.coalesce("_up", "root").alias("root")
            )
        names = materialize(names, "names")
        one = edges.join(hook, F.col("a") == F.col("_node")).select(F.col("_up").alias("a"), "b")
        two = one.join(hook, F.col("b") == F.col("_node")).select("a", F.col("_up").alias("b"))
        two = two.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        edges = materialize(two.filter("a < b").distinct(), "edges")
    if names is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return names


def near_duplicates(
    df: DataFrame, words: int = WORDS, most: int = MOST_BITS, groups: int = GROUPS,
    extra: int = 0, wide_most: int = 0,
) -> DataFrame:
    """``doc_id, fp, component_id``: documents whose fingerprints link, directly or not.

    ``component_id`` is the smallest ``doc_id`` that can be reached, null ids apart (a
    document whose component has only null ids gets null). With ``extra`` fingerprints, two
    documents link only if these, taken together, differ in at most ``wide_most`` bits as well.
    Null and empty texts have fingerprint 0 and link like any other; repeated rows stay.
    """
    docs = materialize(add_fingerprints(df.select("doc_id", "text"), words, extra).drop("text"), "prints")
    keys = ["fp", "wide"]
    # A hash names a vector of several fingerprints; one fingerprint is its own name.
    node = F.xxhash64(*keys) if extra else F.col("fp")
    distinct = materialize(
        docs.groupBy(*keys).agg(F.min("doc_id").alias("_least")).withColumn("node", node), "distinct"
    )
    roots = components(links(distinct, most, groups, wide_most)).withColumnRenamed("node", "_node")
    named = materialize(
        distinct.join(roots, F.col("node") == F.col("_node"), "left").select(
            *keys, "_least", F.coalesce("root", "node").alias("_root")
        ),
        "named",
    )
    least = materialize(named.groupBy("_root").agg(F.min("_least").alias("component_id")), "least")
    classes = materialize(named.join(least, "_root").select(*keys, "component_id"), "classes")
    return docs.join(classes, keys).select("doc_id", "fp", "component_id")


def add_sets(df: DataFrame, words: int, extra: int | None = None, text: str = "text") -> DataFrame:
    """Add ``node``, a 64-bit name of the set of shingles, and what is asked for of it.

    With ``extra``: ``fp`` and ``wide``, fingerprints in which every distinct shingle counts
    once; without: ``shingles``, the sorted hashes themselves.
    """

    def make():
        def fn(batch: pa.RecordBatch) -> dict:
            sets = [np.unique(shingle_hashes(x, words)) for x in texts_of(batch, text)]
            out = {"node": pa.array([_signed(xxhash.xxh64_intdigest(h.tobytes(), SEED)) for h in sets], pa.int64())}
            kind = pa.list_(pa.int64())
            if extra is None:
                return out | {"shingles": pa.array([h.view("i8") for h in sets], kind)}
            wide = [[_signed(fingerprint(_mixed(h, s))) for s in range(1, extra + 1)] for h in sets]
            fps = [_signed(fingerprint(h)) for h in sets]
            return out | {"fp": pa.array(fps, pa.int64()), "wide": pa.array(wide, kind)}

        return fn

    new = "shingles array<bigint>" if extra is None else "fp bigint, wide array<bigint>"
    return add_columns(df, make, f"node bigint, {new}")


def close_pairs(
    nodes: DataFrame, at: int, extra: int, groups: int, most: int, forests: bool = False
) -> DataFrame:
    """All pairs (a, b) of ``nodes`` (``node, root, fp, wide``) with different roots that meet in
    a grid cell of fingerprint number ``at`` and differ in at most ``most`` bits of all.

    With ``forests``, pairs that connect the same nodes: a cell gives no more than it has rows.
    """
    names = ["node", "root", *[f"p{i}" for i in range(extra + 1)]]

    def enter(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            wide = np.asarray(batch.column("wide").flatten(), "i8").reshape(len(fps), extra)
            prints = np.column_stack([fps, wide])
            rows, cells = grid_cells(np.ascontiguousarray(prints[:, at]), groups)
            data = np.column_stack([batch.column("node").to_numpy(), batch.column("root").to_numpy(), prints])
            for start in range(0, len(rows), 65536):
                part = slice(start, start + 65536)
                yield pa.RecordBatch.from_pydict(
                    {"cell": pa.array(cells[part].astype("i4"))}
                    | {n: pa.array(np.ascontiguousarray(c)) for n, c in zip(names, data[rows[part]].T, strict=True)}
                )

    def out(one: np.ndarray, two: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"a": pa.array(np.minimum(one, two), pa.int64()), "b": pa.array(np.maximum(one, two), pa.int64())}
        )

    def forest(data: np.ndarray):
        """A spanning forest of the close pairs of one cell."""
        left = np.arange(len(data))
        while len(left) > 1:
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                now = queue.pop()
                hit = close(data[left], data[now][None], most)
                if hit.any():
                    yield out(np.full(int(hit.sum()), data[now, 0]), data[left[hit], 0])
                    queue += left[hit].tolist()
                    left = left[~hit]

    def every(data: np.ndarray):
        """All close pairs of one cell, row by row."""
        for i in range(len(data) - 1):
            j = i + 1 + np.flatnonzero(close(data[i + 1 :], data[i][None], most))
            if len(j):
                yield out(np.full(len(j), data[i, 0]), data[j, 0])

    def inside(cells: np.ndarray, data: np.ndarray):
        """The pairs of whole cells: small ones all at once, large (or dense) ones by themselves."""
        cuts = np.flatnonzero(np.diff(cells)) + 1
        begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(cells)]])
        size = ends - begins
        few = np.repeat(size <= FEW, size)
        one, two = [], []
        for step in range(1, int(size[size <= FEW].max(initial=0))):
            i = np.flatnonzero(few[:-step] & (cells[:-step] == cells[step:]))
            i = i[close(data[i], data[i + step], most)]
            one.append(i)
            two.append(i + step)
        one, two = np.concatenate([[], *one]).astype("i8"), np.concatenate([[], *two]).astype("i8")
        cell_of = np.repeat(np.arange(len(size)), size)
        dense = forests & (np.bincount(cell_of[one], minlength=len(size)) > size)
        sparse = ~dense[cell_of[one]]
        if sparse.any():
            yield out(data[one[sparse], 0], data[two[sparse], 0])
        grown = dense | (size > FEW)
        for start, end in zip(begins[grown].tolist(), ends[grown].tolist(), strict=True):
            yield from (forest if forests else every)(data[start:end])

    def meet(batches):
        for cells, data in whole_groups(batches, "cell", names):
            yield from inside(cells, data)

    columns = ", ".join(f"{n} bigint" for n in names)
    entered = nodes.select("node", "root", "fp", "wide").mapInArrow(tidy(enter), f"cell int, {columns}")
    met = entered.repartition("cell").sortWithinPartitions("cell").mapInArrow(tidy(meet), "a bigint, b bigint")
    return met.distinct()


def close(one: np.ndarray, two: np.ndarray, most: int) -> np.ndarray:
    """Whether rows (node, root, fingerprints) have different roots and differ in few bits."""
    bits = np.bitwise_count((one[..., 2:] ^ two[..., 2:]).view("u8")).sum(axis=-1, dtype="i4")
    return (bits <= most) & (one[..., 1] != two[..., 1])


def whole_groups(batches, key: str, names: list[str]):
    """(keys, rows of ``names``) of one or more whole groups of batches sorted by ``key``."""
    # The rows of the last group wait in parts until the group ends.
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        keys = batch.column(key).to_numpy()
        if not len(keys):
            continue
        data = np.column_stack([batch.column(n).to_numpy() for n in names])
        last = int(np.searchsorted(keys, keys[-1]))
        if waiting and (last or waiting[0][0][0] != keys[0]):
            yield tuple(map(np.concatenate, zip(*waiting, (keys[:last], data[:last]), strict=True)))
            waiting = []
        elif last:
            yield keys[:last], data[:last]
        waiting.append((keys[last:], data[last:]))
    if waiting:
        yield tuple(map(np.concatenate, zip(*waiting, strict=True)))


def shingle_sets(wanted: DataFrame, nodes: DataFrame, df: DataFrame, words: int) -> DataFrame:
    """``node, shingles`` of the nodes in ``wanted``, made of one text for each node."""
    keys = materialize(nodes.join(wanted, "node", "left_semi").select("key"), "wanted")
    keyed = df.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    texts = keyed.join(shared(keys), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    return materialize(add_sets(texts, words).select("node", "shingles"), "sets")


def group_links(rooted: DataFrame, pairs: DataFrame, nodes: DataFrame, df: DataFrame, words: int,
                extra: int, most: int) -> DataFrame:
    """Links (a, b) that connect the nodes as all close pairs with similar sets do.

    The candidate ``pairs`` connect groups, and each node brings its set to its group once. A
    group of more than ``BLOCK`` nodes is dealt into blocks, and every two blocks meet in a
    task of their own. Two nodes that links found before already connect are not compared.
    """
    groups = materialize(components(pairs).withColumnRenamed("root", "grp"), "groups")
    blocks = groups.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    member = groups.join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    # Blocks i <= j meet under one name; a block alone meets itself.
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.xxhash64(
        "grp", F.least("block", x), F.greatest("block", x)
    ))
    sets = shingle_sets(groups.select("node"), nodes, df, words)
    dealt = member.select("node", F.explode(meets).alias("meet"))
    rows = dealt.join(rooted, "node").join(sets, "node").select("meet", "node", "root", "fp", "wide", "shingles")

    def link(keys: list[tuple], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        data = np.array(keys, "i8").reshape(len(keys), extra + 3)
        found = []
        for i in range(len(data) - 1):
            for j in (i + 1 + np.flatnonzero(close(data[i + 1 :], data[i][None], most))).tolist():
                if data[i, 1] == data[j, 1]:
                    continue
                x, y = sets[i], sets[j]
                least, total = min(len(x), len(y)), len(x) + len(y)
                if 9 * least < 4 * total:  # even the smaller set as a whole would not do
                    continue
                # Jaccard >= 4 / 5 in whole numbers.
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 5 * both >= 4 * (total - both):
                    found.append((int(data[i, 0]), int(data[j, 0])))
                    data[data[:, 1] == data[j, 1], 1] = data[i, 1]
        return found

    def run(batches):
        now, keys, held = None, [], []
        for batch in batches:
            meet = batch.column("meet").to_pylist()
            wide = np.asarray(batch.column("wide").flatten(), "i8").reshape(len(meet), extra).tolist()
            shingles = batch.column("shingles")
            for i, (node, root, fp) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("node", "root", "fp")),
                                                     strict=True)):
                if meet[i] != now:
                    yield edges(link(keys, held))
                    now, keys, held = meet[i], [], []
                keys.append((node, root, fp, *wide[i]))
                held.append(np.array(shingles[i].values.to_numpy(zero_copy_only=False)))
        yield edges(link(keys, held))

    def edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    met = rows.repartition("meet").sortWithinPartitions("meet", "node").mapInArrow(tidy(run), "a bigint, b bigint")
    ordered = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return materialize(ordered.distinct(), "similar")


def similar(edges: DataFrame, nodes: DataFrame, df: DataFrame, words: int) -> DataFrame:
    """The ``edges`` whose shingle sets have a Jaccard similarity of 0.8 or more.

    Sets are made only of the texts of nodes that have edges, one text for each node.
    """
    edges = materialize(edges, "candidate-edges")
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    sets = shingle_sets(ends, nodes, df, words)
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    # Jaccard >= 4 / 5 in whole numbers.
    enough = 5 * both >= 4 * (F.size("x") + F.size("y") - both)
    return materialize(edges.join(one, "a").join(two, "b").filter(enough).select("a", "b"), "similar")


def jaccard_classes(
    df: DataFrame, words: int = 5, extra: int = 2, groups: int = 3, most: int = 48
) -> DataFrame:
    """``doc_id, key, component_id, first``: documents linked by Jaccard similarity >= 0.8 of their
    sets of shingles, directly or not; ``key`` is XXH64 of the text. ``first`` is the
    smallest (doc_id is null, doc_id, key) of the component.

    Candidates meet in a grid cell of any of the ``1 + extra`` fingerprints and differ in at
    most ``most`` of all their bits (at a similarity of 0.8 about 29 of 192); the sets decide.
    A first round over forests of close prints joins large groups; the second compares the sets
    of what the first has not joined, in groups that candidates connect. Equal sets are one node from the start, and so are
    texts without words. Ids are treated as in ``near_duplicates``.
    """
    rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = materialize(
        add_sets(rows.withColumn("key", F.xxhash64("text")), words, extra).drop("text"), "prints"
    )
    # Fingerprints follow from the set, so all rows of a node have the same.
    nodes = materialize(
        docs.groupBy("node", "fp", "wide").agg(F.min("key").alias("key"),
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("_least"),),
        "nodes",
    )
    sure = similar(links(nodes, 8, groups, 20), nodes, df, words)
    first = components(sure).withColumnRenamed("node", "_node")
    rooted = materialize(
        nodes.join(first, F.col("node") == F.col("_node"), "left").select(
            "node", "fp", "wide", F.coalesce("root", "node").alias("root")
        ),
        "rooted",
    )
    parts = [materialize(close_pairs(rooted, at, extra, groups, most, True), "pairs") for at in range(extra + 1)]
    pairs = parts[0]
    for part in parts[1:]:
        pairs = pairs.unionByName(part)
    more = group_links(rooted, pairs.distinct(), nodes, df, words, extra, most)
    roots = components(sure.unionByName(more)).withColumnRenamed("node", "_node")
    named = materialize(
        nodes.join(roots, F.col("node") == F.col("_node"), "left").select(
            "node", "_least", F.coalesce("root", "node").alias("_root")
        ),
        "named",
    )
    least = materialize(named.groupBy("_root").agg(F.min("_least").alias("first")), "least")
    classes = materialize(named.join(least, "_root").select("node", "first"), "classes")
    return docs.join(classes, "node").select(
        "doc_id", "key", F.col("first.doc_id").alias("component_id"), "first"
    )


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def document_classes(documents: DataFrame) -> DataFrame:
    return near_duplicates(documents).select(
        "doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id"
    )
