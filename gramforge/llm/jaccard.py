"""N-gram Jaccard join with prefix trees.

A document is the set of its distinct word n-grams, put in one global order: from the rarest in the corpus to the most
frequent, equal ones by hash. N-grams of one document alone can't be shared, so a document that has too many of them is
out at once. Documents that may link share an n-gram of their first ones in the order (their prefix), and meet in the group
of the first n-gram that they have in common. The sets of a group, from that n-gram on, are a prefix tree: a probe walks it
in order, overlaps counted along a shared path serve all sets behind it, and a branch is left when what remains of set and
probe can't make up the overlap that is needed.

Copies of one set are one document here: links are pairs of sets, and a document's links follow from them and from how many
documents have a set. Prefixes and bitmaps of sets go from task to task; a whole set is made, from its block, only for a
group in which places, sizes and bitmaps leave it another one to link with. Pairs stay in their task unless they are asked
for: counts and a forest of the links leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramforge.llm import blocks as B
from gramforge.llm.common import trim, written
from gramforge.llm.components import components, forest_of

U = np.uint64
#: Members of groups that a task compares, about.
TASK_SETS = 1500
#: Members of a prefix group that meet as many others in one task.
CHUNK = 512
#: Bits that describe a set when members of a prefix group meet.
BITS = 512


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams, and the number of the text of each; a text with fewer words has one n-gram of all. Words
    lie between ASCII white space; A-Z are lower-cased."""
    hashes, sizes = B.word_hashes([t.lower() for t in texts])
    total = len(hashes)
    text = np.repeat(np.arange(len(texts)), sizes)
    key = np.zeros(max(0, total - words + 1), np.uint64)
    for i in range(words):
        key = B.mixed((key + U(0x9E3779B97F4A7C15)) ^ hashes[i : len(key) + i])
    inside = text[: len(key)] == text[words - 1 :] if len(key) else np.zeros(0, bool)
    key, at = key[inside], text[: len(inside)][inside]
    short = np.flatnonzero((sizes > 0) & (sizes < words))
    if len(short):
        starts = np.cumsum(sizes) - sizes
        more = np.zeros(len(short), np.uint64)
        for k, i in enumerate(short.tolist()):
            h = np.array([sizes[i]], np.uint64)
            for w in hashes[starts[i] : starts[i] + sizes[i]]:
                h = B.mixed((h + U(0xD6E8FEB86659FD93)) ^ w)
            more[k] = h[0]
        key, at = np.concatenate([key, more]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        key, at = key[order], at[order]
    return key, at


def needed(a, b, percent: int):
    """The overlap from which sets of a and b elements link: 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def overlaps(probe: np.ndarray, members: list[np.ndarray], percent: int) -> list[int]:
    """For each member the overlap with the probe, or -1 once it can't be enough. All arrays ascend."""
    want = [int(needed(len(m), len(probe), percent)) for m in members]
    return walked(probe, members, tree_order(members), want)


def tree_order(members: list[np.ndarray]) -> list[int]:
    """The members sorted as sequences: their prefix tree laid out flat, a node being a prefix that neighbours share."""
    return sorted(range(len(members)), key=lambda i: members[i].astype(">u8").tobytes())


def walked(probe: np.ndarray, members: list[np.ndarray], order: list[int], want: list[int]) -> list[int]:
    """For each member that `order` (tree order) names the overlap with the probe, or -1 once it can't reach `want`."""
    out = [-1] * len(members)
    before = np.zeros(0, np.uint64)
    path = np.zeros(1, np.int64)  # overlap of each prefix of the path above, the empty one included
    for i in order:
        m = members[i]
        n = min(len(m), len(before), len(path) - 1)
        differ = np.flatnonzero(m[:n] != before[:n])
        shared = int(differ[0]) if len(differ) else n
        if min(len(m), len(probe)) < want[i]:
            continue
        path, depth = path[: shared + 1], shared
        before = m
        while True:
            # the probe's elements behind the last one of the path
            rest = len(probe) - (int(np.searchsorted(probe, m[depth - 1], "right")) if depth else 0)
            if int(path[-1]) + min(len(m) - depth, rest) < want[i]:
                break
            if depth == len(m):
                out[i] = int(path[-1])
                break
            step = m[depth : depth + 64]
            at = np.minimum(np.searchsorted(probe, step), len(probe) - 1)
            path = np.concatenate([path, path[-1] + np.cumsum(probe[at] == step)])
            depth += len(step)
    return out


class Elements:
    """The distinct n-grams of a block's texts (or of `only` some) as 64-bit numbers, the frequency class in the 8 highest
    bits. size: of each text's set; shared: how many of its elements other documents may have."""

    def __init__(self, texts: list[bytes], answers: pd.DataFrame, n: int, words: int, only: list[int] | None = None):
        keys, at = shingles(texts, words)
        kinds, place = np.unique(keys, return_inverse=True)
        level = B.classes_of(kinds, answers, n)
        if only is not None:
            asked = np.zeros(len(texts), bool)
            asked[only] = True
            at, place = at[asked[at]], place[asked[at]]
        once = np.unique(at * max(1, len(kinds)) + place)
        at, place = once // max(1, len(kinds)), once % max(1, len(kinds))
        self.value = level.astype(np.uint64)[place] << U(56) | kinds[place] >> U(8)
        self.size = np.bincount(at, minlength=len(texts))
        self.shared = np.bincount(at, weights=self.value >> U(56) > 0, minlength=len(texts))
        self.ends = np.append(0, np.cumsum(self.size))

    def of(self, i: int) -> np.ndarray:
        return np.sort(self.value[self.ends[i] : self.ends[i + 1]])


def described(blocks: DataFrame, classes: DataFrame, n: int, words: int, percent: int) -> DataFrame:
    """_id, _none (whether the id is null), _n (size of the set), _block and _place, and for those that may link _a, _b (128
    bits of the set), _head (the prefix elements that others may have, and their places) and _w: BITS bits, of which each
    element of the set flips one, so that two sets differ in as many elements at least as their bitmaps differ in bits."""

    def run(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        ids, none, texts = B.unpacked(block.iloc[0])
        e = Elements(texts, answers, n, words)
        out = []
        for i, (size, shared) in enumerate(zip(e.size.tolist(), e.shared.tolist(), strict=True)):
            row = (int(ids[i]), bool(none[i]), size, int(block["block"].iloc[0]), i)
            if size and 100 * shared >= percent * size and not none[i]:
                own = e.of(i)
                head = own[: size + percent * size // -100 + 1]
                at = np.flatnonzero(head >> U(56))  # what no other document has meets nobody
                bits = np.packbits(np.bincount((own % U(BITS)).astype(np.int64), minlength=BITS) & 1)
                sums = [int(B.mixed(own ^ x).sum().astype(np.int64)) for x in (U(0), U(0xA0761D6478BD642F))]
                out.append((*row, *sums, B.joined(head[at].tobytes(), at.astype("<u4").tobytes()), bits.tobytes()))
            else:
                out.append((*row, None, None, None, None))
        del texts, e
        trim()
        return pd.DataFrame(out, columns=["_id", "_none", "_n", "_block", "_place", "_a", "_b", "_head", "_w"]).astype({"_a": "Int64", "_b": "Int64"})

    schema = "_id long, _none boolean, _n long, _block long, _place int, _a long, _b long, _head binary, _w binary"
    return B.settled(blocks.groupBy("block").cogroup(classes.groupBy("block")).applyInPandas(run, schema), "described")


def prefixes(single: DataFrame) -> DataFrame:
    """A row for each prefix element of each set that others may have: _e, _id, _n, _at (its place in the set), and _q and
    _r, the two such elements before it (0 is none: its frequency class is 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [[np.frombuffer(x, t) for x, t in zip(B.parted(h), ("<u8", "<u4"), strict=True)] for h in batch.column("_head").to_pylist()]
            if heads:
                each = np.array([len(e) for e, _ in heads])
                before = lambda k: np.concatenate([np.concatenate([np.zeros(min(k, len(e)), np.uint64), e[: max(0, len(e) - k)]]) for e, _ in heads])
                columns = [before(0), np.repeat(batch.column("_id").to_numpy(), each), np.repeat(batch.column("_n").to_numpy(), each), np.concatenate([at for _, at in heads]).astype(np.int64), before(1), before(2)]
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], ["_e", "_id", "_n", "_at", "_q", "_r"])

    return single.select("_id", "_n", "_head").mapInArrow(run, "_e long, _id long, _n long, _at long, _q long, _r long")


def by_group(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows of each prefix group's pair of chunks in a task."""
    rows = rows.sort_values(["_e", "_i", "_j", "_id"], ignore_index=True)
    e, i, j = (rows[c].to_numpy() for c in ("_e", "_i", "_j"))
    starts = np.flatnonzero(np.concatenate([[True], (e[1:] != e[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    for a, b in pairwise([*starts.tolist(), len(rows)]):
        if b - a > 1:
            yield rows.iloc[a:b]


def may_meet(own: pd.DataFrame, percent: int) -> np.ndarray:
    """Which members of a prefix group may link and have none of their last elements before the group's in common (such
    pairs meet in an earlier group), as a matrix whose upper triangle counts."""
    n, at, chunk = (own[c].to_numpy() for c in ("_n", "_at", "_c"))
    k = np.arange(len(own))
    may = k[:, None] < k
    if own["_i"].iat[0] != own["_j"].iat[0]:
        may &= chunk[:, None] != chunk
    for x in ("_q", "_r"):
        for y in ("_q", "_r"):
            a, b = own[x].to_numpy(), own[y].to_numpy()
            may &= (a[:, None] != b) | (a == 0)[:, None]
    left = n - at - 1
    return may & ((100 + percent) * (1 + np.minimum(left[:, None], left)) >= percent * (n[:, None] + n))


def met_in(own: pd.DataFrame, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a prefix group's chunks (one or two of them) that link and have no common element before the group's,
    as positions in own."""
    at = own["_at"].to_numpy()
    may = may_meet(own, percent)
    k = np.arange(len(own))
    if may.any():  # pairs with an earlier common element meet in its group
        kinds, column, count = np.unique(np.concatenate([s[:a] for s, a in zip(sets, at, strict=True)]), return_inverse=True, return_counts=True)
        shared = np.flatnonzero(count > 1)
        for a in range(0, len(shared), 4096):
            part = shared[a : a + 4096]
            number = np.full(len(kinds), -1)
            number[part] = np.arange(len(part))
            where = number[column]
            has = np.zeros((len(own), len(part)), np.float32)
            has[np.repeat(k, at)[where >= 0], where[where >= 0]] = 1
            may &= has @ has.T == 0
    x, y = [], []
    if may.any():
        tree = [s[a:] for s, a in zip(sets, at, strict=True)]  # the root is the group's element
        order = np.array(tree_order(tree))
        size = np.array([len(s) for s in sets])
        for i in np.flatnonzero(may.any(1)):
            got = walked(tree[i], tree, order[may[i][order]].tolist(), needed(size, size[i], percent).tolist())
            found = [j for j, n in enumerate(got) if n >= 0]
            y += found
            x += [int(i)] * len(found)
    return np.array(x, np.int64), np.array(y, np.int64)


def dealt_to(tasks: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(tasks)).cast("int").alias("_task")


def met_groups(single: DataFrame, percent: int) -> DataFrame:
    """Members of prefix groups, in chunks, no more than two of them a group and task. Members stay only where places, sizes
    and bitmaps leave them another one to link with, so that few sets are made; groups whose members all have the same
    element before don't meet: they do so there. _task: what is compared together. Groups that have their smallest member in
    common go to the same tasks, as many as they need, for they have the others in common too."""
    heads = written(prefixes(single), "prefixes")
    size = heads.groupBy("_e").agg(F.count("*").alias("_g"), F.min("_q").alias("_u"), F.max("_q").alias("_v"))
    size = size.filter("_g > 1 and (_u != _v or _u = 0)").select("_e", F.ceil(F.col("_g") / CHUNK).cast("int").alias("_chunks"))
    own = heads.join(size, "_e").withColumn("_c", F.pmod(F.xxhash64("_id"), "_chunks").cast("int"))
    work = own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).select("_e", F.least("_c", "_o").alias("_i"), F.greatest("_c", "_o").alias("_j"), "_c", "_id", "_n", "_at", "_q", "_r")
    work = written(work, "members")
    tasks = max(8, -(-work.count() // (20 * TASK_SETS)))
    dealt = work.join(single.select("_id", "_w"), "_id").withColumn("_task", dealt_to(tasks, "_e", "_i", "_j"))
    kept = work.columns

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = [rows[kept].iloc[:0].assign(_root=0)]
        for own in by_group(rows):
            may = may_meet(own, percent)
            if may.any():
                n, w = own["_n"].to_numpy(), np.frombuffer(b"".join(own["_w"]), np.uint64).reshape(len(own), -1)
                bits = sum(np.bitwise_count(w[:, k][:, None] ^ w[:, k]).astype(np.int64) for k in range(w.shape[1]))
                may &= (100 + percent) * bits <= (100 - percent) * (n[:, None] + n)
                some = may.any(0) | may.any(1)
                if some.any():
                    out.append(own[kept][some].assign(_root=own["_id"][some].min()))
        return pd.concat(out)

    met = B.settled(dealt.groupBy("_task").applyInPandas(run, ", ".join(f"{c} {t}" for c, t in work.dtypes) + ", _root long"), "met")
    parts = met.groupBy("_root").agg(F.ceil(F.count("*") / TASK_SETS).cast("int").alias("_parts"))
    tasks = max(8, -(-met.count() // TASK_SETS))
    part = F.pmod(F.xxhash64("_e", "_i", "_j"), "_parts").cast("int").alias("_part")
    return written(met.join(parts, "_root").select(*kept, "_root", part).select(*kept, dealt_to(tasks, "_root", "_part")), "groups")


class Join:
    """The join of the documents of a table: rows has _id, _none, _n and _s (the number of the set, where it may link), and
    single the sets: _id (the number), _n, _own (the smallest id of the documents that have it), _copies (how many they
    are), and where the first of them is."""

    def __init__(self, docs: DataFrame, percent: int, words: int, id_col: str, text_col: str, carry: list[str] | None = None):
        self.percent, self.words = percent, words
        self.blocks = B.make_blocks(docs, id_col, text_col, carry)
        self.n = B.n_buckets(self.blocks)
        self.classes = B.frequency_classes(self.blocks, lambda texts: shingles(texts, words), self.n, "shingle-classes")
        every = described(self.blocks, self.classes, self.n, words, percent)
        first = every.filter("_head is not null").groupBy("_a", "_b", "_n").agg(F.min(F.struct("_id", "_block", "_place", "_head", "_w")).alias("_f"), F.count("*").alias("_copies"))
        first = first.select("_a", "_b", "_n", "_copies", F.col("_f._id").alias("_own"), "_f._block", "_f._place", "_f._head", "_f._w")
        self.single = written(first.withColumn("_id", F.monotonically_increasing_id()), "single-sets")
        number = self.single.select("_a", "_b", "_n", F.col("_id").alias("_s"))
        self.rows = written(every.select("_id", "_none", "_n", "_a", "_b").join(number, ["_a", "_b", "_n"], "left").select("_id", "_none", "_n", "_s"), "rows")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """_task, _id, _copies and _set (its elements) of the sets that tasks want (_task, _id), made in their blocks."""
        at = wanted.join(self.single.select("_id", "_block", "_place", "_copies"), "_id")
        none = lambda kind: F.lit(None).cast(kind)
        asked = at.select(F.col("_block").alias("block"), F.lit(-1).alias("bucket"), none("binary").alias("body"), "_task", "_id", "_place", "_copies")
        both = self.classes.select("block", "bucket", "body", none("int").alias("_task"), none("long").alias("_id"), none("int").alias("_place"), none("long").alias("_copies")).unionByName(asked)
        n, words = self.n, self.words

        def run(block: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            own = rows[rows["bucket"] < 0]
            out = own[["_task", "_id", "_copies"]].astype({"_task": "int32", "_id": "int64", "_copies": "int64"})
            if not len(own):
                return out.assign(_set=pd.Series([], dtype=object))
            places = sorted(set(own["_place"].astype(int)))
            e = Elements(B.unpacked(block.iloc[0])[2], rows[rows["bucket"] >= 0], n, words, places)
            made = {i: e.of(i).tobytes() for i in places}
            del e
            trim()
            return out.assign(_set=[made[int(i)] for i in own["_place"]])

        return self.blocks.groupBy("block").cogroup(both.groupBy("block")).applyInPandas(run, "_task int, _id long, _copies long, _set binary")

    def met(self, pairs: bool) -> DataFrame:
        """pairs: each link of different sets once, x and y. Else id, n, root: what each task found of a set's links, counted
        in documents, and the smallest set they lead to."""
        groups = met_groups(self.single, self.percent)
        percent = self.percent
        columns = ["x", "y"] if pairs else ["id", "n", "root"]

        def run(rows: pd.DataFrame, own_sets: pd.DataFrame) -> pd.DataFrame:
            sets = {i: np.frombuffer(s, np.uint64) for i, s in zip(own_sets["_id"].tolist(), own_sets["_set"], strict=True)}
            x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for own in by_group(rows):
                ids = own["_id"].to_numpy()
                a, b = met_in(own, [sets[i] for i in ids.tolist()], percent)
                x.append(ids[a])
                y.append(ids[b])
            x, y = np.concatenate(x), np.concatenate(y)
            if pairs:
                return pd.DataFrame({"x": np.minimum(x, y), "y": np.maximum(x, y)})
            weight = own_sets.set_index("_id")["_copies"]
            nodes, root = forest_of(x, y)
            n = pd.Series(np.concatenate([weight[y].to_numpy(), weight[x].to_numpy()])).groupby(np.concatenate([x, y])).sum()
            return pd.DataFrame({"id": nodes, "n": n[nodes].to_numpy(), "root": root}).astype("int64")

        sets = self.sets(groups.select("_task", "_id").distinct())
        both = groups.groupBy("_task").cogroup(sets.groupBy("_task"))
        return B.settled(both.applyInPandas(run, ", ".join(f"{c} long" for c in columns)), "joined")


def links(docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The join itself: members (id and set: one row for each row that has an id and a set that may be shared) and pairs
    (x < y: every link between different sets, once). Documents link if they have one set or sets that link."""
    own = Join(docs, percent, words, id_col, text_col)
    return own.rows.filter("_s is not null").select(F.col("_id").alias(id_col), F.col("_s").alias("set")), own.met(pairs=True)


def linked_documents(docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_shingles (size of its set), n_links (how many other rows it links with, copies
    included) and component_id (smallest id reachable by links, itself included). Rows link when 100 * intersection >=
    percent * union. A null text is empty; texts without words link with nothing; rows without an id neither link nor have a
    component. Rows that repeat an id are linked by it. A task holds one block, or one text that is longer, at about 120
    bytes a word, and the sets of some TASK_SETS members."""
    out = counted(Join(docs, percent, words, id_col, text_col))
    some = lambda c: F.when(~F.col("_none"), c)
    return out.select(some(F.col("_id")).alias(id_col), F.col("_n").alias("n_shingles"), F.coalesce("_k", F.lit(0)).alias("n_links"), some(F.coalesce("component_id", "_id")).alias("component_id"))


def counted(own: Join) -> DataFrame:
    """_id, _none, _n, _k (number of links, null for none) and component_id (null for a row by itself) of each row."""
    met = own.met(pairs=False)
    counts = own.single.select(F.col("_id").alias("_s"), "_own", "_copies").join(met.groupBy("id").agg(F.sum("n").alias("_l")).withColumnRenamed("id", "_s"), "_s", "left")
    counts = counts.select("_s", "_own", (F.col("_copies") - 1 + F.coalesce("_l", F.lit(0))).alias("_k"))
    rows = written(own.rows.join(counts, "_s", "left").select("_id", "_none", "_n", "_own", "_k"), "counted")
    names = own.single.select(F.col("_id").alias("n"), F.col("_own").alias("o"))
    ends = met.filter("id != root").select(F.col("id").alias("x"), F.col("root").alias("y")).distinct()
    ends = ends.join(names.withColumnRenamed("n", "x"), "x").select("y", F.col("o").alias("x")).join(names.withColumnRenamed("n", "y"), "y").select("x", F.col("o").alias("y"))
    found = components(ends.unionByName(rows.filter("_own != _id").select(F.col("_id").alias("x"), F.col("_own").alias("y"))))
    return rows.join(found.withColumnRenamed("id", "_id"), "_id", "left")


def without_near_copies(docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies: the one with the smallest id, rows without an id last. Rows are told
    apart by a key of their own, so that null and repeated ids link, stay and go like others. What goes is said to the
    blocks, which hold the rows: texts aren't shuffled for it."""
    key = "_row_key"
    while key in docs.columns:
        key += "_"
    carried = [c for c in docs.columns if c != text_col]
    own = Join(docs.withColumn(key, F.monotonically_increasing_id()), percent, words, key, text_col, carried)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.frombuffer(row["ids"], np.int64)
                ids = B.carried(row).field(id_col).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), row["block"])), pa.array(np.arange(len(keys), dtype=np.int32)), ids], ["_id", "block", "_place", "_doc"])

    at = own.blocks.select("block", "ids", "rest").mapInArrow(places, "_id long, block long, _place int, _doc long")
    rows = written(at.join(counted(own).select("_id", F.coalesce("component_id", "_id").alias("_part")), "_id"), "near-copies")
    first = rows.groupBy("_part").agg(F.min(F.struct(F.col("_doc").isNull().alias("_none"), "_doc", "_id")).alias("_f")).select(F.col("_f._id").alias("_id"))
    gone = rows.join(first, "_id", "left_anti").select("block", "_place")
    names = docs.columns

    def run(block: pa.Table, drops: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        texts, null = B.unpacked(row)[2], np.frombuffer(row["sizes"], np.int64) < 0
        keep = np.ones(len(texts), bool)
        keep[drops.column("_place").to_numpy()] = False
        rest = B.carried(row).filter(pa.array(keep))
        text = pa.array([None if n else t.decode() for t, n, k in zip(texts, null.tolist(), keep.tolist(), strict=True) if k], pa.string())
        del texts
        trim()
        return pa.Table.from_arrays([text if c == text_col else rest.field(c) for c in names], names)

    return own.blocks.groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(run, docs.schema)
