"""Documents joined by Jaccard similarity of their word shingles, with adaptive multi-match prefixes.

Two sets with a similarity of t or more, ordered by one global order, share at least k elements among the first
n - ceil(t n) + k of each, for every k. Each document picks its k: a longer prefix is met in more places but asks for more
shared elements, and the one with the least estimated cost is taken. Pairs need as many shared prefix elements as the smaller of their two k. The
order is by an estimate of frequency from a sketch of fixed size, rare first; any order gives the same result. The sketch has
cells enough that elements of some fifty sets stand out from what else falls in their cells: else they come into prefixes, and
all that hold one are compared as a group.

Documents with one set are one class from the start. An element in the prefixes of up to SMALL classes makes pairs, at most
SMALL / 2 a posting. Where more meet, as in large groups of near copies, no pairs are made: all that share such an element are
compared with one of them. Where that leaves more than one component, those whose marks come near to one of another component
are put in blocks, pairs of blocks are compared in a task each, and only edges of a spanning forest come out.

Two sets of known sizes that are linked share more of their prefixes than the least k that holds for all sizes, and their
marks (the parity of the number of elements in each of MARKS cells) differ in no more cells than the sets do in elements. Both are asked of a
pair before any text is moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedlens.llm.common import batches_of, in_groups, rows_of, stored
from fedlens.llm.components import components
from fedlens.llm.shingles import shingle_sets

SKETCH = 1 << 21
#: Cells of the sketch that travel together, one byte each or as a list of those in use.
CELLS = 4096
LONGEST_K = 4
VERIFY_COST = 20.0
SMALL = 48
BLOCK = 512
#: The same where marks are compared and no texts.
MARKED_BLOCK = 2048
RARE = 24
MARKS = 1024
#: A token whose cell of the sketch holds more than this, or OFTEN times the usual cell, is dealt over SPREAD tasks.
OFTEN, OFTEN_USES, SPREAD = 4, 20_000, 200
HELD = 1 << 15
SETS = "doc_id long, set_id long, n long, at int, cells binary, marks array<long>"


def set_key(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def marks_of(tokens: np.ndarray) -> np.ndarray:
    """Whether the number of elements in each cell is odd, 64 cells a number."""
    odd = np.bincount((tokens >> np.uint64(40)).astype("int64") % MARKS, minlength=MARKS) & 1
    return np.packbits(odd.astype("uint8")).view("int64")


LISTED = np.dtype([("at", "<u2"), ("uses", "<u4")])


def parts_of(sketch: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The sketch in parts of CELLS with a number each: a byte a cell, or where that is shorter or too small, a list."""
    for start in range(0, len(sketch), CELLS):
        uses = sketch[start : start + CELLS]
        uses = np.pad(uses, (0, CELLS - len(uses)))
        at = np.flatnonzero(uses)
        if len(at) * LISTED.itemsize >= CELLS:
            yield start // CELLS, np.minimum(uses, 255).astype("uint8").tobytes()
            uses = uses - np.minimum(uses, 255)
            at = np.flatnonzero(uses)
        for some in np.array_split(at, 1 + len(at) * LISTED.itemsize // CELLS) if len(at) else ():
            listed = np.zeros(len(some), LISTED)
            listed["at"], listed["uses"] = some, uses[some]
            yield start // CELLS, listed.tobytes()


def added(parts: Iterator[tuple[int, bytes]]) -> dict[int, np.ndarray]:
    """Sums of the parts by their number. A list is always shorter than CELLS bytes, and a part of bytes never is."""
    total: dict[int, np.ndarray] = {}
    for part, cells in parts:
        uses = total.setdefault(part, np.zeros(CELLS, "int64"))
        if len(cells) == CELLS:
            uses += np.frombuffer(cells, "uint8")
        else:
            listed = np.frombuffer(cells, LISTED)
            uses[listed["at"]] += listed["uses"]
    return total


def summed(rows: DataFrame) -> np.ndarray:
    """The sketch of all rows, in two bytes a cell as long as cells that are used often can be told by them, else in four."""
    schema = pa.schema([("at", pa.int32()), ("cells", pa.binary())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, uses in added(rows_of(batches)).items():
            kind = "<u2" if uses.max() < 1 << 16 else "<u4"
            cells = np.minimum(uses, (1 << 32) - 1).astype(kind).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([cells])], schema=schema)

    parts = rows.where(F.col("at").isNotNull()).select("at", "cells").repartition("at").mapInArrow(add, "at int, cells binary").toArrow()
    sketch = np.zeros(-(-SKETCH // CELLS) * CELLS, "uint32")
    for part, cells in zip(*(c.to_pylist() for c in parts.columns)):
        sketch[part * CELLS : (part + 1) * CELLS] = np.frombuffer(cells, f"<u{len(cells) // CELLS}")
    most = max(OFTEN * float(np.median(sketch)), OFTEN_USES)
    return (np.minimum(sketch, (1 << 16) - 1).astype("uint16") if most < (1 << 16) - 1 else sketch)[:SKETCH]


def measured(docs: DataFrame, size: int) -> DataFrame:
    """A row per document with its set's key, size and marks, and rows ``at, cells`` that add up to the sketch."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("set_id", pa.int64()), ("n", pa.int64()), ("at", pa.int32()), ("cells", pa.binary()), ("marks", pa.list_(pa.int64()))]
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, "int64")

        def rows() -> Iterator[tuple]:
            for group in in_groups(rows_of(batches)):
                sets = shingle_sets([text for _, text in group], size)
                np.add.at(sketch, (np.concatenate(sets) % np.uint64(SKETCH)).astype("int64"), 1)
                for (doc_id, _), tokens in zip(group, sets):
                    yield (doc_id, set_key(tokens), len(tokens), None, None, marks_of(tokens)) if len(tokens) else (doc_id, None, 0, None, None, None)
            for at, cells in parts_of(sketch):
                yield None, None, None, at, cells, None

        yield from batches_of(rows(), schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(measure, SETS)


def prefix(tokens: np.ndarray, sketch: np.ndarray, usual: float, percent: int) -> tuple[np.ndarray, int]:
    """The prefix of a set and the number of shared elements it asks for; ``usual`` is the sketch's median."""
    n = len(tokens)
    needed = -(-n * percent // 100)
    uses = sketch[(tokens % np.uint64(SKETCH)).astype("int64")]
    order = np.lexsort((tokens, uses))[: n - needed + LONGEST_K]
    tokens, uses = tokens[order], uses[order]
    others = np.cumsum(np.maximum(uses - usual, 1.0) - 1)
    costs = []
    for k in range(1, min(LONGEST_K, needed) + 1):
        length = n - needed + k
        met = others[min(length, len(others)) - 1]
        costs.append(length + met + VERIFY_COST * met / k)
    k = 1 + int(np.argmin(costs))
    return tokens[: n - needed + k], k


def postings(docs: DataFrame, shared, size: int, percent: int) -> DataFrame:
    """``token, set_id, about`` of every prefix element; ``about`` packs n, k and, of a token that many may hold, a number by set."""
    schema = pa.schema([(x, pa.int64()) for x in ("token", "set_id", "about")])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value
        usual = float(np.median(sketch))
        often = max(OFTEN * usual, OFTEN_USES)
        chosen, about, n = [], [], 0

        def sent() -> pa.RecordBatch:
            key, packed = np.repeat(np.array(about, "int64"), [len(c) for c in chosen], axis=0).T
            tokens = np.concatenate(chosen)
            hot = sketch[(tokens % np.uint64(SKETCH)).astype("int64")] > often
            packed = packed + np.where(hot, 1 + key % SPREAD, 0)
            return pa.RecordBatch.from_arrays([pa.array(v) for v in (tokens.view("int64"), np.ascontiguousarray(key), packed)], schema=schema)

        for group in in_groups(rows_of(batches)):
            for tokens in shingle_sets([text for _, text in group], size):
                if len(tokens):
                    first, k = prefix(tokens, sketch, usual, percent)
                    chosen.append(first)
                    about.append((set_key(tokens), len(tokens) << 16 | k << 8))
                    n += len(first)
            if n >= 1 << 16:
                yield sent()
                chosen, about, n = [], [], 0
        if chosen:
            yield sent()

    return docs.select("doc_id", "text").mapInArrow(post, "token long, set_id long, about long")


def meetings(token: np.ndarray, key: np.ndarray, about: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``x, y, asked`` of whole lists of postings, in order of token and set: pairs that are alike in size with the number of
    prefix elements they must share if they are linked; members of a long list with its first (0); holders of a token that many may hold with it (-1)."""
    new = np.append(True, (token[1:] != token[:-1]) | (key[1:] != key[:-1]))
    token, key, about = token[new], key[new], about[new]
    hot = (about & 255) > 0
    yield key[hot], token[hot], np.full(hot.sum(), -1)
    token, key, about = token[~hot], key[~hot], about[~hot]
    if not len(token):
        return
    starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    lists = np.diff(np.append(starts, len(token)))
    long = np.repeat(lists > SMALL, lists)
    yield key[long], np.repeat(key[starts], lists)[long], np.zeros(long.sum(), "int64")
    n, k = about >> 16, about >> 8 & 255
    spare = k + n * percent // -100
    for uses in np.unique(lists[(lists > 1) & (lists <= SMALL)]).tolist():
        at = starts[lists == uses][:, None]
        i, j = np.triu_indices(uses, 1)
        a, b = (at + i).ravel(), (at + j).ravel()
        alike = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
        a, b = a[alike], b[alike]
        yield key[a], key[b], common(n[a] + n[b], percent) + np.minimum(spare[a], spare[b])


def common(total, percent: int):
    """Elements that linked sets of ``total`` elements together have in common at least."""
    return -(-(total * percent) // (100 + percent))


def met(posted: DataFrame, percent: int) -> DataFrame:
    """Meetings of all postings. They are dealt and sorted by token once; what is alone with its token ends there."""
    schema = pa.schema([(x, pa.int64()) for x in ("x", "y", "asked")])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n, enough = 0, HELD

        def told(columns: np.ndarray) -> Iterator[pa.RecordBatch]:
            for found in meetings(*columns, percent):
                for some in range(0, len(found[0]), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(f[some : some + (1 << 16)], pa.int64()) for f in found], schema=schema)

        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns]))
            n += batch.num_rows
            if n >= enough:
                columns = np.concatenate(held, axis=1)
                whole = int(np.searchsorted(columns[0], columns[0, -1]))
                yield from told(columns[:, :whole])
                held, n = [columns[:, whole:]], columns.shape[1] - whole
                enough = max(HELD, 2 * n)
        if n:
            yield from told(np.concatenate(held, axis=1))

    dealt = posted.repartition("token", F.col("about").bitwiseAND(F.lit(255)))
    return dealt.sortWithinPartitions("token", "set_id").mapInArrow(meet, "x long, y long, asked long")


def gathered(found: DataFrame) -> DataFrame:
    """``hub, set_id``: all that share a token which many sets hold, around one of them."""
    members = found.where("asked = 0").select(F.col("y").alias("hub"), F.col("x").alias("set_id"))
    often = found.where("asked = -1").select(F.col("y").alias("token"), F.col("x").alias("set_id"))
    hubs = often.groupBy("token").agg(F.min("set_id").alias("hub"), F.max("set_id").alias("high")).where("hub < high")
    return members.union(often.join(hubs, "token").select("hub", "set_id")).distinct()


def candidate_pairs(found: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets that share as many elements of their prefixes as is asked, and whose marks differ in few enough cells."""
    pairs = found.where("asked > 0").groupBy("x", "y").agg(F.count(F.lit(1)).alias("shared"), F.max("asked").alias("asked"))
    return alike(pairs.where("shared >= asked").select("x", "y"), classes, percent)


def alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``pairs`` without those whose marks differ in too many cells."""
    of = lambda side: classes.select(F.col("set_id").alias(side), F.col("n").alias(f"n_{side}"), F.col("marks").alias(f"marks_{side}"))
    marked = pairs.join(of("x"), "x").join(of("y"), "y")
    differ = F.zip_with("marks_x", "marks_y", lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    total = F.col("n_x") + F.col("n_y")
    least = F.expr(f"((n_x + n_y) * {percent} + {99 + percent}) div {100 + percent}")
    return marked.where(F.aggregate(differ, F.lit(0), lambda a, b: a + b) <= total - 2 * least).select("x", "y")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Candidate pairs whose sets reach the similarity."""
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for group in in_groups((x, b, y, a) for x, y, a, b in rows_of(batches)):
                firsts = {x: a for x, _, _, a in group}
                sets = dict(zip(firsts, shingle_sets(list(firsts.values()), size)))
                for (x, _, y, _), other in zip(group, shingle_sets([b for _, b, _, _ in group], size)):
                    if similar(sets[x], other, percent):
                        yield x, y

        yield from batches_of(rows(), schema)

    of = lambda side: texts.select(F.col("set_id").alias(side), F.col("text").alias(f"text_{side}"))
    joined = pairs.join(of("y"), "y").join(of("x"), "x").select("x", "y", "text_x", "text_y")
    return joined.mapInArrow(verify, "x long, y long")


def spanning(pairs: np.ndarray, size: int) -> np.ndarray:
    """The pairs that join two trees, in order."""
    root = list(range(size))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    kept = []
    for i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            root[b] = a
            kept.append((i, j))
    return np.array(kept, "int64").reshape(-1, 2)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Common elements of every two sets (above the diagonal).

    Elements that one set has can't be shared and are left out. Those of up to RARE sets add one to each of their pairs; the
    others, of which there are few, make a matrix whose product holds their share.
    """
    n = len(sets)
    _, place, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(place, kind="stable")
    row, of = row[order], uses[place[order]]
    both = np.zeros(n * n, "float32")
    for u in range(2, RARE + 1):
        holders = row[of == u].reshape(-1, u)
        i, j = np.triu_indices(u, 1)
        for some in np.array_split(holders, 1 + len(holders) * len(i) // (1 << 22)):
            np.add.at(both, (some[:, i] * n + some[:, j]).ravel(), 1)
    both = both.reshape(n, n)
    common = of > RARE
    column = np.cumsum(np.append(True, np.diff(place[order][common]) != 0)) - 1 if common.any() else np.zeros(0, "int64")
    row = row[common]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        some = (column >= start) & (column < start + 4096)
        part = np.zeros((n, 4096), "float32")
        part[row[some], column[some] - start] = 1
        both += part @ part.T
    return both


def forest(ids: np.ndarray, sets: list[np.ndarray], first: np.ndarray, percent: int, component: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links of different components between two blocks (``first`` marks one), or within one."""
    both, lengths = intersections(sets), np.array([len(s) for s in sets])
    linked = 100 * both >= percent * (lengths[:, None] + lengths[None, :] - both)
    linked &= component[:, None] != component[None, :]
    if not first.all():
        linked &= first[:, None] != first[None, :]
    i, j = np.nonzero(np.triu(linked, 1))
    kept = spanning(np.stack([i, j], 1), len(sets))
    return [(int(ids[a]), int(ids[b])) for a, b in kept]


def tiles(members: DataFrame, block: int) -> DataFrame:
    """``members`` (``hub, set_id`` and more) once for each two blocks ``i, j`` of their group that ``own``, theirs, is one of."""
    sizes = members.groupBy("hub").agg(F.count(F.lit(1)).alias("total"))
    held = members.join(sizes, "hub").withColumn("blocks", F.ceil(F.col("total") / block).cast("int"))
    held = held.withColumn("own", F.pmod(F.xxhash64("set_id", "hub"), F.col("blocks")).cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return held.select(*members.columns, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def reaching(n: np.ndarray, marks: np.ndarray, component: np.ndarray, percent: int) -> np.ndarray:
    """Which sets may be linked to one of another component, as far as sizes and marks tell."""
    found = np.zeros(len(n), bool)
    for at in range(0, len(n), 64):
        some = slice(at, at + 64)
        differ = np.bitwise_count(marks[some, None] ^ marks[None]).sum(2, dtype="int64")
        total = n[some, None] + n[None]
        found[some] = ((differ <= total - 2 * common(total, percent)) & (component[some, None] != component[None])).any(1)
    return found


def unsettled(members: DataFrame, classes: DataFrame, linked_pairs: DataFrame, percent: int) -> DataFrame:
    """``hub, set_id, component`` of the members that may be linked to a member of their group in another component.

    All that are linked to the hub are one component, and the others are one each. A group that is one component is settled;
    in the others marks are compared, without a text, two blocks at a time.
    """
    near_hub = linked_pairs.select(F.col("x").alias("hub"), F.col("y").alias("set_id"), F.col("x").alias("component"))
    whole = members.join(near_hub, ["hub", "set_id"], "left").withColumn("component", F.coalesce("component", "set_id"))
    several = whole.groupBy("hub").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("hub")
    marked = whole.join(several, "hub").join(classes.select("set_id", "n", "marks"), "set_id")

    def reach(pdf: pd.DataFrame) -> pd.DataFrame:
        marks = np.stack(pdf["marks"].to_list()).astype("int64").view("uint64")
        return pdf.loc[reaching(pdf["n"].to_numpy(), marks, pdf["component"].to_numpy(), percent), ["hub", "set_id", "component"]]

    near = tiles(marked.select("hub", "set_id", "component", "n", "marks"), MARKED_BLOCK).groupBy("hub", "i", "j")
    return near.applyInPandas(reach, "hub long, set_id long, component long").distinct()


def block_edges(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges between components within large groups; ``members`` has ``hub, set_id, component``. A group is cut in blocks of about BLOCK."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [s for some in in_groups(enumerate(pdf["text"])) for s in shingle_sets([t for _, t in some], size)]
        first = (pdf["own"] == pdf["i"]).to_numpy()
        edges = forest(pdf["set_id"].to_numpy(), sets, first, percent, pdf["component"].to_numpy())
        return pd.DataFrame(edges, columns=["x", "y"], dtype="int64")

    return tiles(members, BLOCK).join(texts, "set_id").groupBy("hub", "i", "j").applyInPandas(compare, "x long, y long")


def holding(texts: DataFrame, size: int) -> DataFrame:
    """``set_id, text`` of the rows of ``set_id, text`` whose text has that set: rows that repeat an id may differ in text."""
    schema = pa.schema([("set_id", pa.int64()), ("text", pa.string())])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for group in in_groups(rows_of(batches)):
                for (set_id, text), tokens in zip(group, shingle_sets([text for _, text in group], size)):
                    if len(tokens) and set_key(tokens) == set_id:
                        yield set_id, text

        yield from batches_of(rows(), schema, weight=lambda r: len(r[1]))

    return texts.select("set_id", "text").mapInArrow(keep, "set_id long, text string")


def linked(spark: SparkSession, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; a component's id is its smallest document.

    A document links to those whose sets have ``percent`` of the union in common. Null texts and texts without words have no
    shingles and link to nothing; a text shorter than a shingle is one shingle. Rows that repeat an id are one document;
    rows without an id get no component and link nothing. An empty table gives no rows. Only ``doc_id`` and ``text`` are
    read. Sets are compared by 64-bit hashes of shingles.
    """
    rows = stored(spark, measured(docs, size), "shingle-sets")
    shared = spark.sparkContext.broadcast(summed(rows))
    sets = rows.where(F.col("at").isNull()).select("doc_id", "set_id", "n")
    named = rows.where(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull())
    classes = named.groupBy("set_id", "n").agg(F.min("doc_id").alias("node"), F.first("marks").alias("marks"))
    classes = stored(spark, classes, "set-classes")

    posted = postings(docs.where(F.col("doc_id").isNotNull()), shared, size, percent)
    found = stored(spark, met(posted, percent), "meeting")
    members = stored(spark, gathered(found), "members")
    stars = alike(members.where("hub <> set_id").select(F.col("hub").alias("x"), F.col("set_id").alias("y")), classes, percent)
    pairs = stored(spark, candidate_pairs(found, classes, percent).union(stars).distinct(), "pairs")

    wanted = members.select("set_id").union(pairs.select("x")).union(pairs.select("y")).distinct()
    holders = wanted.join(classes, "set_id").select("set_id", F.col("node").alias("doc_id"))
    own = sets.join(holders, ["doc_id", "set_id"]).select("doc_id", "set_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(own, "doc_id")
    texts = holding(texts, size).dropDuplicates(["set_id"])
    texts = stored(spark, texts, "candidate-texts")

    linked_pairs = stored(spark, verified(pairs, texts, size, percent), "linked-pairs")
    open_members = stored(spark, unsettled(members, classes, linked_pairs, percent), "unsettled")
    edges = linked_pairs.union(block_edges(open_members, texts, size, percent))
    nodes = classes.select("set_id", "node")
    edges = edges.join(nodes.select(F.col("set_id").alias("x"), F.col("node").alias("u")), "x")
    edges = edges.join(nodes.select(F.col("set_id").alias("y"), F.col("node").alias("v")), "y").select("u", "v")
    copies = named.join(nodes, "set_id").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    repeated = named.groupBy("doc_id").agg(F.count_distinct("set_id").alias("sets")).where("sets > 1").select("doc_id")
    twice = copies.join(repeated.select(F.col("doc_id").alias("u")), "u")
    reached = stored(spark, components(spark, edges.union(twice)), "components")
    of_class = nodes.join(reached, "node", "left").select("set_id", F.coalesce("component", "node").alias("component"))
    return sets.join(of_class, "set_id", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )
