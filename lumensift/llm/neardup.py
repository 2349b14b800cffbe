"""Near-duplicate documents by a chosen-path set similarity join on word shingles.

A document is its set of distinct 5-word shingles. Equal sets are one class from the start, so thousands of copies are one
member of the join. Each of several independent trees sends a class down a path of minwise tokens: at every level the token
of the set that is smallest under a random order of that level picks the branch. Sets of similarity s stay together at a
level with probability s, so after a few levels only similar sets share a node. A node of a few classes isn't split any
further; with 12 trees of at most 3 levels a pair of similarity 0.85 meets in some node with probability above 0.99998.

Nodes are compared exhaustively. The pairs of a node of a few classes are listed, and confirmed on the full sets. Larger nodes
are the ones that the trees couldn't split, most often near copies of one text: all their classes are compared with one of them first.
What is then connected needs no comparison with each other; the classes left outside the largest component of their node meet
all of the node's full sets, in blocks of bounded size, and a task returns one row for each class, however many of them are linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph

K = 5
TREES, LEVELS = 12, 3
#: A node of at most so many classes isn't split, and its pairs are listed.
SMALL = 4
#: Classes of a larger node, and bytes of their sets, in one of the two blocks that a task compares.
BLOCK, BLOCK_BYTES = 512, 32 << 20
#: Pairs whose signatures agree in fewer places are not similar: at 0.85, that many or fewer agree once in 10 million pairs.
AGREE = 0.5


def orders(n: int) -> np.ndarray:
    return np.random.default_rng(20231).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sets(hashes: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, text after text, and their numbers."""
    begins = common.row_starts(many)
    found = [np.unique(hashes[a:b]) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
    return (np.concatenate(found) if found else hashes), np.array([len(x) for x in found], np.int64)


def class_ids(items: np.ndarray, many: np.ndarray) -> pa.Array:
    """A 128-bit fingerprint of each set; null for an empty one."""
    out = np.zeros((len(many), 2), np.uint64)
    some = many > 0
    if some.any():
        first = common.row_starts(many)[:-1][some]
        for i, salt in enumerate((0xA0761D6478BD642F, 0xE7037ED1A0B428DB)):
            out[some, i] = common.mixed(np.add.reduceat(common.mixed(items ^ np.uint64(salt)), first) + many[some].astype(np.uint64))
    return pa.array([r.tobytes() if ok else None for r, ok in zip(out, some, strict=True)], pa.binary())


def signed(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, cls, mins) of every document: one pass, no shuffle."""
    factor = orders(TREES * LEVELS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in common.text_slices(batches):
            *_, hashes, counts = common.words_of(part.column("text"))
            items, many = sets(*common.shingle_hashes(hashes, counts, k))
            mins = np.zeros((len(many), len(factor)), np.uint32)
            some = many > 0
            if some.any():
                first = common.row_starts(many)[:-1][some]
                for i, f in enumerate(factor):
                    mins[some, i] = np.minimum.reduceat(((items * f) >> np.uint64(32)).astype(np.uint32), first)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(many) + 1, dtype=np.int32) * len(factor)), pa.array(mins.view(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(many), class_ids(items, many), lists], names=["doc_id", "n_shingles", "cls", "mins"])

    return docs.select("doc_id", "text").mapInArrow(run, f"{common.fields(docs, ['doc_id'])}, n_shingles long, cls binary, mins array<int>")


def nodes(classes: DataFrame) -> DataFrame:
    """(node, cls): the classes of every node of every tree that isn't split further and has two or more."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    rows = classes.select("cls", "mins", tree)
    path = F.xxhash64(F.col("tree"), F.element_at("mins", F.col("tree") * LEVELS + 1))
    paths = [path]
    for level in range(1, LEVELS):
        path = F.xxhash64(path, F.element_at("mins", F.col("tree") * LEVELS + 1 + level))
        paths.append(path)
    rows = rows.select("cls", *[p.alias(f"k{i}") for i, p in enumerate(paths)])
    out = None
    for level in range(LEVELS):
        k = f"k{level}"
        size = rows.groupBy(k).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        rows = common.written(rows.join(size, k), "nodes")
        done = rows if level == LEVELS - 1 else rows.filter(F.col("n") <= SMALL)
        done = done.select(F.col(k).alias("node"), "cls", "n")
        out = done if out is None else out.unionByName(done)
        rows = rows.filter(F.col("n") > SMALL).drop("n")
    return out


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose signatures agree in enough places."""
    own = classes.select("cls", "mins")
    p = pairs.join(own.select(F.col("cls").alias("a"), F.col("mins").alias("x")), "a").join(own.select(F.col("cls").alias("b"), F.col("mins").alias("y")), "b")
    same = F.size(F.filter(F.zip_with("x", "y", lambda x, y: x == y), lambda x: x))
    return p.filter(same >= AGREE * TREES * LEVELS).select("a", "b")


def full_sets(wanted: DataFrame, docs: DataFrame, classes: DataFrame, k: int = K) -> DataFrame:
    """(cls, items) of the wanted classes, from the text of each class's first document."""
    wanted = common.written(wanted.join(classes, "cls").select("cls", F.xxhash64("first_id").alias("_h")), "wanted")
    texts = docs.select(F.xxhash64("doc_id").alias("_h"), "text").join(wanted.select("_h").distinct(), "_h", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in common.text_slices(batches):
            *_, hashes, counts = common.words_of(part.column("text"))
            items, many = sets(*common.shingle_hashes(hashes, counts, k))
            at = common.row_starts(many)
            yield pa.RecordBatch.from_arrays([class_ids(items, many), common.binary([items[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)])], names=["cls", "items"])

    found = texts.select("text").mapInArrow(run, "cls binary, items binary").join(wanted.select("cls"), "cls", "left_semi")
    return common.written(found.dropDuplicates(["cls"]), "sets")


def confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes, those whose full sets have percent * union <= 100 * intersection."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    p = pairs.join(full.select(F.col("cls").alias("a"), F.col("items").alias("x")), "a").join(full.select(F.col("cls").alias("b"), F.col("items").alias("y")), "b")
    return p.select("a", "b", "x", "y").mapInArrow(compare, "a binary, b binary")


def linked(items: list[np.ndarray], percent: int, columns: int = 4096) -> np.ndarray:
    """Whether each two of some sets are similar enough: a matrix. Tokens are taken `columns` at a time."""
    n = len(items)
    size = np.array([len(x) for x in items], np.int64)
    token, place, times = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1  # tokens of one set alone are in no intersection
    use = times[place] > 1
    column, row = number[place[use]], np.repeat(np.arange(n), size)[use]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    both = np.zeros((n, n), np.float32)
    for at in range(0, int(number[-1]) + 1, columns):
        a, b = np.searchsorted(column, [at, at + columns])
        m = np.zeros((n, columns), np.float32)
        m[row[a:b], column[a:b] - at] = 1
        both += m @ m.T
    both = both.astype(np.int64)
    return (100 * both >= percent * (size[:, None] + size[None] - both)) | np.eye(n, dtype=bool)


def unsettled(large: DataFrame, parts: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, cls, open, i, j): of nodes (node, cls) that aren't in one component (parts: id, component) as a whole, each class in every task
    (i, j) it takes part in. Open are classes outside their node's largest component; all of these meet, and each meets the others."""
    own = large.join(parts.select(F.col("id").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls")).join(classes.select("cls", "n_shingles"), "cls")
    sizes = own.groupBy("node", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("items"))
    most = F.max(F.struct("n", "component", "items"))
    per = sizes.groupBy("node").agg(most.alias("most"), F.sum("n").alias("n"), F.sum("items").alias("items"), F.count(F.lit(1)).alias("components")).filter("components > 1")
    many = lambda n, items: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(items * 8 / BLOCK_BYTES)).cast("int")
    per = per.select("node", F.col("most.component").alias("largest"), many(F.col("n") - F.col("most.n"), F.col("items") - F.col("most.items")).alias("blocks"), many(F.col("most.n"), F.col("most.items")).alias("others"))
    rows = own.join(per, "node").withColumn("open", F.col("component") != F.col("largest"))
    mine = F.pmod(F.xxhash64("cls", "node"), F.when(F.col("open"), F.col("blocks")).otherwise(F.col("others"))).cast("int")
    rows = rows.withColumn("mine", mine)
    task = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    blocks, others = F.sequence(F.lit(0), F.col("blocks") - 1), F.sequence(F.lit(0), F.col("others") - 1)
    both = F.transform(blocks, lambda k: task(F.least("mine", k), F.greatest("mine", k)))
    rest = F.transform(others, lambda k: task(F.col("mine"), F.col("blocks") + k))
    tasks = F.when(F.col("open"), F.concat(both, rest)).otherwise(F.transform(blocks, lambda k: task(k, F.col("blocks") + F.col("mine"))))
    return rows.select("node", "cls", "open", F.explode(tasks).alias("task")).select("node", "cls", "open", "task.i", "task.j")


def compared(tasks: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(a, b): each class of a task of `unsettled` tied to the smallest one in it that it is linked with, directly or not."""
    rows = tasks.select("node", "i", "j", "cls").join(full, "cls")

    def compare(group: pa.Table) -> pa.Table:
        ids = group.column("cls").to_pylist()
        label = np.arange(len(ids))
        order = np.array(sorted(range(len(ids)), key=ids.__getitem__))
        near = linked([np.frombuffer(group.column("items")[int(i)].as_buffer(), np.uint64) for i in order], percent)
        while True:  # the smallest label around, until nothing changes
            now = np.where(near, label[None], len(ids)).min(axis=1)
            now = now[now]
            if (now == label).all():
                break
            label = now
        tied = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table([common.binary([ids[order[label[i]]] for i in tied]), common.binary([ids[order[i]] for i in tied])], names=["a", "b"])

    return rows.groupBy("node", "i", "j").applyInArrow(compare, "a binary, b binary")


def groups(docs: DataFrame, percent: int = 80, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id, text, ...).

    Documents are linked if 100 * intersection >= percent * union of their shingle sets. A text of 1 to k-1 words is one
    shingle, the whole sequence; a null text or one without words has an empty set and is linked with nothing. Repeated
    rows are copies like any others. Rows whose doc_id is null take part; component_id leaves null ids out, unless a
    component has no others. An empty table gives an empty one. Other columns are not used.
    """
    features = common.written(signed(docs, k), "signed")
    classes = features.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.first("mins").alias("mins"), F.first("n_shingles").alias("n_shingles"))
    classes = common.written(classes, "classes")
    leaves = nodes(classes)
    few = leaves.filter(F.col("n") <= SMALL)
    pairs = few.select("node", F.col("cls").alias("a")).join(few.select("node", F.col("cls").alias("b")), "node").filter("a < b").select("a", "b")
    large = common.written(leaves.filter(F.col("n") > SMALL).select("node", "cls"), "large")
    stars = large.groupBy("node").agg(F.min("cls").alias("a")).join(large.withColumnRenamed("cls", "b"), "node").filter("a <> b").select("a", "b")
    pairs = common.written(likely(pairs.unionByName(stars).distinct(), classes), "likely")
    full = full_sets(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).unionByName(large.select("cls")).distinct(), docs, classes, k)
    parts = common.written(graph.components(confirmed(pairs, full, percent)), "parts")
    tasks = common.written(unsettled(large, parts, classes), "tasks")
    if not tasks.isEmpty():
        parts = graph.components(parts.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(compared(tasks, full, percent)))
    ids = classes.select("cls", "first_id").join(parts.withColumnRenamed("id", "cls"), "cls")
    least = ids.groupBy("component").agg(F.min("first_id").alias("least_id"))
    moved = ids.join(least, "component").select("cls", "least_id")
    named = common.written(classes.select("cls", "first_id").join(moved, "cls", "left").select("cls", F.coalesce("least_id", "first_id").alias("component_id")), "named")
    out = features.select("doc_id", "n_shingles", "cls").join(named, "cls", "left")
    out = out.withColumn("component_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with one document of each group: the one of smallest doc_id. Equal rows of that id leave one.

    A document without an id stays if its whole group has none.
    """
    stay = groups(docs, percent).filter("kept").select(F.xxhash64("doc_id").alias("neardup_kept")).distinct()
    return docs.join(stay, F.xxhash64(docs["doc_id"]) == stay["neardup_kept"], "left_semi").dropDuplicates(["doc_id", "text"])


#: groups() at 85 % for DuckDB, by counting the shingles that each two documents share.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(shingle) AS h FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS shingle FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS id, a AS seen FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a),
c AS (SELECT id, min(seen) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id
"""
