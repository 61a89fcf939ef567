"""N-gram Jaccard join: a MinHash LSH forest with exact verification.

A document's elements are its distinct runs of five words (lower case, letters and digits);
a shorter text's only element is the run of all its words. Documents with equal element
sets form a copy class, of which one row goes on.

Forest: ``TREES`` tries over signatures of ``LEVELS`` minimum hashes each. Documents that share a prefix
are a node. Matched prefixes are shortened from whole signatures on, level by level, until a
pair at the threshold is met in some tree with a chance of ``TARGET_RECALL`` (``least_depth``). That depth
follows from the threshold and the number of trees, and holds for all documents: to stop earlier
where a document has had matches, or where nodes are large, would lose pairs with them. What adapts
is the work: a node whose documents are connected already isn't looked at, so near copies are
settled in long prefixes, and short ones only bring together what they left apart.

A trie is dealt to tasks by subtrees, the nodes of the least depth; those with one document are
dropped at once. A task sorts a subtree's signatures and walks its nodes from the longest
prefixes up. Documents of a node in different components are compared by their signatures, and those
that agree well enough (far below the threshold, so that chance doesn't separate a true pair) are
connected. Connected components of these edges gather what may be similar.

Verification: within a component every pair is compared by its exact element sets. A pair is
never written; a task writes each document's number of links and edges that connect linked
documents. Components and subtrees of more than ``BLOCK`` members are dealt to pairs of blocks,
so that no task holds a large group, and no pair is lost. Tables are broadcast only if they have up to
``MOST_BROADCAST`` rows of a few numbers, and joined by a shuffle beyond.

Defined cases: a null text is in a class of its own without links; texts without words are
copies of each other if equal; texts of any length are taken whole; of equal sets the smallest id names
the class; repeated rows are copies; documents without links are classes
of their own; an empty table gives an empty result; columns besides the id and the text are
not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.common import durable, map_rows, pick, release, settle
from anamnesis.llm.components import components

WORDS = 5
THRESHOLD = 0.8
TREES, LEVELS = 32, 8
TARGET_RECALL = 0.9999
#: Signatures that agree in a smaller share aren't connected; at the threshold this is over
#: five standard deviations below the mean.
SIGNATURE_SHARE = 0.62
BLOCK = 1024
MOST_BROADCAST = 200_000
WORDS_REMEMBERED = 250_000
#: Elements hashed at once.
CHUNK = 8_192

_find_words = re.compile(r"\w+").findall
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def least_depth(threshold: float, trees: int, target: float, levels: int) -> int:
    """Where shortening ends: the longest prefix by which a pair at the threshold is met with the target's
    chance in some tree."""
    depth = levels
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Element sets and signatures of texts; words that repeat are hashed once."""

    def __init__(self, words: int = WORDS, trees: int = TREES, levels: int = LEVELS):
        self.words, self.trees, self.levels = words, trees, levels
        self.table: dict[str, int] = {}
        draws = np.random.default_rng(20).integers(0, 1 << 32, (2, trees * levels), np.uint64)
        self.times, self.plus = (draws[0] | np.uint64(1)).astype(np.uint32)[:, None], draws[1].astype(np.uint32)[:, None]

    def elements(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the text's word runs."""
        words = _find_words(text.lower())
        if not words:
            return np.zeros(0, np.uint64)
        table = self.table
        if len(table) > WORDS_REMEMBERED:
            table.clear()
        for word in {*words}.difference(table):
            table[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.array([table[w] for w in words], np.uint64)
        size = min(self.words, len(hashes))
        runs = np.full(len(hashes) - size + 1, size, np.uint64)
        for k in range(size):
            runs = runs * _ODD[0] + _mixed(hashes[k : len(hashes) - size + 1 + k] * _ODD[k % 5])
        return np.unique(_mixed(runs))

    def signature(self, elements: np.ndarray) -> np.ndarray:
        low = (elements >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.times), np.iinfo(np.uint32).max, np.uint32)
        for i in range(0, len(low), CHUNK):
            np.minimum(out, (self.times * low[i : i + CHUNK] + self.plus).min(axis=1), out=out)
        return out

    def prefixes(self, signature: np.ndarray, k: int) -> np.ndarray:
        """A key for each tree's prefix of length ``k``."""
        rows = signature.reshape(self.trees, self.levels)[:, :k].astype(np.uint64)
        out = np.arange(1, self.trees + 1, dtype=np.uint64)
        for j in range(k):
            out = _mixed(out * _ODD[1] + rows[:, j])
        return out.view(np.int64)


_hashers: dict[tuple, Hasher] = {}


def _hasher(*shape: int) -> Hasher:
    return _hashers.setdefault(shape, Hasher(*shape))


def sketches(docs: DataFrame, words: int, k: int) -> DataFrame:
    """``doc_id, text_hash, same`` (hash of the element set), ``keys`` (the least prefix in each tree;
    null without elements) and ``signature`` (eight bits of each hash)."""

    def rows(batches):
        hasher = _hasher(words)
        for batch in batches:
            for key, mark, text in zip(batch["id"], batch["text_hash"], batch["text"]):
                if text is None:
                    yield key, mark, None, None, None
                    continue
                elements = hasher.elements(text)
                if not len(elements):
                    yield key, mark, hashlib.blake2b(text.encode(), digest_size=16, key=b"text").digest(), None, None
                    continue
                signature = hasher.signature(elements)
                same = hashlib.blake2b(elements.tobytes(), digest_size=16).digest()
                yield key, mark, same, hasher.prefixes(signature, k).tolist(), signature.astype(np.uint8).tobytes()

    return map_rows(
        docs,
        "doc_id long, text_hash long, same binary, keys array<long>, signature binary",
        pa.schema(
            [
                ("doc_id", pa.int64()),
                ("text_hash", pa.int64()),
                ("same", pa.binary()),
                ("keys", pa.list_(pa.int64())),
                ("signature", pa.binary()),
            ]
        ),
        rows,
        lambda row: 900,
        lambda: _hashers.clear(),
    )


def dealt(members: DataFrame, by: list[str], count: str, block: int) -> DataFrame:
    """``members`` with the columns ``one`` and ``two``: the pairs of blocks that a row goes to.

    A group of up to ``block`` rows is one block. In a larger one a row, by its hash, is in
    one of m blocks and goes to the m pairs of blocks with it.
    """
    blocks = F.ceil(F.col(count) / block).cast("int")
    own = F.pmod(F.xxhash64("row", *by), blocks).cast("int")
    return (
        members.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumns({"one": F.least("own", "other"), "two": F.greatest("own", "other")})
        .drop("other")
    )


def in_groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[dict[str, list]]:
    """Columns of each run of rows with the same key, of rows sorted by it."""
    held: dict[str, list] = {}
    last = None
    for batch in batches:
        columns = batch.to_pydict()
        keys = list(zip(*(columns[c] for c in key)))
        start = 0
        for i in range(len(keys) + 1):
            if i == len(keys) or keys[i] != (last if i == start and held else keys[start]):
                if i > start:
                    for c, values in columns.items():
                        held.setdefault(c, []).extend(values[start:i])
                    last = keys[i - 1]
                if i < len(keys):
                    if held:
                        yield held
                    held, start, last = {}, i, None
    if held:
        yield held


def nodes(tails: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """A subtree's nodes with several documents, from the longest prefixes up: the depth below the subtree's
    root, and the documents' numbers. ``tails`` are the levels below the root."""
    order = np.lexsort(tails.T[::-1]) if tails.shape[1] else np.arange(len(tails))
    ordered = tails[order]
    common = np.cumprod(ordered[1:] == ordered[:-1], axis=1).sum(axis=1)  # levels shared with the next one
    for depth in range(tails.shape[1], -1, -1):
        borders = [0, *(np.flatnonzero(common < depth) + 1).tolist(), len(order)]
        for start, end in zip(borders, borders[1:]):
            if end - start > 1:
                yield depth, order[start:end]


def connect_similar(rows: list[int], signatures: np.ndarray, tails: np.ndarray, share: float) -> Iterator[tuple[int, int]]:
    """Edges that connect what is connected by pairs of a subtree whose signatures agree in ``share``. In each
    node only documents of different components are compared."""
    least = share * signatures.shape[1]
    component = np.arange(len(rows))
    for _, node in nodes(tails):
        rest = node
        while len(rest):
            own = component[rest[0]]
            work, rest = [*rest[component[rest] == own]], rest[component[rest] != own]
            while work and len(rest):
                i = work.pop()
                met = rest[(signatures[rest] == signatures[i]).sum(axis=1) >= least]
                if not len(met):
                    continue
                others, first = np.unique(component[met], return_index=True)
                for j in met[first]:
                    yield rows[i], rows[j]
                joined = np.isin(component[node], others)
                component[node[joined]] = own
                work.extend(node[joined])
                rest = rest[component[rest] != own]


def verify(rows: list[int], own: list[int], weights: list[int], sets: list[np.ndarray], threshold: float):
    """``row, links, root`` for one pair of blocks: links are counted over pairs of which one is in
    each block (all pairs, if it is one block twice), and ``root`` is a row it is connected to."""
    n = len(rows)
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    block, weight = np.array(own)[order], np.array(weights, np.int64)[order]
    first = np.concatenate([[0], np.cumsum(sizes)])
    _, elements = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    across = len(np.unique(block)) > 1
    links, root = np.zeros(n, np.int64), np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    marked = np.zeros(int(elements.max()) + 1 if len(elements) else 1, bool)
    for i in range(n - 1):
        mine = elements[first[i] : first[i + 1]]
        # sizes rise, so those that can be similar enough follow directly
        end = int(np.searchsorted(sizes, sizes[i] / threshold * (1 + 1e-9), side="right"))
        if end <= i + 1:
            continue
        marked[mine] = True
        shared = np.add.reduceat(marked[elements[first[i + 1] : first[end]]], first[i + 1 : end] - first[i + 1], dtype=np.int64)
        marked[mine] = False
        others = np.arange(i + 1, end)
        alike = shared >= threshold * (sizes[i] + sizes[i + 1 : end] - shared) - 1e-9
        if across:
            alike &= block[others] != block[i]
        found = others[alike]
        links[i] += weight[found].sum()
        links[found] += weight[i]
        for j in found:
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    for i in range(n):
        yield rows[order[i]], int(links[i]), rows[order[find(i)]]


def small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it is short; it should be read from storage."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def gather(heads: DataFrame, depth: int, share: float, block: int) -> DataFrame:
    """``row, root``: components of documents that share a prefix and whose signatures agree. Subtrees of the
    forest with several documents are dealt to cells of bounded size."""
    prefixes = heads.where("keys is not null").select("row", F.posexplode("keys").alias("tree", "key"))
    several = durable(prefixes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    cells = dealt(prefixes.join(small(several), "key"), ["key"], "n", block)
    lists = cells.groupBy("key", "one", "two").agg(F.sort_array(F.collect_list("row")).alias("rows"), F.min("tree").alias("tree"))
    # where trees agree on who shares a prefix, one of them is walked
    lists = lists.where(F.size("rows") > 1).groupBy("rows").agg(F.min("tree").alias("tree"))
    members = durable(lists.select(F.xxhash64("rows").alias("cell"), "tree", F.explode("rows").alias("row")))

    def connect(batches):
        for group in in_groups(batches, ["cell"]):
            signatures = np.frombuffer(b"".join(group["signature"]), np.uint8).reshape(len(group["row"]), -1)
            first = group["tree"][0] * LEVELS
            if edges := list(connect_similar(group["row"], signatures, signatures[:, first + depth : first + LEVELS], share)):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges)], names=["a", "b"])

    parts = int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = (
        heads.select("row", "signature")
        .join(small(members), "row")
        .repartition(parts, "cell")
        .sortWithinPartitions("cell")
        .select("cell", "tree", "row", "signature")
        .mapInArrow(connect, "a long, b long")
    )
    return durable(components(edges).withColumnRenamed("node", "row"))


def compared(gathered: DataFrame, heads: DataFrame, copies: DataFrame, texts: DataFrame, words: int, threshold: float, block: int) -> DataFrame:
    """``row, links, root`` of exact comparisons within components; only their texts are read again."""
    parts = int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = gathered.join(gathered.groupBy("root").agg(F.count("*").alias("n")), "root")
    sized = sized.join(heads.select("row", "doc_id", "text_hash"), "row").join(copies.select("row", "weight"), "row")
    sized = durable(sized.withColumnsRenamed({"doc_id": "own_id", "text_hash": "own_hash"}))
    full = texts.join(small(sized), F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("text_hash")))
    full = full.groupBy("row").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.first("weight").alias("weight"), F.first("text").alias("text"))
    pairs = dealt(full, [], "n", block).select("root", "one", "two", "own", "row", "weight", "text")

    def compare(batches):
        hasher = _hasher(words)
        for group in in_groups(batches, ["root", "one", "two"]):
            if len(group["row"]) < 2 or (group["one"][0] != group["two"][0] and len({*group["own"]}) < 2):
                continue
            sets = [hasher.elements(text) for text in group["text"]]
            out = verify(group["row"], group["own"], group["weight"], sets, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["row", "links", "root"])
        _hashers.clear()
        release()

    return durable(
        pairs.repartition(parts, "root", "one", "two")
        .sortWithinPartitions("root", "one", "two")
        .mapInArrow(compare, "row long, links long, root long")
    )


def jaccard_classes(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    words: int = WORDS,
    block: int = BLOCK,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``text_hash`` (xxhash64 of the text), ``copy_id`` (the
    smallest id of those with an equal element set), ``class_id`` (the smallest id of the connected
    class) and ``n_links`` (how many other rows are at least so similar)."""
    settle(docs.sparkSession)
    k = least_depth(threshold, TREES, TARGET_RECALL, LEVELS)
    texts = (
        pick(docs, id_col, text_col)
        .toDF("id", "text")
        .select(F.col("id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    )
    base = durable(sketches(texts, words, k)).withColumn("row", F.monotonically_increasing_id())
    copies = durable(
        base.where("same is not null").groupBy("same").agg(F.min("row").alias("row"), F.count("*").alias("weight"), F.min("doc_id").alias("copy_id"))
    )
    heads = base.join(copies.select("row"), "row", "left_semi")

    gathered = gather(heads, k, SIGNATURE_SHARE - (THRESHOLD - threshold), block)
    checked = compared(gathered, heads, copies, texts, words, threshold, block)
    classes = components(checked.select(F.col("row").alias("a"), F.col("root").alias("b")))
    named = (
        copies.join(classes.withColumnRenamed("node", "row"), "row", "left")
        .join(checked.groupBy("row").agg(F.sum("links").alias("links")), "row", "left")
        .select("same", "copy_id", "weight", F.coalesce("root", "row").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    least = named.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    named = named.join(least, "root").select("same", "copy_id", "class_id", (F.col("links") + F.col("weight") - 1).alias("n_links"))
    named = durable(named)
    return base.join(named, "same", "left").select(
        "doc_id",
        "text_hash",
        F.coalesce("copy_id", "doc_id").alias("copy_id"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
