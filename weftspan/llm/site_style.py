"""Main text of web pages by site style trees.

The pages of a host are merged into one tree. A node is an element with its classes
under a chain of such elements. Two things tell how much a node matters: its
presentations (the sequences of children that pages give it) and its content (the
blocks of text that it holds itself). A node whose children always look alike, or
whose text is the same on many pages, has low entropy over pages and low importance:
it is template, not text. A tree of all hosts together serves as prior for hosts of
few pages, and full importance as prior of that.

In a page, the importance of a branch is put together from below: that of the text in
it, by length, mixed with that of the presentation the more kinds of children the
node has. Branches of low importance are removed, but for one that holds most of the
page's text, of which only parts can go.

What elements declare is evidence of its own. ``nav``, ``aside``, a class ``advert``
and the like have no importance; a part of a name (``ad-slot``) lowers it, unless the
branch has the heading or an article, or most of the text. Within
``article`` or ``main`` it is raised, so that only what hardly varies over a host goes,
and outside of them it counts by how much of the page's text lies there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspan.llm.batches import pieces
from weftspan.llm.markup import host_of, read

#: Weight of the presentation: 1 - GAMMA ** (kinds of children - 1).
GAMMA = 0.9
LEAST_IMPORTANCE = 0.45
#: Pages that a prior counts for beside a node's own.
PRIOR_PAGES = 8.0
#: Added within a declared article; factor where a part of a name hints at no text.
MAIN_BONUS, HINT = 0.4, 0.3
#: Nodes above count as of full importance, so that they need not be held.
FULL_IMPORTANCE = 0.95
BROADCAST_NODES = 500_000
CONTENT, CHILDREN, PAGE = 0, 1, 2
#: Values of a node that is not held: style, weight of what lies below, content.
FULL = (1.0, 1.0, 1.0)


def features(page: str) -> set[tuple[int, int, int]]:
    """(node, kind, value) of one page: blocks that each node holds, its sequences of
    child presentations (repeats as one), and that the page has it. Nodes that are
    declared to be no text, or never shown, stay out."""
    elements, blocks = read(page)
    inside: list[tuple[int, int]] = [(0, 0)] * len(elements)  # digest of the children, last child
    found = set()

    def child(place: int, key: int) -> None:
        digest, last = inside[place]
        if last != key:
            inside[place] = zlib.crc32(key.to_bytes(8, "little", signed=True), digest), key

    block = 0
    for place, element in enumerate(elements):
        while block < len(blocks) and blocks[block][0] < place:
            child(blocks[block][0], 1)
            block += 1
        if element.parent >= 0:
            child(element.parent, element.key)
    for place, text in blocks:
        if not elements[place].apart:
            found.add((elements[place].key, CONTENT, zlib.crc32(text.encode())))
    for element, (digest, _) in zip(elements, inside, strict=True):
        if not (element.apart or element.hidden):
            found.add((element.key, CHILDREN, digest))
            found.add((element.key, PAGE, 0))
    return found


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, node, style, below, content, pages) from (url, html).

    Counts are summed within tasks before they are dealt by node and value, so a
    host with most of the pages is spread like any other. Pages are counted once
    each, also if they are copies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "html"):
            counts: dict[tuple, int] = {}
            for url, page in zip(part.column(0).to_pylist(), texts, strict=True):
                host = host_of(url)
                for feature in features(page.decode()):
                    key = (host, *feature)
                    counts[key] = counts.get(key, 0) + 1
            if counts:
                columns = list(zip(*counts, strict=True))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)] + [pa.array(list(counts.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["host", "node", "kind", "value", "n"])

    seen = pages.select("url", "html").mapInArrow(run, "host string, node long, kind long, value long, n long")
    own = seen.groupBy("host", "node", "kind", "value").agg(F.sum("n").alias("n"))
    nodes = _importance(own, ["host", "node"])
    every = _importance(own.groupBy("node", "kind", "value").agg(F.sum("n").alias("n")), ["node"])
    prior = every.select("node", *(_blended(name, F.lit(1.0)).alias("_" + name) for name in VALUES))
    return nodes.join(prior, "node").select("host", "node", *(_blended(name, F.col("_" + name)).alias(name) for name in VALUES), "pages")


VALUES = ["style", "below", "content"]


def _blended(name: str, prior: Column) -> Column:
    return (F.col("pages") * F.col(name) + PRIOR_PAGES * prior) / (F.col("pages") + PRIOR_PAGES)


def _importance(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Entropy over pages of a node's presentations and of its blocks, 0 to 1, and the
    weight of what lies below it. A node of one page has full importance."""
    n = F.col("n").cast("double")

    def total(kind: int, x):
        return F.sum(F.when(F.col("kind") == kind, x).otherwise(0.0))

    sums = counts.groupBy(*keys).agg(
        total(PAGE, n).alias("pages"), total(CONTENT, n).alias("c"), total(CONTENT, n * F.log(n)).alias("cl"),
        total(CHILDREN, n).alias("s"), total(CHILDREN, n * F.log(n)).alias("sl"),
        F.sum(F.when(F.col("kind") == CHILDREN, 1).otherwise(0)).alias("styles"),
    )

    def entropy(total_n: str, total_log: str) -> Column:
        known = (F.col("pages") > 1) & (F.col(total_n) > 0)
        return F.when(known, 1 - F.try_divide(total_log, F.col(total_n) * F.log("pages"))).otherwise(1.0)

    return sums.select(
        *keys, "pages", entropy("s", "sl").alias("style"), F.pow(F.lit(GAMMA), F.col("styles") - 1).alias("below"),
        entropy("c", "cl").alias("content"),
    )


def main_text(page: str, nodes: Mapping[int, tuple[float, float, float]]) -> str:
    """Text of the blocks that no removed branch holds, joined by one space.

    ``nodes`` gives style, weight of what lies below, and content by key. Where a
    declared article would lose all of its text, as on a host of copies, the
    declarations alone decide.
    """
    elements, found = read(page)
    blocks = [(place, text) for place, text in found if not elements[place].apart]
    if not blocks:
        return ""
    size = len(elements)
    length, weighted, holds_main = [0.0] * size, [0.0] * size, [False] * size
    in_main = 0
    for place, text in blocks:
        length[place] += len(text)
        weighted[place] += len(text) * nodes.get(elements[place].key, FULL)[2]
        holds_main[place] |= elements[place].main
        in_main += len(text) if elements[place].main else 0
    importance = [1.0] * size
    for place in range(size - 1, -1, -1):
        element = elements[place]
        if length[place]:
            style, below, _ = nodes.get(element.key, FULL)
            importance[place] = (1 - below) * style + below * weighted[place] / length[place]
        if place:
            length[element.parent] += length[place]
            weighted[element.parent] += length[place] * importance[place]
            holds_main[element.parent] |= holds_main[place] or element.tag == "h1"
    outside = min(1.0, (length[0] - in_main) / in_main) if in_main else 1.0

    def value(place: int, base: float) -> float:
        element = elements[place]
        return base + MAIN_BONUS if element.main else base * outside

    removed = [False] * size
    for place in range(1, size):
        element = elements[place]
        small = length[place] <= length[0] / 2
        whole = holds_main[place] and not element.main
        own = 1.0 if whole else value(place, importance[place])
        hinted = not whole and element.hint and (small or (element.hint == 2 and length[place] < length[0]))
        low = own * (HINT if hinted else 1.0) < LEAST_IMPORTANCE
        removed[place] = removed[element.parent] or (low and (small or hinted))

    def kept(place: int) -> bool:
        return not removed[place] and value(place, nodes.get(elements[place].key, FULL)[2]) >= LEAST_IMPORTANCE

    out = [text for place, text in blocks if kept(place)]
    if not out and in_main:
        out = [text for place, text in blocks if elements[place].main]
    return " ".join(out)


def extract(pages: DataFrame, keys: list[str], broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """``keys`` and ``text`` of each row of (url, html, ...).

    A null or empty page has an empty text. A null or broken url counts as one
    host without a name. Pages are read twice and never moved, as long as the
    nodes of less than full importance of all hosts are at most ``broadcast_nodes`` (counted first);
    beyond that, each page meets its host's nodes in a join. Rows that repeat are
    each extracted; an empty table gives no rows. Nodes that tie with the limit of
    importance stay. A page of any length is read whole. Of the columns only ``keys``,
    url and html are read; a key may have any name but ``text``.
    """
    held = F.least(F.col("content"), (1 - F.col("below")) * F.col("style") + F.col("below")) < FULL_IMPORTANCE
    tree = style_tree(pages).filter(held).select("host", "node", *(F.col(name).cast("float").alias(name) for name in VALUES))
    some = tree.limit(broadcast_nodes + 1).toPandas()
    rows = pages.select(*keys, F.col("url").alias("_url"), F.col("html").alias("_html"))
    if len(some) <= broadcast_nodes:
        some = some.sort_values(["host", "node"])
        shared = {host: NodeTable(own["node"].to_numpy(), own[VALUES].to_numpy()) for host, own in some.groupby("host")}
        rows = rows.withColumn("_nodes", F.lit(None).cast("array<struct<node:long,style:float,below:float,content:float>>"))
    else:
        shared = {}
        by_host = F.udf(host_of, "string")
        lists = tree.groupBy(F.col("host").alias("_host")).agg(F.collect_list(F.struct("node", *VALUES)).alias("_nodes"))
        rows = rows.withColumn("_host", by_host("_url")).join(lists, "_host", "left").drop("_host")
    rows = rows.select(*keys, "_url", "_nodes", "_html")
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "_html"):
            out = []
            for url, own, page in zip(part.column(n), part.column(n + 1), texts, strict=True):
                nodes = _listed(own) if own.is_valid else shared.get(host_of(url.as_py()), {})
                out.append(main_text(page.decode(), nodes))
            yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(out, pa.string())], names=[*keys, "text"])

    kinds = ", ".join(f"`{k}` {t}" for k, t in rows.select(*keys).dtypes)
    return rows.mapInArrow(run, f"{kinds}, text string")


class NodeTable(Mapping):
    """Nodes of a host in sorted arrays: twenty bytes each."""

    def __init__(self, nodes: np.ndarray, values: np.ndarray):
        self.nodes, self.values_ = nodes, values

    def __getitem__(self, node: int) -> tuple[float, float, float]:
        at = int(np.searchsorted(self.nodes, node))
        if at == len(self.nodes) or self.nodes[at] != node:
            raise KeyError(node)
        return tuple(self.values_[at].tolist())

    def __iter__(self) -> Iterator[int]:
        return iter(self.nodes.tolist())

    def __len__(self) -> int:
        return len(self.nodes)


def _listed(own: pa.ListScalar) -> NodeTable:
    nodes = own.values.field("node").to_numpy()
    order = np.argsort(nodes)
    values = np.column_stack([own.values.field(name).to_numpy() for name in VALUES])
    return NodeTable(nodes[order], values[order])
