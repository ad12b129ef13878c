"""Ranked lexical search by pipelined term partitioning.

The index is cut by terms: each owner holds the postings of the terms of one range of
document frequency, dealt to blocks of documents so that a term of any frequency has
bounded parts. Items travel in bundles. A bundle visits the owners one after another,
rarest terms first, and carries a sparse accumulator (item, document, score so far)
for each block; at every owner a cogroup of bundles with postings adds integer
contributions. After each owner the tenth best score of every item is known. It only
grows, so a document that cannot reach it with all that is still to come is put down,
and once unseen documents cannot reach it none is taken up. Both are exact: what is
put down is never among an item's best. The last step selects them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspan.llm.batches import pieces
from weftspan.llm.hashing import Words, byte_table, signed
from weftspan.llm.sieve import Sieve, sieve
from weftspan.plans.ranking import top_per_group
from weftspan.plans.sizing import is_small, small_side
from weftspan.plans.storage import materialise

BEST = 10
#: An owner holds the terms found in up to one in so many documents; the last, the rest.
OWNER_SHARES = (1000, 100, 10)
BUNDLE_ITEMS = 256
BLOCK_DOCUMENTS, BLOCK_POSTINGS = 4_096, 500_000
#: Fixed values of the scoring rule.
WEIGHT_SCALE, FREQUENCY_SCALE, LENGTH_SHARE, DAMPING = 1000, 1_000_000_000, 75, 8


def term_counts(texts: list[bytes], kept: Sieve | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each distinct term of each text: text number, hash and occurrences, and
    the number of all terms of each text. ``kept`` leaves out terms it doesn't pass."""
    words = Words([t.lower() for t in texts], byte_table("plain"))  # bytes: A-Z alone
    held, doc, hashes = np.diff(words.first), words.doc, signed(words.hash)
    if kept is not None:
        passes = kept.passes(hashes & np.int64(2**62 - 1))
        doc, hashes = doc[passes], hashes[passes]
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return doc[at], hashes[at], np.diff(np.append(at, len(doc))), held


def _counted(rows: DataFrame, kept: Sieve | None = None) -> DataFrame:
    """``rows`` (key, text) as (key, n_terms, hashes, counts), a row each."""
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "_text"):
            doc, hashes, counts, held = term_counts(texts, kept)
            cuts = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(v)) for v in (hashes, counts.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held.astype(np.int64)), *lists], names=["_key", "_n", "_hashes", "_counts"])

    return rows.mapInArrow(run, f"_key {kind}, _n long, _hashes array<long>, _counts array<long>")


def _each(counted: DataFrame, *columns: str | Column) -> DataFrame:
    zipped = F.explode(F.arrays_zip("_hashes", "_counts")).alias("_t")
    return counted.select(*columns, zipped).select("*", F.col("_t._hashes").alias("_hash"), F.col("_t._counts").alias("_tf")).drop("_t")


def search(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's ``best`` documents with a score
    above 0, highest first, equal scores by doc_id (a null doc_id last).

    Reads doc_id and text, item_id and text; no other column can clash. A null text
    has no term; an item without a term that occurs has no row, and empty tables give
    none. Texts are read whole at any length. Each row of ``docs`` is a document, so
    rows that repeat a doc_id, or all of a row, are ranked each. Each row of ``items``
    is an item, also if its item_id repeats.
    """
    asked = materialise(
        _counted(items.select("item_id", F.col("text").alias("_text"))).withColumn("_item", F.monotonically_increasing_id()), "items"
    )
    asked = asked.withColumnRenamed("_key", "item_id")
    wants = materialise(_each(asked, "_item"), "wants")
    kept = sieve(wants.select("_hash").distinct(), F.col("_hash").bitwiseAND(F.lit(2**62 - 1)))
    held = materialise(
        _counted(docs.select("doc_id", F.col("text").alias("_text")), kept).filter("_n > 0").withColumnRenamed("_key", "doc_id")
        .withColumn("_row", F.monotonically_increasing_id()), "held",
    )
    size = held.agg(F.count(F.lit(1)).alias("n"), F.sum("_n").alias("l"), F.sum(F.size("_hashes")).alias("p")).first()
    if not size["n"]:
        return held.limit(0).join(asked.limit(0), F.lit(False)).select("item_id", F.lit(0).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score"))
    blocks = max(1, -(-size["n"] // BLOCK_DOCUMENTS), -(-size["p"] // BLOCK_POSTINGS))
    m = F.lit(100 - LENGTH_SHARE) + F.expr(f"({LENGTH_SHARE} * _n * {size['n']}L) div {size['l']}L")
    block = F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int")
    cut = held.select("_row", block.alias("_block"), m.alias("_m"), "_hashes", "_counts")
    share = F.expr(f"({FREQUENCY_SCALE}L * _tf) div (1000 * _tf + {DAMPING} * _m)")
    terms = _terms(_each(cut, "_m").withColumn("_share", share), wants, size["n"])
    bundled = _bundled(wants, terms)
    found = _visit_all(cut, share, bundled, blocks, best)
    # The copies that tie at the last place may be many, so ranks are taken in parts.
    rows = held.select("_row", "doc_id").join(small_side(found), "_row").join(small_side(asked.select("_item", "item_id")), "_item")
    order = [F.desc("_score"), F.asc_nulls_last("doc_id"), F.asc("_row")]
    ranked = top_per_group(rows, ["_item"], order, best, "rank", spread=["_row"])
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", F.col("_score").alias("score"))


def _terms(postings: DataFrame, wants: DataFrame, n: int) -> DataFrame:
    """_hash, _w, _most (largest contribution of a document) and _owner of the terms
    that add anything. What the sieve let through by chance meets no item later."""
    counts = postings.groupBy("_hash").agg(F.count(F.lit(1)).alias("_df"), F.max("_share").alias("_top"))
    owner = F.lit(len(OWNER_SHARES))
    for at in range(len(OWNER_SHARES) - 1, -1, -1):
        owner = F.when(F.col("_df") * OWNER_SHARES[at] <= n, at).otherwise(owner)
    weight = F.floor(WEIGHT_SCALE * F.log(F.lit(2.0 * n + 2) / (2 * F.col("_df") + 1))).cast("long")
    used = counts.join(wants.select("_hash").distinct(), "_hash", "left_semi")
    return materialise(used.withColumn("_w", weight).filter("_w > 0").withColumn("_owner", owner).withColumn("_most", F.col("_w") * F.col("_top")), "terms")


def _bundled(wants: DataFrame, terms: DataFrame) -> DataFrame:
    """(bundle, place of the item in it, item, term, weight times repeats, owner, most)."""
    met = wants.join(terms, "_hash")
    items = met.select("_item").distinct()
    # Dealt by a hash, bundles hold half of ``BUNDLE_ITEMS`` on average, if one does not hold all.
    n = items.count()
    many = 1 if n <= BUNDLE_ITEMS else -(-2 * n // BUNDLE_ITEMS)
    dealt = items.withColumn("_bundle", F.pmod(F.xxhash64("_item"), F.lit(many)).cast("int"))
    listed = dealt.groupBy("_bundle").agg(F.array_sort(F.collect_list("_item")).alias("_items"))
    placed = listed.select("_bundle", F.posexplode("_items").alias("_place", "_item"))
    return materialise(
        met.join(placed, "_item").select("_bundle", "_place", "_item", "_hash", (F.col("_w") * F.col("_tf")).alias("_w"), "_owner", (F.col("_most") * F.col("_tf")).alias("_most")), "bundled"
    )


CARRIED = "_bundle int, _block int, _places array<int>, _rows array<long>, _scores array<long>, _best_places array<int>, _best_scores array<long>"
POSTING = ["_bundle", "_block", "_hash", "_row", "_share"]


def _visit_all(cut: DataFrame, share: Column, bundled: DataFrame, blocks: int, best: int) -> DataFrame:
    """(_item, _row, _score) of all documents that may be among an item's best."""
    spark = cut.sparkSession
    empty = F.array().cast("array<int>"), F.array().cast("array<long>"), F.array().cast("array<long>")
    bundles = bundled.select("_bundle").distinct()
    carried = bundles.select("_bundle", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), *[e.alias(n) for e, n in zip(empty, ("_places", "_rows", "_scores"), strict=True)])
    reached = bundled.select("_bundle", "_place").distinct().withColumn("_reached", F.lit(0).cast("long"))
    first = True
    for owner in range(len(OWNER_SHARES) + 1):
        left = F.sum(F.when(F.col("_owner") > owner, F.col("_most")).otherwise(0)).alias("_after")
        due = F.sum(F.when(F.col("_owner") >= owner, F.col("_most")).otherwise(0)).alias("_before")
        state = materialise(bundled.groupBy("_bundle", "_place").agg(due, left).join(reached, ["_bundle", "_place"], "left").fillna(0, ["_reached"]), "state")
        held = bundled.filter(F.col("_owner") == owner).join(state, ["_bundle", "_place"])
        still_open = F.col("_before") >= F.col("_reached")
        opened = materialise(held.groupBy("_bundle", "_hash").agg(F.max(still_open).alias("_open")), "opened")
        if not is_small(opened, 0):
            postings = _postings(cut, share, opened, None if first else carried)
            visited = _visit(carried, postings, held, state, best)
            carried = materialise(visited, "carried")
            first = False
            tops = carried.select("_bundle", F.explode(F.arrays_zip("_best_places", "_best_scores")).alias("_t")).select("_bundle", F.col("_t._best_places").alias("_place"), F.col("_t._best_scores").alias("_score"))
            tops = top_per_group(tops.withColumn("_u", F.monotonically_increasing_id()), ["_bundle", "_place"], [F.desc("_score"), F.asc("_u")], best, "_r", spread=["_u"])
            reached = materialise(tops.groupBy("_bundle", "_place").agg(F.when(F.max("_r") == best, F.min("_score")).otherwise(0).alias("_reached")), "reached")
    names = bundled.select("_bundle", "_place", "_item").distinct()
    last = carried.select("_bundle", F.explode(F.arrays_zip("_places", "_rows", "_scores")).alias("_t"))
    last = last.select("_bundle", F.col("_t._places").alias("_place"), F.col("_t._rows").alias("_row"), F.col("_t._scores").alias("_score"))
    kept = last.join(small_side(reached), ["_bundle", "_place"]).filter((F.col("_score") >= F.col("_reached")) & (F.col("_score") > 0))
    return materialise(kept.join(small_side(names), ["_bundle", "_place"]).select("_item", "_row", "_score"), "found")


def _postings(cut: DataFrame, share: Column, opened: DataFrame, carried: DataFrame | None) -> DataFrame:
    """Postings of an owner's terms by bundle and block. Those of terms that no open
    item holds are read for carried documents alone, if these prove few."""
    every, few = opened, None
    if carried is not None:
        rows = carried.select(F.explode("_rows").alias("_row")).distinct()
        if is_small(rows):
            every, few = opened.filter("_open"), opened.filter("not _open")
    found = _each(cut, "_row", "_block", "_m").join(small_side(every), "_hash")
    if few is not None:
        near = cut.join(F.broadcast(rows), "_row", "left_semi")
        found = found.unionByName(_each(near, "_row", "_block", "_m").join(small_side(few), "_hash"))
    return found.withColumn("_share", share).select(*POSTING)


def _visit(carried: DataFrame, postings: DataFrame, held: DataFrame, state: DataFrame, best: int) -> DataFrame:
    """Bundles after they met one owner's postings; a bundle without any of the
    owner's terms passes through."""
    terms = held.groupBy("_bundle").agg(F.collect_list(F.struct("_place", "_hash", "_w")).alias("_terms"))
    bounds = state.groupBy("_bundle").agg(F.array_sort(F.collect_list(F.struct("_place", "_before", "_after", "_reached"))).alias("_bounds"))
    told = carried.select("_bundle", "_block", "_places", "_rows", "_scores").join(small_side(bounds.join(terms, "_bundle", "left")), "_bundle")
    told = told.select(
        "_bundle", "_block", "_places", "_rows", "_scores", *[F.coalesce(F.col(f"_terms.{c}"), F.array()).alias(f"_t{c}") for c in ("_place", "_hash", "_w")],
        *[F.col(f"_bounds.{c}").alias(f"_b{c}") for c in ("_place", "_before", "_after", "_reached")],
    )

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):  # no bundle holds these terms
            return pd.DataFrame([], columns=[c.split()[0] for c in CARRIED.split(", ")])
        row = left.iloc[0]
        found = add_contributions(
            (row["_places"], row["_rows"], row["_scores"]), (row["_t_place"], row["_t_hash"], row["_t_w"]),
            (row["_b_place"], row["_b_before"], row["_b_after"], row["_b_reached"]),
            (right["_hash"].to_numpy(np.int64), right["_row"].to_numpy(np.int64), right["_share"].to_numpy(np.int64)), best,
        )
        return pd.DataFrame([(row["_bundle"], row["_block"], *found)], columns=[c.split()[0] for c in CARRIED.split(", ")])

    keys = "_bundle", "_block"
    return told.groupBy(*keys).cogroup(postings.groupBy(*keys)).applyInPandas(run, CARRIED)


def add_contributions(carried: tuple, terms: tuple, bounds: tuple, postings: tuple, best: int) -> tuple:
    """Accumulators of one bundle and block after one owner, and the best scores.

    ``carried``: item places, rows, scores. ``terms``: place, hash, weight.
    ``bounds``: place, most that this owner and later ones can add, most that later
    ones can, score reached by the item's last best document. ``postings``: hash,
    row, share; one for each term and row.
    """
    order = np.argsort(postings[0], kind="stable")
    hashes, rows, shares = (p[order] for p in postings)
    places, kept_rows, scores = (np.asarray(c, np.int64) for c in carried)
    every, at = np.unique(np.concatenate([rows, kept_rows]), return_inverse=True)
    at, kept_at = at[: len(rows)], at[len(rows) :]
    t_place, t_hash, t_weight = (np.asarray(t, np.int64) for t in terms)
    begins, ends = np.searchsorted(hashes, t_hash, "left"), np.searchsorted(hashes, t_hash, "right")
    by_place, by_kept = np.argsort(t_place, kind="stable"), np.argsort(places, kind="stable")
    outs, tops = [], []
    for place, before, after, reached in zip(*bounds, strict=True):
        total, seen = np.zeros(len(every), np.int64), np.zeros(len(every), bool)
        own = by_kept[slice(*np.searchsorted(places[by_kept], [place, place + 1]))]
        total[kept_at[own]] = scores[own]
        seen[kept_at[own]] = True
        for t in by_place[slice(*np.searchsorted(t_place[by_place], [place, place + 1]))]:
            met = slice(begins[t], ends[t])
            total[at[met]] += t_weight[t] * shares[met]
            if before >= reached:
                seen[at[met]] = True
        live = np.flatnonzero(seen)
        if len(live) >= best:
            reached = max(reached, np.partition(total[live], len(live) - best)[len(live) - best])
        live = live[total[live] + after >= reached]
        outs.append((np.full(len(live), place), every[live], total[live]))
        high = live[np.argsort(-total[live], kind="stable")[:best]]
        tops.append((np.full(len(high), place), total[high]))
    kinds = np.int32, np.int64, np.int64
    found = [np.concatenate([o[k] for o in outs]).astype(kinds[k]) for k in range(3)]
    return (*found, *[np.concatenate([t[k] for t in tops]).astype(kinds[k]) for k in range(2)])


#: Pattern of a term, and the whole rule, as DuckDB states them.
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def search_sql(best: int = BEST) -> str:
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lowered}, '{PATTERN}') AS terms FROM documents WHERE text IS NOT NULL),
held AS (SELECT r, doc_id, len(terms) AS n, terms FROM docs WHERE len(terms) > 0),
size AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM held),
items AS (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all({lowered}, '{PATTERN}')) AS term FROM benchmark),
wants AS (SELECT i, item_id, term, count(*) AS q FROM items GROUP BY ALL),
counts AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM held) WHERE term IN (SELECT term FROM wants) GROUP BY ALL),
weights AS (SELECT term, CAST(floor({WEIGHT_SCALE} * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM counts, size GROUP BY term, docs),
scored AS (SELECT i, item_id, r, doc_id,
  CAST(sum(q * w * (({FREQUENCY_SCALE} * tf) // (1000 * tf + {DAMPING} * ({100 - LENGTH_SHARE} + ({LENGTH_SHARE} * n * docs) // words)))) AS BIGINT) AS score
  FROM counts JOIN wants USING (term) JOIN weights USING (term), size GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM scored WHERE score > 0) WHERE rank <= {best}"""
