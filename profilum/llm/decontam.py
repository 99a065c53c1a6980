"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` turns documents into index shards: each shard is one row that
holds, for some whole documents, the posting list (word positions) of every
term.  ``store_index`` writes them to the shared folder, once for any number
of benchmarks.  ``occurrences`` answers phrases from a shard alone: it starts
at the posting list of the phrase's rarest term and intersects it with the
offset-adjusted lists of its other terms, rarest first; with ``slop`` every term
may stand that many words from its place (proximity match), whichever is rarest.

The index is dealt by documents: a shard holds the lists of about as many
words as any other, so the list of a frequent term is split over all shards,
and no shuffle is needed to build or to ask it.  The phrases are the stated
query set.  They come in blocks of whole items of bounded size, one after the
other: the driver holds one block, broadcasts it, has its matches written and
lets it go.  Only matches, by shard and document, are brought together.

Cases: null or empty texts have no words and no hits; an item of fewer words
than a window is one window, an item without words none; items that share an
id count as one; an item without id counts but is not named; equal documents
get equal results; an empty benchmark or document table works; extra columns
are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilum.llm import text as X
from profilum.llm.shared import stash, unused
from profilum.llm.substrings import text_key
from profilum.sources.tables import read_table

WINDOW = 10
#: Bytes of phrase arrays in one broadcast.
BLOCK_BYTES = 32 << 20
#: A shard: its documents' ids, text keys and sizes, distinct term hashes in order, how many postings each has, and the postings.
INDEX_SCHEMA = "doc_ids array<bigint>, keys array<struct<k1:bigint,k2:bigint>>, n_words array<int>, terms binary, sizes binary, postings binary"
#: What a block of phrases finds in a shard: covered word ranges, items and proximity matches of its documents.
FOUND_SCHEMA = "shard bigint, spans array<struct<doc:int,from:int,to:int>>, items array<struct<doc:int,item:string>>, near array<struct<doc:int,item:string,position:int>>"


@dataclass
class Phrases:
    """Phrases of at most ``width`` terms: term hashes (0 beyond the length), lengths, and the item of each."""

    terms: np.ndarray
    lengths: np.ndarray
    items: np.ndarray
    names: list[str | None]


def phrases_of(items: pa.Table, width: int = WINDOW) -> Phrases:
    """The windows of the items (columns item_id, text)."""
    ids = [None if x is None else str(x) for x in items.column("item_id").to_pylist()]
    names = list(dict.fromkeys(ids))
    number = {x: i for i, x in enumerate(names)}
    _, _, _, rows, hashes = X.split_words(items.column("text"), X.ALNUM, lower=True)
    terms, lengths, owner = [], [], []
    for i, name in enumerate(ids):
        words = hashes[rows[i] : rows[i + 1]]
        if 0 < len(words) < width:
            found = np.zeros((1, width), X.U64)
            found[0, : len(words)] = words
            terms.append(found)
            lengths.append(np.full(1, len(words)))
        elif len(words):
            terms.append(np.lib.stride_tricks.sliding_window_view(words, width))
            lengths.append(np.full(len(words) - width + 1, width))
        else:
            continue
        owner.append(np.full(len(lengths[-1]), number[name]))
    if not terms:
        return Phrases(np.zeros((0, width), X.U64), np.zeros(0, np.int64), np.zeros(0, np.int64), names)
    table = np.concatenate(terms)
    size, item = np.concatenate(lengths), np.concatenate(owner)
    kept = np.unique(np.column_stack([table, size.astype(X.U64), item.astype(X.U64)]), axis=0)
    return Phrases(np.ascontiguousarray(kept[:, :width]), kept[:, width].astype(np.int64), kept[:, width + 1].astype(np.int64), names)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index shards of the documents: every posting of every term."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches):
            _, _, _, rows, hashes = X.split_words(batch.column(1), X.ALNUM, lower=True)
            postings = np.argsort(hashes, kind="stable")
            terms, first = np.unique(hashes[postings], return_index=True)
            sizes = np.diff(np.append(first, len(postings)))
            keys = pa.StructArray.from_arrays([batch.column(2), batch.column(3)], ["k1", "k2"])
            whole = pa.array([0, batch.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(whole, batch.column(0)),
                    pa.ListArray.from_arrays(whole, keys),
                    pa.ListArray.from_arrays(whole, pa.array(np.diff(rows), pa.int32())),
                    *(pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in ((terms, np.uint64), (sizes, np.int32), (postings, np.int32))),
                ],
                names=["doc_ids", "keys", "n_words", "terms", "sizes", "postings"],
            )

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *(k.alias(n) for k, n in zip(text_key(text), ("k1", "k2"))))
    return rows.mapInArrow(shards, INDEX_SCHEMA)


def store_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index, written to the shared folder; each shard has a number, which the written table keeps."""
    return stash(build_index(docs, id_col, text_col).withColumn("shard", F.monotonically_increasing_id()), "postings")


def occurrences(terms: np.ndarray, sizes: np.ndarray, postings: np.ndarray, bounds: np.ndarray, phrases: Phrases, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Phrase numbers and start positions of all matches in one shard whose documents lie between ``bounds``.

    With ``slop`` these are all starts from which each term is that near to its
    place; a start outside its document counts as the nearest word inside.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(terms) or not len(phrases.lengths):
        return none
    width = phrases.terms.shape[1]
    used = np.arange(width) < phrases.lengths[:, None]
    number = np.minimum(np.searchsorted(terms, phrases.terms), len(terms) - 1)
    there = (terms[number] == phrases.terms) | ~used
    alive = np.flatnonzero(there.all(1))
    if not len(alive):
        return none
    number, used = number[alive], used[alive]
    length = phrases.lengths[alive]
    first = np.cumsum(sizes) - sizes
    joined = (np.repeat(np.arange(len(terms), dtype=np.int64), sizes) << 32) | postings.astype(np.int64)
    order = np.argsort(np.where(used, sizes[number], np.iinfo(np.int32).max), axis=1, kind="stable")
    rarest = order[:, 0]
    lead = number[np.arange(len(alive)), rarest]
    who = np.repeat(np.arange(len(alive)), sizes[lead])
    place = postings[X.expand(first[lead].astype(np.int64), sizes[lead].astype(np.int64))].astype(np.int64)
    start = place - rarest[who]
    doc = np.searchsorted(bounds, place, "right") - 1
    if slop:
        shifts = np.arange(-slop, slop + 1)
        who, doc, start = np.repeat(who, len(shifts)), np.repeat(doc, len(shifts)), (start[:, None] + shifts).ravel()
    fits = (start + slop >= bounds[doc]) & (start + length[who] <= bounds[doc + 1] + slop)
    who, start, doc = who[fits], start[fits], doc[fits]
    for k in range(1, width):
        if not len(who):
            return none
        column = order[who, k]
        asked = used[who, column]
        wanted = start + column
        low = np.maximum(wanted - slop, bounds[doc])
        high = np.minimum(wanted + slop, bounds[doc + 1] - 1)
        base = number[who, column].astype(np.int64) << 32
        at = np.searchsorted(joined, base | low)
        hit = (at < len(joined)) & (joined[np.minimum(at, len(joined) - 1)] <= (base | high))
        keep = hit | ~asked
        who, start, doc = who[keep], start[keep], doc[keep]
    if slop and len(who):
        who, start = np.unique(np.column_stack([who, np.clip(start, bounds[doc], bounds[doc + 1] - 1)]), axis=0).T
    return alive[who], start


def phrase_blocks(items: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[Phrases]:
    """All phrases of the items, in blocks of whole items that take at most about ``block_bytes`` each."""
    items = items.select("item_id", F.col("text").cast("string").alias("text"))
    bytes_ = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(bytes_) * 8 * (width + 2) // (2 * block_bytes)))
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(n)) == i)
        yield phrases_of(part.toArrow(), width)


def matches(index: DataFrame, items: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES, slop: int = 0) -> DataFrame:
    """FOUND_SCHEMA of a stored index: one row for each shard and block of phrases that meet."""
    context, found = index.sparkSession.sparkContext, []
    for block in phrase_blocks(items, width, block_bytes):
        sent = context.broadcast(block)

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            phrases = sent.value
            names = np.array(phrases.names, object)
            for batch in batches:
                for i in range(batch.num_rows):
                    shard, counts = batch.column(0)[i].as_py(), batch.column(1)[i].values.to_numpy(zero_copy_only=False)
                    terms, sizes, postings = (np.frombuffer(batch.column(k)[i].as_buffer(), kind) for k, kind in ((2, np.uint64), (3, np.int32), (4, np.int32)))
                    bounds = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                    which, start = occurrences(terms, sizes, postings, bounds, phrases)
                    near = occurrences(terms, sizes, postings, bounds, phrases, slop) if slop else (which[:0], start[:0])
                    if not len(which) and not len(near[0]):
                        continue
                    depth = np.zeros(bounds[-1] + 1, np.int64)
                    np.add.at(depth, start, 1)
                    np.add.at(depth, start + phrases.lengths[which], -1)
                    from_, to, spans = X.runs(np.cumsum(depth)[:-1] > 0, bounds)
                    owner = X.row_of(spans)
                    pair = np.unique(np.column_stack([np.searchsorted(bounds, start, "right") - 1, phrases.items[which]]), axis=0).reshape(-1, 2)
                    doc = np.searchsorted(bounds, near[1], "right") - 1
                    close = np.unique(np.column_stack([doc, near[1] - bounds[doc], phrases.items[near[0]]]), axis=0).reshape(-1, 3)
                    table = lambda **c: pa.StructArray.from_arrays(list(c.values()), list(c))
                    number = lambda x: pa.array(x, pa.int32())
                    name = lambda x: pa.array(names[x].tolist(), pa.string())
                    lists = table(doc=number(owner), **{"from": number(from_ - bounds[owner]), "to": number(to - bounds[owner])}), table(doc=number(pair[:, 0]), item=name(pair[:, 1])), table(doc=number(close[:, 0]), item=name(close[:, 2]), position=number(close[:, 1]))
                    yield pa.RecordBatch.from_arrays([pa.array([shard]), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists)], names=["shard", "spans", "items", "near"])

        found.append(stash(index.select("shard", "n_words", "terms", "sizes", "postings").mapInArrow(find, FOUND_SCHEMA), "matches"))
        sent.unpersist()
    return functools.reduce(DataFrame.unionByName, found)


ANSWER_SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, hit_spans array<struct<from:int,to:int>>, near array<struct<item:string,position:int>>"


def answers(index: DataFrame, items: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES, slop: int = 0) -> DataFrame:
    """``decontaminate`` from a stored index; no text is read."""
    found = matches(index, items, width, block_bytes, slop)
    # what the blocks found in one shard, which holds a bounded number of words
    by_shard = found.groupBy("shard").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near")))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, counts, spans, named, near in zip(*(c for c in batch.columns)):
                counts = counts.values.to_numpy(zero_copy_only=False)
                n = len(counts)
                hit, covered, lists, close = np.zeros(n, np.int64), [[] for _ in range(n)], [set() for _ in range(n)], [[] for _ in range(n)]
                for s in merged(spans.as_py() or ()):
                    covered[s[0]].append({"from": s[1], "to": s[2]})
                    hit[s[0]] += s[2] - s[1]
                for m in named.as_py() or ():
                    lists[m["doc"]].add(m["item"])
                for m in near.as_py() or ():
                    close[m["doc"]].append({"item": m["item"], "position": m["position"]})
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.values,
                        pa.array(counts, pa.int64()),
                        pa.array(hit),
                        pa.array([len(x) for x in lists], pa.int64()),
                        pa.array([hashlib.sha256(",".join(sorted(i for i in x if i is not None)).encode()).hexdigest() for x in lists]),
                        pa.array(hit > 0),
                        pa.array(covered, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))),
                        pa.array([sorted(c, key=lambda m: (m["position"], m["item"] is None, m["item"] or "")) for c in close], pa.list_(pa.struct([("item", pa.string()), ("position", pa.int32())]))),
                    ],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans", "near"],
                )

    return index.select("shard", "doc_ids", "n_words").join(by_shard, "shard", "left").select("doc_ids", "n_words", "spans", "items", "near").mapInArrow(answer, ANSWER_SCHEMA)


def merged(spans: list[dict]) -> Iterator[tuple[int, int, int]]:
    """Word ranges (document, from, to) joined where they meet or overlap."""
    open_ = None
    for doc, from_, to in sorted((s["doc"], s["from"], s["to"]) for s in spans):
        if open_ and open_[0] == doc and from_ <= open_[2]:
            open_ = doc, open_[1], max(open_[2], to)
        else:
            if open_:
                yield open_
            open_ = doc, from_, to
    if open_:
        yield open_


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES, slop: int = 0) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, hit_spans (word ranges that are hit), and near.

    near holds the proximity matches within ``slop`` words (item, and position
    of the start), exact ones too, and is empty without slop.  The other
    columns are about exact matches only.
    """
    return answers(store_index(docs), items, width, block_bytes, slop)


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES, text_col: str = "text", slop: int = 0) -> DataFrame:
    """The rows, with all their columns, in which no phrase of the items occurs; with slop, none nearly.

    Decisions belong to texts: rows go by the key of a text that an index shard answered for.
    """
    index = store_index(docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    place = "near" if slop else "spans"
    met = matches(index, items, width, block_bytes, slop).select("shard", F.explode(F.array_distinct(F.col(place)["doc"])).alias("doc"))
    keys = index.select("shard", F.posexplode("keys").alias("doc", "key")).join(met.distinct(), ["shard", "doc"], "left_semi")
    names = unused(docs.columns, "k1", "k2")
    bad = stash(keys.select(F.col("key.k1").alias(names[0]), F.col("key.k2").alias(names[1])).distinct(), "contaminated")
    own = text_key(F.col(text_col).cast("string"))
    return docs.join(bad, (own[0] == F.col(names[0])) & (own[1] == F.col(names[1])), "left_anti")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    docs, items = read_table(spark, f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, items).drop("hit_spans", "near")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
