"""Inverted index, BM25 and the ranked search on top of it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import index_tokens
from ..schema import HUBS, MAIN, TYPE_BOOST, choose
from ..shared import few, kept

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class SearchOptions:
    limit: int = 50
    include_types: tuple[str, ...] = ()
    exclude_types: tuple[str, ...] = ()
    with_symbols: bool = True
    scope: str | None = None
    #: strict: the scope alone; hubs: and the four project hubs; main: and all of the main scope
    scope_mode: str = "hubs"
    #: Rows of the index that are looked at before types are filtered; None: all.
    oversample: int | None = 50
    type_boosts: dict[str, float] = field(default_factory=lambda: dict(TYPE_BOOST))


def allowed(opts: SearchOptions) -> Column:
    """The type filter of the options."""
    ok = F.lit(True)
    if opts.include_types:
        ok = ok & F.col("node_type").isin(*opts.include_types)
    if opts.exclude_types:
        ok = ok & ~F.col("node_type").isin(*opts.exclude_types)
    return ok if opts.with_symbols else ok & (F.col("node_type") != "symbol")


def in_scope(scope: str | None, mode: str = "hubs", scope_col: str = "scope", id_col: str = "id") -> Column:
    if scope is None:
        return F.lit(True)
    own = F.col(scope_col) == scope
    if mode == "strict":
        return own
    return own | F.col(id_col).isin(*HUBS) if mode == "hubs" else own | (F.col(scope_col) == MAIN)


def postings(docs: DataFrame) -> DataFrame:
    """docs (node_id, title, content, tags) to (term, node_id, tf, positions, len), the index to be kept as a table.

    Positions count through a field's tokens; fields are a gap apart, so that no
    phrase goes across two. One shuffle, by document and term; write it partitioned
    by a hash of the term where it is to serve single queries.
    """
    gap = 1 << 20

    def placed(name: str, base: int) -> Column:
        return F.transform(index_tokens(F.col(name)), lambda t, i: F.struct(t.alias("term"), (i + base).alias("pos")))

    fields = [placed(c, k * gap) for k, c in enumerate(("title", "content", "tags"))]
    d = docs.select("node_id", F.concat(*fields).alias("t")).withColumn("len", F.size("t"))
    return d.select("node_id", "len", F.inline("t")).groupBy("term", "node_id", "len").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


#: Most terms of a batch of searches for which postings are made of these alone.
FEW_TERMS = 1000


def index_for(docs: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings that the queries need, corpus size) where no index is kept: texts are cut into tokens once.

    Of each document its length and the tokens that are asked for are kept; so little
    moves. A batch of more terms than FEW_TERMS meets the whole index instead.
    """
    asked = queries.select(F.explode("tokens").alias("t")).select(F.explode(index_tokens(F.col("t"))).alias("term")).distinct()
    terms = [r.term for r in asked.limit(FEW_TERMS + 1).collect()]
    if len(terms) > FEW_TERMS:
        return postings(docs), corpus_size(docs)
    gap = 1 << 20

    def placed(name: str, base: int) -> Column:
        return F.transform(index_tokens(F.col(name)), lambda t, i: F.struct(t.alias("term"), (i + base).alias("pos")))

    every = F.concat(*[placed(c, k * gap) for k, c in enumerate(("title", "content", "tags"))])
    # worked out once, not for its size and its filter each
    once = F.get(F.transform(F.array(every), lambda t: F.struct(F.size(t).alias("len"), F.filter(t, lambda x: x["term"].isin(*terms)).alias("t"))), F.lit(0))
    d = kept(docs.select("node_id", once.alias("o")).select("node_id", "o.len", "o.t"))
    index = d.select("node_id", "len", F.inline("t")).groupBy("term", "node_id", "len").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    return index, d.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))


def corpus_size(docs: DataFrame) -> DataFrame:
    """One row: n documents and their average length in tokens."""
    n = F.size(index_tokens(F.col("title"))) + F.size(index_tokens(F.col("content"))) + F.size(index_tokens(F.col("tags")))
    return docs.select(n.alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))


def bm25(index: DataFrame, size: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (query_id, tokens) to (query_id, node_id, bm25), less for better.

    A token of several index terms is a phrase. Terms of the queries, a small table,
    meet the index by term; only postings of asked terms are scored.
    """
    asked = queries.select("query_id", F.posexplode(F.array_distinct("tokens")).alias("slot", "token")).withColumn("terms", index_tokens(F.col("token"))).where(F.size("terms") > 0)
    single = asked.where(F.size("terms") == 1).select("query_id", "slot", F.get("terms", F.lit(0)).alias("term")).join(index.select("term", "node_id", "tf", "len"), "term").select("query_id", "slot", "node_id", "tf", "len")
    parts = asked.where(F.size("terms") > 1).select("query_id", "slot", F.size("terms").alias("k"), F.posexplode("terms").alias("i", "term"))
    at = parts.join(index.select("term", "node_id", "positions", "len"), "term").select("query_id", "slot", "k", "i", "node_id", "len", F.explode("positions").alias("p"))
    starts = at.groupBy("query_id", "slot", "k", "node_id", "len", (F.col("p") - F.col("i")).alias("s")).agg(F.count_distinct("i").alias("c")).where("c = k")
    hits = single.unionByName(starts.groupBy("query_id", "slot", "node_id", "len").agg(F.count("*").alias("tf")))
    df = hits.groupBy("query_id", "slot").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf > 0, idf).otherwise(F.lit(1e-6))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return hits.join(F.broadcast(df), ["query_id", "slot"]).crossJoin(F.broadcast(size)).groupBy("query_id", "node_id").agg((-F.sum(score)).alias("bm25"))


#: Documents of a task where a batch of searches is scored.
SCORED_DOCS = 50_000
#: Hits of a task where texts are looked at for the tokens.
SCORED_HITS = 2_000
_FIELDS = ("title", "content", "tags")


def _tallied(slots: dict[tuple[str, ...], int]):
    """Rows (node_id, tokens of the fields) to (node_id, len, slots, tfs): how often a document has what is asked for, phrases within a field."""
    terms = {t: k for k, t in enumerate(sorted({t for s in slots for t in s}))}
    single = np.full(len(terms) + 1, -1, np.int64)  # the last: no term of the batch
    for s, k in slots.items():
        if len(s) == 1:
            single[terms[s[0]]] = k
    phrases = [(k, [terms[t] for t in s]) for s, k in slots.items() if len(s) > 1]
    known = pa.array(list(terms), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, keys = np.zeros(b.num_rows, np.int64), []
            for name in _FIELDS:
                tokens = b.column(name)
                n = np.diff(tokens.offsets.to_numpy())
                length += n
                doc = np.repeat(np.arange(b.num_rows), n)
                code = pc.fill_null(pc.index_in(tokens.flatten(), known), -1).to_numpy(zero_copy_only=False)
                one = single[code]
                keys.append((doc * len(slots) + one)[one >= 0])
                for k, line in phrases:
                    at = np.flatnonzero(code == line[0])
                    at = at[at <= len(code) - len(line)]
                    at = at[doc[at] == doc[at + len(line) - 1]]
                    for i, t in enumerate(line[1:], 1):
                        at = at[code[at + i] == t]
                    keys.append(doc[at] * len(slots) + k)
            key, tf = np.unique(np.concatenate(keys), return_counts=True)
            ends = pa.array(np.searchsorted(key, np.arange(b.num_rows + 1) * len(slots)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (key % max(len(slots), 1), tf)]
            yield pa.RecordBatch.from_arrays([b.column("node_id").cast(pa.string()), pa.array(length), *lists], names=["node_id", "len", "slots", "tfs"])

    return run


def _scored(asked: list[tuple[object, list[int]]], idf: np.ndarray, avg_len: float, n: int | None, kind: pa.DataType):
    """A task's tallied documents to the best n of each query, by BM25 to nine places and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        if not t.num_rows:
            return
        t = t.sort_by("node_id").combine_chunks()
        ids, held = t.column("node_id").combine_chunks(), t.column("slots").combine_chunks()
        doc = np.repeat(np.arange(t.num_rows), np.diff(held.offsets.to_numpy())).astype(np.int32)
        slot, tf = held.flatten().to_numpy(), t.column("tfs").combine_chunks().flatten().to_numpy().astype(float)
        score = idf[slot] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * t.column("len").to_numpy()[doc] / avg_len))
        line = np.argsort(slot, kind="stable")
        bound = np.searchsorted(slot[line], np.arange(len(idf) + 1))
        doc, score = doc[line], score[line]
        total = np.zeros(t.num_rows)
        out = []

        def rows() -> pa.RecordBatch:
            at = np.concatenate([x for _, x, _ in out])
            names = pa.array([q for q, x, _ in out for _ in range(len(x))], kind)
            return pa.RecordBatch.from_arrays([names, ids.take(pa.array(at)), pa.array(-np.concatenate([x for _, _, x in out]))], names=["query_id", "node_id", "bm25"])

        for q, wanted in asked:
            total[:] = 0
            for k in wanted:
                total[doc[bound[k] : bound[k + 1]]] += score[bound[k] : bound[k + 1]]  # a document stands once in a slot
            hit = np.flatnonzero(total)
            if n is not None and len(hit) > n:
                hit = hit[total[hit] >= np.partition(total[hit], len(hit) - n)[len(hit) - n] - 1e-8]
                hit = hit[np.lexsort((hit, -np.round(total[hit], 9)))[:n]]
            out.append((q, hit, total[hit]))
            if sum(len(x) for _, x, _ in out) > 100_000:
                yield rows()
                out = []
        if out:
            yield rows()

    return run


def batch_bm25(docs: DataFrame, queries: DataFrame, known: DataFrame, n: int | None) -> DataFrame:
    """(query_id, node_id, bm25) of each query's best n (None: all) of the known documents (id), where no index is kept.

    Scores are those of bm25(). Documents are cut once and tallied where they stand,
    and each task scores all queries over its documents, so what moves is a
    document's tallies and each task's best. Brought to the driver: the queries, a
    count of documents a distinct token.
    """
    rows = queries.select("query_id", F.transform(F.array_distinct("tokens"), index_tokens).alias("t")).collect()
    slots: dict[tuple[str, ...], int] = {}
    asked = [(r["query_id"], [slots.setdefault(tuple(t), len(slots)) for t in r["t"] or () if t]) for r in rows]
    d = docs.select("node_id", *[index_tokens(F.col(c)).alias(c) for c in _FIELDS])
    d = kept(d.mapInArrow(_tallied(slots), "node_id string, len long, slots array<int>, tfs array<int>"))
    size = d.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len")).first()
    df = np.zeros(len(slots))
    for r in d.select(F.explode("slots").alias("slot")).groupBy("slot").agg(F.count("*").alias("df")).collect():
        df[r["slot"]] = r["df"]
    idf = np.log((size["n"] - df + 0.5) / (df + 0.5))
    d = d.repartition(max(1, -(-size["n"] // SCORED_DOCS)), "node_id").join(known.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    kind = queries.schema["query_id"].dataType
    found = d.mapInArrow(_scored(asked, np.where(idf > 0, idf, 1e-6), size["avg_len"] or 1.0, n, to_arrow_type(kind)), f"query_id {kind.simpleString()}, node_id string, bm25 double")
    return found if n is None else top(found, n, F.round("bm25", 9), F.col("node_id"))


def top(hits: DataFrame, n: int, *order: Column, by: str = "query_id") -> DataFrame:
    """The first n rows of each query."""
    return hits.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def fused(hits: DataFrame, boosts: dict[str, float]) -> Column:
    """The ranked score: BM25 by hub, what tokens hit in title, id, body, tags and aliases, times the type's factor."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    s = F.greatest(-F.col("bm25"), F.lit(0.01))
    path = low("file_path")
    s = s * F.when((F.col("id") == "readme") | (F.col("file_path") == "README.md"), 1.2).otherwise(1.0)
    s = s * F.when((F.col("id") == "changelog") | (path == "changelog.md"), 1.15).otherwise(1.0)
    s = s * F.when(F.col("id").isin("roadmap", "backlog"), 1.1).otherwise(1.0)
    # texts are put in lower case once a row, not once a token
    texts = F.array(F.struct(low("title").alias("a"), low("id").alias("b"), low("content").alias("c")))
    hit = lambda x, t: F.struct(x["a"].contains(t).alias("a"), x["b"].contains(t).alias("b"), x["c"].contains(t).alias("c"))
    points = lambda h: h["a"].cast("int") * 2.0 + h["b"].cast("int") * 1.5 + h["c"].cast("int") * 0.75
    # the sum of points, and how many tokens are covered
    step = lambda acc, h: F.struct((acc["sum"] + points(h)).alias("sum"), (acc["n"] + (h["a"] | h["b"] | h["c"]).cast("int")).alias("n"))
    found = F.get(F.transform(texts, lambda x: F.aggregate(F.transform("tokens", lambda t: hit(x, t)), F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), step)), F.lit(0))
    s, cover = s + found["sum"], found["n"]
    s = s + F.when((F.size("tokens") > 1) & (cover > 1), cover * 1.5).otherwise(0.0)
    pairs = lambda xs: F.size(F.flatten(F.transform(F.coalesce(F.col(xs), F.array().cast("array<string>")), lambda x: F.filter("tokens", lambda t: F.lower(x).contains(t)))))
    s = s + pairs("tags") * 3.0 + pairs("aliases") * 2.5
    return s * choose(F.col("node_type"), boosts, 1.0)


def augmented(nodes: DataFrame, tags: DataFrame, aliases: DataFrame, queries: DataFrame, per_token: int = 20) -> DataFrame:
    """(query_id, id, score): nodes that a token names as a tag (3.5) or an alias (3.0), at most per_token a token each."""
    asked = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("token"))
    tokens = kept(asked.select("token").distinct())
    known = nodes.select(F.col("id").alias("node_id"))

    def named(table: DataFrame, col: str, score: float) -> DataFrame:
        hits = table.select("node_id", F.lower(col).alias("token")).join(few(tokens), "token").distinct().join(known, "node_id", "left_semi")
        return top(hits, per_token, F.col("node_id"), by="token").join(asked, "token").select("query_id", F.col("node_id").alias("id"), F.lit(score).alias("score"))

    return named(tags, "tag", 3.5).unionByName(named(aliases, "alias", 3.0)).groupBy("query_id", "id").agg(F.max("score").alias("score"))


def ranked(nodes: DataFrame, docs: DataFrame, tags: DataFrame, aliases: DataFrame, queries: DataFrame, opts: SearchOptions | None = None, index: DataFrame | None = None, size: DataFrame | None = None) -> DataFrame:
    """queries (query_id, tokens) to (query_id, id, node_type, title, score, reason), the best `limit` of each.

    As many rows as `oversample` allows (at least twice the limit) come from the
    index by BM25, in scope, before types are filtered; rows that a tag or alias
    names exactly follow; of a node's scores the best counts. Ties go by id.
    """
    opts = opts or SearchOptions()
    scoped = nodes.where(in_scope(opts.scope, opts.scope_mode))
    most = None if opts.oversample is None else max(2 * opts.limit, opts.oversample)
    info = scoped.select("id", "node_type", "title", "file_path")
    if index is None:
        hits = few(kept(batch_bm25(docs, queries, scoped, most))).join(info, F.col("node_id") == F.col("id"))
    else:
        hits = bm25(index, corpus_size(docs) if size is None else size, queries).join(info, F.col("node_id") == F.col("id"))
        if most is not None:
            hits = top(hits, most, F.round("bm25", 9), F.col("id"))
    hits = kept(hits.where(allowed(opts)))
    # of few hits the texts and names are picked out where they stand
    ids = few(kept(hits.select("node_id").distinct()))
    some = lambda t: t.join(ids, "node_id", "left_semi")
    names = lambda t, c, out: some(t).groupBy("node_id").agg(F.array_sort(F.collect_set(c)).alias(out))
    tasks = max(1, -(-hits.count() // SCORED_HITS))
    rich = hits.repartition(tasks, "node_id").join(some(docs.select("node_id", "content")), "node_id", "left").join(names(tags, "tag", "tags"), "node_id", "left").join(names(aliases, "alias", "aliases"), "node_id", "left").join(F.broadcast(queries), "query_id")
    scored = rich.select("query_id", "id", fused(rich, opts.type_boosts).alias("score"), F.lit("match").alias("reason"))
    extra = augmented(scoped.where(allowed(opts)), tags, aliases, queries).withColumn("reason", F.lit("name"))
    best = scored.unionByName(extra).groupBy("query_id", "id").agg(F.max_by(F.struct("score", "reason"), F.struct("score", "reason")).alias("b"))
    out = best.select("query_id", "id", F.round("b.score", 6).alias("score"), "b.reason")
    return few(kept(top(out, opts.limit, F.desc("score"), F.col("id")))).join(scoped.select("id", "node_type", "title"), "id").select("query_id", "id", "node_type", "title", "score", "reason")


def all_terms(docs: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """The plain search: documents that hold every token, best first by BM25, at most 50."""
    q = docs.sparkSession.createDataFrame([(0, list(tokens))], "query_id int, tokens array<string>")
    index, size = index_for(docs, q)
    asked = index_tokens(F.lit(" ".join(tokens)))
    full = index.where(F.array_contains(asked, F.col("term"))).groupBy("node_id").agg(F.count_distinct("term").alias("c")).where(F.col("c") == F.size(F.array_distinct(asked)))
    return top(bm25(index, size, q).join(full.select("node_id"), "node_id", "left_semi"), 50, F.round("bm25", 9), F.col("node_id"))


def merged(results: Sequence[tuple[str, DataFrame]], limit: int) -> DataFrame:
    """Results of several workspaces in one order by score."""
    parts = [d.withColumn("workspace", F.lit(w)) for w, d in results]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return top(out, limit, F.desc("score"), F.col("workspace"), F.col("id"))
