"""What the routes of a run find, for all requests of a step at once.

A Searcher is the `retrieve` of routing.run(): each step's requests are served by the route that they were sent to. Equal
searches are made once: texts (semantic), lists of names (relation, text2sql) that no step before has looked for go to the
indexes together, and what they find is kept in tables beside those of earlier steps, to which states are joined. Semantic
searches fuse both indexes (R.hybrid_all); names that stand in their first texts are discovered. Relations are those of
graph.relations_of_requests(); text2sql counts the facts of the names, ROWS at most, as the reference's statements fetch
no more."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import cut
from . import graph, routing
from . import retrieval as R
from . import sparse_index as S
from . import vector_index as V

TOP, READ, MOST_NEW, ROWS, DIM = 15, 5, 8, 50, 384
NAMES_END = "\x1f"


def hashed_sums(terms: DataFrame, dim: int = DIM) -> DataFrame:
    """key and sums, the hashed dense vector before it is scaled, dim whole numbers of 32 bits, of rows of sparse_index.terms();
    those whose numbers are all zero are left out. A token is hashed once a batch."""

    def run(batches):
        for batch in batches:
            size, tokens, tf = S._postings(batch)
            tokens = tokens.dictionary_encode()
            h = np.frombuffer(b"".join(hashlib.md5(t.encode()).digest()[:5] for t in tokens.dictionary.to_pylist()), np.uint8).reshape(-1, 5).astype(np.int64)
            at, sign = (h[:, :4] @ (1 << np.array([24, 16, 8, 0]))) % dim, 1 - 2 * (h[:, 4] % 2)
            token, row = tokens.indices.to_numpy(), np.repeat(np.arange(batch.num_rows), size)
            x = np.bincount(row * dim + at[token], weights=sign[token] * tf, minlength=batch.num_rows * dim).reshape(-1, dim)
            some = np.flatnonzero(x.any(axis=1))
            packed = pa.array([r.tobytes() for r in x[some].astype(np.int32)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(some)), packed], ["key", "sums"])

    return terms.where("dl > 0").select("key", "words", "tfs").mapInArrow(run, "key long, sums binary")


def _scaled(batches, rows: int = V.QUERY_ROWS):
    """key and v, the vectors of rows of hashed_sums(), a part at a time."""
    for big in batches:
        for start in range(0, big.num_rows, rows):
            batch = big.slice(start, rows)
            x = S._numbers(batch.column("sums")).reshape(batch.num_rows, -1).astype(float)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * x.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.reshape(-1)))], ["key", "v"])


def _vectors(sums: DataFrame) -> DataFrame:
    return sums.mapInArrow(_scaled, "key long, v array<double>")


def dense_vectors(texts: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """key and vector, the hashed dense vector as an array; texts without tokens have none. Keys are whole numbers."""
    return _vectors(hashed_sums(S.terms(texts, key, text), dim)).select(F.col("key").alias(key), F.col("v").alias("vector"))


@dataclass
class Searcher:
    """chunks: doc and text, indexed by sparse, and their hashed_sums(); triples with confidence; facts: entity. Few queries scan
    the sums; an index of the vectors, of so many cells, is built when more come."""

    sparse: S.SparseIndex
    sums: DataFrame
    chunks: DataFrame
    triples: DataFrame
    facts: DataFrame
    expand_by: tuple[str, ...] = graph.EXPAND
    cells: int = V.CELLS
    dense: V.VectorIndex | None = None
    found: dict[str, list[DataFrame]] = field(default_factory=lambda: {"semantic": [], "relation": [], "text2sql": []})

    @classmethod
    def over(cls, chunks: DataFrame, triples: DataFrame, facts: DataFrame, cells: int = V.CELLS, **kw) -> Searcher:
        """Builds the index of terms; vectors are made of its terms."""
        chunks = cut(chunks.select(F.col("doc").cast("long").alias("doc"), "text"))
        sparse = S.create(chunks.sparkSession)
        S.add(sparse, chunks, "doc", "text")
        # of equal triples a search uses the most confident alone
        once = triples.groupBy(*graph.SPO).agg(F.max("confidence").alias("confidence"))
        return cls(sparse, cut(hashed_sums(sparse.documents())), chunks, cut(once), cut(facts), cells=cells, **kw)

    def near(self, vectors: DataFrame) -> DataFrame:
        """query, key and value, the distance, of the 2 * TOP chunks nearest to each query (query, vector)."""
        asked = vectors.select("query", F.col("vector").alias("qv")).limit(V.QUERY_ROWS + 1).toArrow()
        if asked.num_rows <= V.QUERY_ROWS:
            scan = V._scan_whole(2 * TOP, "l2", asked)
            return V._best(self.sums.mapInArrow(lambda batches: scan(_scaled(batches)), "query long, key long, value double"), 2 * TOP)
        if self.dense is None:
            self.dense = V.build(cut(_vectors(self.sums)), "key", "v", "l2", self.cells)
        return V.search(self.dense, vectors, "query", "vector", 2 * TOP, exact=True)

    def semantic(self, asked: DataFrame) -> DataFrame:
        """what, scores (best first) and names of texts (what: the search text)."""
        q = cut(asked.select("what", F.xxhash64("what").alias("query")))
        vectors = cut(dense_vectors(q, "query", "what"))
        near = self.near(vectors)
        sparse = S.search(self.sparse, q, "query", "what", 2 * TOP)
        best = cut(R.hybrid_all(near.select("query", F.col("key").alias("doc"), F.col("value").alias("distance")), sparse, TOP))
        lists = best.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))
        read = best.where(F.col("rank") <= READ).join(self.chunks, "doc")
        has = F.array_compact(F.array(*(F.when(F.contains("text", F.lit(n)), F.lit(n)) for n in R.DISCOVERABLE)))
        names = read.select("query", F.explode(has).alias("n")).groupBy("query").agg(F.collect_set("n").alias("names"))
        every = F.array(*map(F.lit, R.DISCOVERABLE))  # in the order of the list
        both = q.join(lists, "query").join(names, "query", "left")
        return both.select("what", "scores", F.filter(every, lambda n: F.array_contains(F.coalesce("names", F.array().cast("array<string>")), n)).alias("names"))

    def relation(self, asked: DataFrame) -> DataFrame:
        """what, texts and scores of lists of names, in order of hop and triple."""
        pairs = asked.select(F.col("what").alias("request"), F.explode(F.split("what", NAMES_END)).alias("entity")).where("entity <> ''")
        rows = graph.relations_of_requests(self.triples, pairs, self.expand_by)
        listed = F.array_sort(F.collect_list(F.struct("hop", "subject", "predicate", "object", "confidence")))
        return rows.groupBy(F.col("request").alias("what")).agg(listed.alias("l")).select("what", F.transform("l", lambda x: F.concat_ws(" ", x["subject"], x["predicate"], x["object"])).alias("texts"), F.transform("l", lambda x: x["confidence"]).alias("scores"))

    def text2sql(self, asked: DataFrame) -> DataFrame:
        pairs = asked.select("what", F.explode(F.split("what", NAMES_END)).alias("entity"))
        counts = self.facts.join(pairs.select("entity").distinct(), "entity", "left_semi").groupBy("entity").agg(F.count("*").alias("n"))
        return pairs.join(counts, "entity").groupBy("what").agg(F.least(F.sum("n"), F.lit(ROWS)).cast("int").alias("rows"))

    def _known(self, route: str, wanted: DataFrame) -> DataFrame | None:
        """What this and earlier steps found, for each thing asked; things that found nothing aren't in it."""
        new = wanted.distinct()
        for earlier in self.found[route]:
            new = new.join(earlier.select("what"), "what", "left_anti")
        new = cut(new)
        if new.limit(1).count():
            # a left join, so that what found nothing isn't asked again
            self.found[route].append(cut(new.join(getattr(self, route)(new), "what", "left")))
        tables = self.found[route]
        out = tables[0] if tables else None
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    def retrieve(self, states: DataFrame) -> DataFrame:
        """states with the evidence of the routes that they were sent to."""
        c = F.col
        missing = F.array_except("entities", routing.covered(c("entities"), c("relation_texts")))
        context = routing.route_context(c("intent"), c("query"), c("entities"), missing)
        text = F.when(c("semantic_retries") > 0, context["expanded_query"]).when(F.size("errors") > 0, context["semantic_query"]).otherwise(c("query"))
        names = F.array_join(F.array_sort(F.array_distinct("entities")), NAMES_END)
        out = cut(states.withColumns({"_what": F.when(c("next_route") == "semantic", text).when(c("next_route").isin("relation", "text2sql"), names)}))
        for route in self.found:
            known = self._known(route, out.where(c("next_route") == route).select(c("_what").alias("what")))
            if known is None:
                continue
            own = known.select(F.struct(F.lit(route).alias("r"), "what").alias("_k"), F.struct(*[x for x in known.columns if x != "what"]).alias(f"_{route}"))
            out = out.withColumn("_k", F.struct(c("next_route").alias("r"), c("_what").alias("what"))).join(own, "_k", "left").drop("_k")
        none, no_scores = F.array().cast("array<string>"), F.array().cast("array<double>")
        if "_semantic" in out.columns:
            on, fresh = c("next_route") == "semantic", F.filter(F.coalesce("_semantic.names", none), lambda n: ~F.array_contains("entities", n))
            out = out.withColumns({"semantic": F.when(on, F.coalesce("_semantic.scores", no_scores)).otherwise(c("semantic")), "discovered": F.when(on, F.slice(fresh, 1, MOST_NEW)).otherwise(c("discovered"))})
        if "_relation" in out.columns:
            on = c("next_route") == "relation"
            out = out.withColumns({"relation_texts": F.when(on, F.coalesce("_relation.texts", none)).otherwise(c("relation_texts")), "relation_scores": F.when(on, F.coalesce("_relation.scores", no_scores)).otherwise(c("relation_scores"))})
        if "_text2sql" in out.columns:
            out = out.withColumn("sql_rows", F.when(c("next_route") == "text2sql", F.coalesce("_text2sql.rows", F.lit(0))).otherwise(c("sql_rows")))
        return out.select(*states.columns)


OWN = ("intent", "query", "entities", "planned")


def run(requests: DataFrame, searcher: Searcher, columns: dict[str, Column] | None = None) -> DataFrame:
    """routing.run() with what the searcher finds; each step's states are written. What happens to a request follows from
    OWN alone, so requests that are equal in them are one state, and get its end back. columns: what is wanted of the end
    states, beside the requests' other columns; all of them if None."""
    asked = cut(requests.withColumn("_own", F.struct(*OWN)).drop(*OWN))
    ended = routing.run(asked.select("_own").distinct().select("_own", *(F.col("_own")[c].alias(c) for c in OWN)), searcher.retrieve, cut)
    order = [c for c in (*requests.columns, *ended.columns) if c != "_own"] if columns is None else [*asked.drop("_own").columns, *columns]
    wanted = ended if columns is None else ended.select("_own", *(v.alias(k) for k, v in columns.items()))
    return asked.join(wanted, "_own").select(*dict.fromkeys(order))

