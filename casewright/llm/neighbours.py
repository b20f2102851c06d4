"""Problem 3: most similar vectors for every vector.

Additive quantisation. Vectors of one model and one true length form a group; each is taken to unit length. A
coarse codebook (spherical k-means) names the cell of a vector; residual codebooks of full dimension follow,
trained one on the residual of the other and then refined together by least squares. A vector is encoded by
beam search over the codebooks; with the codes the norm of the reconstruction is stored. A query reads, for each
cell it probes, one table of inner products with the codewords; a vector's score is the sum of its looked-up
entries over the stored norm. The best `rerank` of a block, and all that are tied with the last of them, are reranked
with the vectors.

Codebooks are fitted on a bounded sample: at most SAMPLE vectors of a group, chosen by a hash of the id. Every row
is encoded and searched.

Scale: exact copies are joined to one representative first (at most k + 1 smallest ids are kept: no other copy can be
among the k nearest of each other, ties going to the smaller id), so a vector that a third of all rows share costs one
row. Cells are split into blocks of BLOCK rows on the data side and on the query side, so no task holds more than one
block of each, however hot a cell is. The number of cells grows with the square root of the group up to CELLS. Only codebooks go
to the driver and back (groups x codewords x dimension).

Edge cases: null, empty, all-zero vectors and such with null, NaN or infinite components are left out; the stated
embedding_dimension is not read; lengths are never mixed; scaling does not matter; a group of one row has no pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.tagger import one_thread
from casewright.sources import materialise, small_side

SAMPLE = 20_000
CODEWORDS = 64
CODEBOOKS = 6
BEAM = 4
BLOCK = 4096
PROBE_MARGIN = 0.16
MAX_PROBES = 12
#: At most this many cells, as many as the sample can place; beyond, cells are split into more blocks.
CELLS = 4096
#: Scores this near to the last one reranked count as tied with it and are reranked too.
TIED = 1e-4


def kmeans(x: np.ndarray, k: int, steps: int = 12, seed: int = 7, spherical: bool = False) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(steps):
        s = x @ c.T if spherical else x @ c.T - 0.5 * (c * c).sum(1)
        own = s.argmax(1)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        if (n == 0).any():
            c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


class Quantiser:
    """coarse: cells x d; books: M x K x d, added to the coarse codeword."""

    def __init__(self, coarse: np.ndarray, books: np.ndarray):
        self.coarse, self.books = coarse.astype(np.float32), books.astype(np.float32)

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, books: int = CODEBOOKS, words: int = CODEWORDS, seed: int = 7) -> "Quantiser":
        x = np.ascontiguousarray(x, np.float32)
        coarse = kmeans(x, cells, seed=seed, spherical=True)
        rest = x - coarse[(x @ coarse.T).argmax(1)]
        start, r = [], rest.copy()
        for m in range(books):
            c = kmeans(r, words, steps=8, seed=seed + m + 1)
            start.append(c)
            r -= c[(r @ c.T - 0.5 * (c * c).sum(1)).argmax(1)]
        q = cls(coarse, np.stack(start))
        for _ in range(2):
            codes = q.beam(rest)
            hot = np.zeros((len(x), books * words), np.float32)
            for m in range(books):
                hot[np.arange(len(x)), m * words + codes[:, m].astype(np.int64)] = 1
            gram = hot.T @ hot + 1e-2 * np.eye(books * words, dtype=np.float32)
            q.books = np.linalg.solve(gram, hot.T @ rest).reshape(books, words, -1).astype(np.float32)
        return q

    def beam(self, rest: np.ndarray, width: int = BEAM) -> np.ndarray:
        """Codes (n x M) of residuals: of the partial sums, the `width` nearest go on to the next codebook."""
        n, d = rest.shape
        kept, codes = rest[:, None, :], np.zeros((n, 1, 0), np.uint8)
        for c in self.books:
            err = (kept * kept).sum(2)[:, :, None] - 2 * (kept @ c.T) + (c * c).sum(1)
            flat = err.reshape(n, -1)
            w = min(width, flat.shape[1])
            best = np.argpartition(flat, w - 1, axis=1)[:, :w]
            parent, word = best // len(c), best % len(c)
            kept = np.take_along_axis(kept, parent[:, :, None], 1) - c[word]
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
        last = (kept * kept).sum(2).argmin(1)
        return codes[np.arange(n), last]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, codes, norm of the reconstruction)."""
        cell = (x @ self.coarse.T).argmax(1)
        codes = self.beam(x - self.coarse[cell])
        return cell, codes, np.linalg.norm(self.decode(cell, codes), axis=1)

    def decode(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.coarse[cell] + self.books[np.arange(len(self.books)), codes].sum(1)

    def scores(self, q: np.ndarray, cell: np.ndarray, codes: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Approximate cosines (data x queries) by table look-up."""
        table = (self.books.reshape(-1, self.books.shape[2]) @ q.T).astype(np.float32)
        s = (self.coarse @ q.T)[cell]
        for m in range(codes.shape[1]):
            s += table[m * self.books.shape[1] + codes[:, m].astype(np.int64)]
        return s / np.maximum(norm, 1e-6)[:, None]

    def probes(self, x: np.ndarray, margin: float, most: int) -> list[np.ndarray]:
        s = x @ self.coarse.T
        w = min(most, s.shape[1])
        top = np.argpartition(-s, w - 1, axis=1)[:, :w]
        near = np.take_along_axis(s, top, 1)
        return [t[v >= v.max() - margin] for t, v in zip(top, near)]

    def dump(self) -> bytes:
        head = np.array([*self.coarse.shape, *self.books.shape], np.int64)
        return head.tobytes() + self.coarse.tobytes() + self.books.tobytes()

    @classmethod
    def load(cls, data: bytes) -> "Quantiser":
        k, d, m, w, _ = np.frombuffer(data[:40], np.int64)
        body = np.frombuffer(data[40:], np.float32)
        return cls(body[: k * d].reshape(k, d), body[k * d :].reshape(m, w, d))


def distinct_vectors(chunks: DataFrame, k: int) -> DataFrame:
    """(grp, rid, ids, v): one row per different vector of a model; ids are its k + 1 smallest ids, rid the smallest."""
    ok = "id is not null and embedding_model is not null and size(embedding) > 0"
    sane = F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < float('inf')) and exists(embedding, x -> x <> 0)")
    v = chunks.where(ok).where(sane).select("id", F.concat_ws("/", "embedding_model", F.size("embedding").cast("string")).alias("grp"), F.col("embedding").cast("array<float>").alias("v"))
    few = v.withColumn("rn", F.row_number().over(Window.partitionBy("grp", "v").orderBy("id"))).where(F.col("rn") <= k + 1)
    return few.groupBy("grp", "v").agg(F.sort_array(F.collect_set("id")).alias("ids")).select("grp", F.col("ids")[0].alias("rid"), "ids", "v")


def unit(v: pd.Series) -> np.ndarray:
    x = np.stack(v.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def fit(reps: DataFrame, sample: int = SAMPLE) -> dict[str, Quantiser]:
    """A quantiser for each group, from at most `sample` of its vectors; about sqrt(n) cells, between 4 and CELLS. There are no more
    groups than models times lengths up to the longest vector, and a quantiser takes some 100 KB, so they fit the driver."""
    sizes = reps.groupBy("grp").agg(F.count("*").alias("n"))
    w = Window.partitionBy("grp").orderBy(F.xxhash64("rid"), "rid")
    # The hash thins each group to about the sample before anything is shuffled; the rank makes the bound exact.
    thin = F.pmod(F.xxhash64("rid"), F.lit(1 << 20)) < F.lit(1.3 * sample * (1 << 20)) / F.col("n")
    some = reps.select("grp", "rid", "v").join(F.broadcast(sizes), "grp").where(thin).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= sample)

    def run(d: pd.DataFrame) -> pd.DataFrame:
        n = int(d.n.iloc[0])
        cells = int(2 ** np.clip(np.round(np.log2(np.sqrt(n))), 2, np.log2(CELLS)))
        q = Quantiser.fit(unit(d.sort_values("rid").v), min(cells, max(1, len(d) // 4)))
        return pd.DataFrame({"grp": [d.grp.iloc[0]], "q": [q.dump()]})

    return {r.grp: r.q for r in some.groupBy("grp").applyInPandas(run, "grp string, q binary").collect()}


def encoded(reps: DataFrame, quantisers: dict[str, bytes], margin: float, most: int) -> DataFrame:
    """(grp, rid, cell, codes, norm, half, probes): half is the unit vector in half precision."""

    def run(batches):
        have = {g: Quantiser.load(q) for g, q in quantisers.items()}
        for d in batches:
            for g, part in d.groupby("grp"):
                x = unit(part.v)
                cell, codes, norm = have[g].encode(x)
                yield pd.DataFrame({
                    "grp": g, "rid": part.rid.to_numpy(), "cell": cell.astype(np.int32), "codes": [c.tobytes() for c in codes], "norm": norm.astype(np.float32),
                    "half": [h.tobytes() for h in x.astype(np.float16)], "probes": [p.astype(np.int32) for p in have[g].probes(x, margin, most)],
                })

    return reps.select("grp", "rid", "v").mapInPandas(run, "grp string, rid long, cell int, codes binary, norm float, half binary, probes array<int>")


def search(index: DataFrame, queries: DataFrame, quantisers: dict[str, bytes], k: int, rerank: int, min_cosine: float | None) -> DataFrame:
    """(rid, other, cosine): for every query and block the k best after reranking, of at least min_cosine.

    index and queries: grp, rid, part (the cell, or a block number where all is searched), and their columns. Blocks on
    both sides bound what a task holds."""
    n = index.groupBy("grp", "part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("dbs"))
    m = queries.groupBy("grp", "part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("qbs"))
    blocks = materialise(n.join(m, ["grp", "part"]))
    blocks = small_side(blocks)  # groups x cells rows
    left = index.join(blocks, ["grp", "part"]).select("grp", "part", F.pmod(F.xxhash64("rid"), "dbs").alias("db"), F.explode(F.sequence(F.lit(0), F.col("qbs") - 1)).alias("qb"), "rid", "cell", "codes", "norm", "half")
    asked = queries.select(F.col("grp").alias("g"), F.col("part").alias("p"), F.col("rid").alias("qid"), F.col("half").alias("qhalf"))
    parts = blocks.select(F.col("grp").alias("g"), F.col("part").alias("p"), "dbs", "qbs")
    right = asked.join(small_side(parts), ["g", "p"]).select("g", "p", F.explode(F.sequence(F.lit(0), F.col("dbs") - 1)).alias("d"), F.pmod(F.xxhash64("qid", F.lit(1)), "qbs").cast("int").alias("q"), "qid", "qhalf")
    right = right.withColumn("d", F.col("d").cast("long"))
    loaded: dict[str, Quantiser] = {}

    def run(key, d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        one_thread()
        out = {"rid": [], "other": [], "cosine": []}
        if len(d) and len(q):
            if key[0] not in loaded:
                loaded[key[0]] = Quantiser.load(quantisers[key[0]])
            z = loaded[key[0]]
            x = np.frombuffer(b"".join(d.half), np.float16).reshape(len(d), -1).astype(np.float32)
            codes = np.frombuffer(b"".join(d.codes), np.uint8).reshape(len(d), -1)
            ids, cell, norm = d.rid.to_numpy(), d.cell.to_numpy(), d.norm.to_numpy()
            for at in range(0, len(q), 512):
                part = q.iloc[at : at + 512]
                y = np.frombuffer(b"".join(part.qhalf), np.float16).reshape(len(part), -1).astype(np.float32)
                own = part.qid.to_numpy()
                s = z.scores(y, cell, codes, norm).T
                w = min(rerank, s.shape[1])
                top = np.argpartition(-s, w - 1, axis=1)[:, :w]
                exact = np.einsum("qrd,qd->qr", x[top], y)
                exact[ids[top] == own[:, None]] = -2
                least = -1.5 if min_cosine is None else min_cosine - 0.003
                order = np.argsort(-exact, axis=1, kind="stable")[:, :k]
                good = np.take_along_axis(exact, order, 1)
                # Near copies share their codes and so their scores: all rows tied with the last one are reranked.
                last = np.take_along_axis(s, top, 1).min(1)
                tied = np.flatnonzero((s >= last[:, None] - TIED).sum(1) > w)
                plain = np.ones(len(part), bool)
                plain[tied] = False
                r, c = np.nonzero((good >= least) & plain[:, None])
                out["rid"].append(own[r])
                out["other"].append(ids[top[r, order[r, c]]])
                out["cosine"].append(good[r, c].astype(float))
                for i in tied:
                    near = np.flatnonzero(s[i] >= last[i] - TIED)
                    near = near[ids[near] != own[i]]
                    cosine = x[near] @ y[i]
                    best = np.lexsort((ids[near], -cosine))[:k]
                    best = best[cosine[best] >= least]
                    out["rid"].append(np.repeat(own[i], len(best)))
                    out["other"].append(ids[near[best]])
                    out["cosine"].append(cosine[best].astype(float))
        return pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in out.items()}).astype({"rid": "int64", "other": "int64", "cosine": "float64"})

    left = left.withColumn("db", F.col("db").cast("long")).withColumn("qb", F.col("qb").cast("int"))
    return left.groupBy("grp", "part", "db", "qb").cogroup(right.groupBy("g", "p", "d", "q")).applyInPandas(run, "rid long, other long, cosine double")


def exact_cosine(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """pairs (rid, other) with the cosine of the stored vectors."""
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    a = reps.select("rid", F.col("v").alias("va"))
    b = reps.select(F.col("rid").alias("other"), F.col("v").alias("vb"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    # Few pairs come to the vectors rather than the vectors to the pairs; many pairs are shuffled.
    first = materialise(a.join(small_side(pairs.select("rid", "other"), 200_000), "rid"))
    j = b.join(small_side(first, 50_000), "other")
    return j.select("rid", "other", (dot / (norm(F.col("va")) * norm(F.col("vb")))).alias("cosine"))


def mutual_pairs(chunks: DataFrame, k: int = 5, min_cosine: float = 0.90, rerank: int = 32, margin: float = PROBE_MARGIN, most: int = MAX_PROBES) -> DataFrame:
    """(chunk_a, chunk_b, cosine), chunk_a < chunk_b: each among the k most similar of the other (ties: the smaller id
    first), cosine at least min_cosine."""
    reps = materialise(distinct_vectors(chunks, k))
    quantisers = fit(reps)
    enc = materialise(encoded(reps, quantisers, margin, most))
    index = enc.withColumn("part", F.col("cell")).drop("probes")
    queries = enc.select("grp", "rid", "half", F.explode("probes").alias("part"))
    found = materialise(search(index, queries, quantisers, k, rerank, min_cosine))
    # A pair may be missed in one direction; the cosine is the same in both.
    both = found.select(F.least("rid", "other").alias("rid"), F.greatest("rid", "other").alias("other")).distinct()
    near = exact_cosine(both, reps).where(F.col("cosine") >= min_cosine)
    near = materialise(near)
    sided = near.select("rid", "other", "cosine").unionByName(near.select(F.col("other").alias("rid"), F.col("rid").alias("other"), "cosine"))
    copies = reps.where(F.size("ids") > 1).select("rid", F.col("rid").alias("other"), F.lit(1.0).alias("cosine"))
    links = sided.unionByName(copies)
    a = reps.select("rid", F.explode("ids").alias("a"))
    b = reps.select(F.col("rid").alias("other"), F.explode("ids").alias("b"))
    pairs = links.join(a, "rid").join(b, "other").where("a <> b")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).where(F.col("rank") <= k)
    sides = ranked.select(F.least("a", "b").alias("chunk_a"), F.greatest("a", "b").alias("chunk_b"), "cosine").groupBy("chunk_a", "chunk_b").agg(F.count("*").alias("sides"), F.max("cosine").alias("cosine"))
    return sides.where(F.col("sides") == 2).select("chunk_a", "chunk_b", "cosine")


def nearest(chunks: DataFrame, every: int = 20, k: int = 5, rerank: int = 256) -> DataFrame:
    """(chunk_id, rank, neighbour, cosine): the k most similar vectors of every row whose id is divisible by `every`,
    against all rows. All cells are searched by table look-up; the best `rerank` of a block of rows are reranked."""
    reps = materialise(distinct_vectors(chunks, k))
    quantisers = fit(reps)
    enc = materialise(encoded(reps, quantisers, 0.0, 1))
    size = enc.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    index = enc.join(F.broadcast(size), "grp").withColumn("part", F.pmod(F.xxhash64("rid", F.lit(2)), "parts").cast("int")).drop("probes", "parts")
    # All ids of a wanted row, not only its representative, decide whether a vector is a query.
    wanted = reps.join(chunks.where(F.col("id") % every == 0).where("size(embedding) > 0").select(F.concat_ws("/", "embedding_model", F.size("embedding").cast("string")).alias("grp"), F.col("embedding").cast("array<float>").alias("v"), F.col("id").alias("chunk_id")), ["grp", "v"]).select("rid", "chunk_id")
    wanted = materialise(wanted)
    ask = enc.join(wanted.select("rid").distinct(), "rid", "left_semi").join(F.broadcast(size), "grp")
    queries = ask.select("grp", "rid", "half", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    found = search(index, queries, quantisers, k, rerank, None)
    best = found.withColumn("rn", F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("cosine"), "other"))).where(F.col("rn") <= k + 1)
    near = exact_cosine(best, reps)
    own = wanted.select("rid").distinct().select("rid", F.col("rid").alias("other"), F.lit(1.0).alias("cosine"))
    b = reps.select(F.col("rid").alias("other"), F.explode("ids").alias("neighbour"))
    pairs = wanted.join(near.unionByName(own), "rid").join(b, "other").where("neighbour <> chunk_id")
    w = Window.partitionBy("chunk_id").orderBy(F.desc("cosine"), "neighbour")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("chunk_id", "rank", "neighbour", "cosine")
