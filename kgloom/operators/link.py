"""Linking names to the knowledge base: character n-gram TF-IDF candidates, surface similarity, acceptance."""
from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.functions import text as X
from kgloom.sources.writers import materialise


def _piece(col: str, k: int):
    """Function from a 1-based position to the k-gram there, null beyond the end."""
    return lambda i: F.when(i <= F.length(col) - (k - 1), F.substring(F.col(col), i, F.lit(k)))


def grams(df: DataFrame, key: str, col: str, n: int = 3) -> DataFrame:
    """(key, gram, tf): character n-grams of lengths 1..n of the lower-cased text, runs of blanks as one space."""
    t = df.select(key, F.regexp_replace(F.lower(col), r"\s\s+", " ").alias("t")).where("t IS NOT NULL AND t <> ''")
    per = [F.transform(F.sequence(F.lit(1), F.greatest(F.length("t") - (k - 1), F.lit(1))), _piece("t", k)) for k in range(1, n + 1)]
    return t.select(key, F.explode(F.array_compact(F.concat(*per))).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("tf"))


def idf(g: DataFrame, key: str) -> DataFrame:
    """(gram, df, idf) with idf = ln((1 + N) / (1 + df)) + 1."""
    n = g.select(key).distinct().agg(F.count("*").alias("n_docs"))
    return g.groupBy("gram").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("gram", "df", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))  # n: one row


def kb_rows(kb: DataFrame) -> DataFrame:
    """One row per id: its first name and all its spellings in one string."""
    named = F.array_compact(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    k = kb.select("entity_id", named.alias("names"), "type").where("size(names) > 0").groupBy("entity_id").agg(F.min(F.struct("names", "type")).alias("m"))
    return k.select("entity_id", F.col("m.names").alias("names"), F.col("m.type").alias("type"), F.array_join("m.names", " ").alias("doc"))


# names, mentions of documents and records of a block; they bound a task's memory and change no result
QUERY_BLOCK, MENTION_BLOCK, RECORD_BLOCK, CONTEXT_BLOCK = 32768, 196608, 50000, 200000
COMMON = 0.2  # grams in more than this share of a block's records count as common: they are summed only for records that may still be among the best
CHARS = 1 << 18  # of documents looked at together


def _plain(col: str) -> Column:
    """The text whose grams count: lower case, runs of blanks as one space."""
    return F.regexp_replace(F.lower(col), r"\s\s+", " ")


def _codes(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram) of every place: grams of up to ``n`` (three at most) characters as numbers, 21 bits a character."""
    c = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64) + 1
    own = np.repeat(np.arange(len(texts)), np.array([len(t) for t in texts], dtype=np.int64))
    x, out = np.zeros(len(c), dtype=np.int64), []
    for k in range(min(n, len(c))):
        x = x[:len(c) - k] + (c[k:] << 21 * k)
        same = own[:len(x)] == own[k:]
        out.append((own[:len(x)][same], x[same]))
    return tuple(np.concatenate(v) for v in zip(*out)) if out else (np.array([], dtype=np.int64),) * 2


def gram_counts(texts: DataFrame, n: int) -> DataFrame:
    """(code, n): in how many texts (one column) each gram is; code -1 has the number of texts that are not empty. Counted where the texts lie, batch by batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = [x for x in b.column(0).to_pylist() if x]
            own, code = _codes(t, n)
            gram, at = np.unique(code, return_inverse=True)
            held = np.bincount(np.unique(own * len(gram) + at) % max(len(gram), 1), minlength=len(gram))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(gram, -1)), pa.array(np.append(held, len(t)).astype(np.int64))], names=["code", "n"])
    return texts.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _with_grams(records: DataFrame, counts: DataFrame) -> DataFrame:
    """The records and, in rows without an id, the grams of all records with their counts: what a block needs to weigh texts."""
    g = counts.groupBy(F.pmod("code", F.lit(64)).alias("k")).agg(F.collect_list(F.struct("code", "n")).alias("g"))  # 64 rows
    return records.unionByName(g.select(F.col("g.code").alias("codes"), F.col("g.n").alias("ns")), allowMissingColumns=True)


class _Space:
    """The grams of a corpus in the order of their numbers, with idf = ln((1 + N) / (1 + df)) + 1."""

    def __init__(self, rows: pa.Table):
        code, n = (rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("codes", "ns"))
        by = np.argsort(code)
        code, n = code[by], n[by].astype(np.float64)
        total = n[0] if len(n) else 0.0  # of code -1
        self.code, self.idf = code[1:], np.log((1 + total) / (1 + n[1:])) + 1

    def vectors(self, texts: list[str], n: int, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, gram, weight) in this order, L2-normalised; a text is its own owner where none is given; grams the corpus lacks drop."""
        own, code = _codes(texts, n)
        own = own if owner is None else owner[own]
        g = np.searchsorted(self.code, code)
        held = self.code[np.minimum(g, len(self.code) - 1)] == code if len(self.code) else np.zeros(len(code), dtype=bool)
        key, tf = np.unique(own[held] * max(len(self.code), 1) + g[held], return_counts=True)
        own, g = key // max(len(self.code), 1), key % max(len(self.code), 1)
        w = tf * self.idf[g]
        return own, g, w / np.sqrt(np.bincount(own, w * w))[own]


def _ramp(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, ``size`` of them, all in a row."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _flat(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and weights of all rows in a row, and where each begins; a null list is empty."""
    c, w = t["codes"].combine_chunks(), t["ws"].combine_chunks()
    n = np.nan_to_num(pa.compute.list_value_length(c).to_numpy(zero_copy_only=False)).astype(np.int64)
    return c.flatten().to_numpy(zero_copy_only=False), w.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(n))


def _best_of_block(top: int):
    """The ``top`` best records of a block for every name of one, larger id first on ties, records without a common gram last.

    Rare grams are summed by their posting lists. What common grams may add to a record is at most the product of both sides' lengths in them (Cauchy-Schwarz), so only
    records that may still reach the ``top``-th best are summed in full, in the order of grams; where many may, all are. No pair is lost.
    """
    names = ["q", "entity_id", "sim"]

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        if not len(q) or not len(r):
            return pa.table([pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.float64())], names=names)
        ids = r["entity_id"].combine_chunks().to_numpy(zero_copy_only=False)
        order = np.array(sorted(range(len(ids)), key=ids.__getitem__, reverse=True))  # ids stand from the largest down
        r, ids = r.take(pa.array(order)), ids[order]
        rc, rw, cut = _flat(r)
        who = np.repeat(np.arange(len(ids)), np.diff(cut))
        gram, inv = np.unique(rc, return_inverse=True)
        by = np.argsort(inv, kind="stable")
        post, v, at = who[by], rw[by], np.searchsorted(inv[by], np.arange(len(gram) + 1))
        common = np.diff(at) > max(COMMON * len(ids), 64)
        rest = np.sqrt(np.bincount(who, np.where(common[inv], rw * rw, 0.0), minlength=len(ids)))  # length of each record in common grams
        k, own_w = min(top, len(ids)), np.zeros(len(gram))
        qc, qw, qcut = _flat(q)
        place = np.searchsorted(gram, qc)
        held = gram[np.minimum(place, len(gram) - 1)] == qc if len(gram) else np.zeros(len(qc), dtype=bool)
        out_q, out_r, out_s = [], [], []

        def summed(own: np.ndarray, ws: np.ndarray) -> np.ndarray:
            if not len(own):
                return np.zeros(len(ids))
            return np.bincount(np.concatenate([post[at[g]:at[g + 1]] for g in own]), np.concatenate([v[at[g]:at[g + 1]] * w for g, w in zip(own, ws)]), minlength=len(ids))
        for n in range(len(q)):
            s = slice(qcut[n], qcut[n + 1])
            own, ws = place[s][held[s]], qw[s][held[s]]
            often = common[own]
            acc, length = summed(own[~often], ws[~often]), float(np.sqrt((ws[often] ** 2).sum()))
            if often.any():
                some = np.flatnonzero(acc)
                least = np.partition(acc[some], len(some) - k)[len(some) - k] - 2e-6 if len(some) >= k else -1.0  # scores are rounded to 6 digits
                may = np.flatnonzero(acc + length * rest >= least)
                if least > 0 and len(may) < len(ids) / 16:
                    own_w[own] = ws
                    size = cut[may + 1] - cut[may]
                    flat = _ramp(cut[may], size)
                    acc = np.zeros(len(ids))
                    acc[may] = np.bincount(np.repeat(np.arange(len(may)), size), own_w[inv[flat]] * rw[flat], minlength=len(may))
                    own_w[own] = 0
                else:
                    acc = summed(own, ws)
            some = np.flatnonzero(acc)
            sim = np.round(acc[some], 6)
            some, sim = some[sim > 0], sim[sim > 0]
            best = np.lexsort((some, -sim))[:k] if len(some) <= 4 * k else _first(some, sim, k)
            chosen, got = some[best], sim[best]
            if len(chosen) < k:
                fill = np.setdiff1d(np.arange(min(len(ids), k + len(some))), some)[:k - len(chosen)]
                chosen, got = np.append(chosen, fill), np.append(got, np.zeros(len(fill)))
            out_q.append(np.full(len(chosen), n))
            out_r.append(chosen)
            out_s.append(got)
        return pa.table([q["q"].combine_chunks().take(pa.array(np.concatenate(out_q))), pa.array(ids[np.concatenate(out_r)], pa.string()), pa.array(np.concatenate(out_s))], names=names)
    return run


def _first(some: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best, smaller number first on ties."""
    least = np.partition(sim, len(sim) - k)[len(sim) - k]
    may = np.flatnonzero(sim >= least)
    return may[np.lexsort((some[may], -sim[may]))[:k]]


def _best_of_texts(top: int, n: int):
    """_best_of_block of names and records that come as texts, beside the grams of all records."""
    best = _best_of_block(top)

    def table(key: str, rows: pa.Table, space: _Space) -> pa.Table:
        own, g, w = space.vectors([t or "" for t in rows["t"].to_pylist()], n)
        cut = pa.array(np.searchsorted(own, np.arange(len(rows) + 1)).astype(np.int32))
        return pa.table({key: rows[key].combine_chunks(), "codes": pa.ListArray.from_arrays(cut, pa.array(g)), "ws": pa.ListArray.from_arrays(cut, pa.array(w))})

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        space, r = _Space(r.filter(r["codes"].is_valid())), r.filter(r["entity_id"].is_valid())
        return best(table("q", q, space), table("entity_id", r, space))
    return run


def _every(k: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(k - 1)))


def _of(c: str, k: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(k)).cast("int")  # of one type on both sides, else equal numbers go to different partitions


def candidates(queries: DataFrame, kb: DataFrame, top: int = 5, n: int = 3) -> DataFrame:
    """(q, entity_id, sim, rank): the ``top`` best records of each distinct query name by cosine, larger id first on ties; records without a common gram (0) fill up. Grams of up to three characters.

    Names are the stated queries against all records, block by block; names and records move as texts and become rows of numbers in their block. A name without a gram of the base is equally far (0) from all records; an empty base gives no rows.
    """
    records = materialise(kb.select("entity_id", _plain("doc").alias("t")).where("t <> ''"), "records")
    counts = materialise(gram_counts(records.select("t"), n), "grams")
    asked = materialise(queries.select("q").where("q IS NOT NULL").distinct(), "queries")
    some = asked.count()
    nq, nr = max(-(-some // QUERY_BLOCK), min(12, some // 1024), 1), -(-records.count() // RECORD_BLOCK) or 1
    qb = asked.select(_of("q", nq).alias("b"), _every(nr).alias("c"), "q", _plain("q").alias("t"))
    rb = _with_grams(records.withColumn("c", _of("entity_id", nr)), counts).select(_every(nq).alias("b"), F.explode(F.when(F.col("c").isNotNull(), F.array("c")).otherwise(F.sequence(F.lit(0), F.lit(nr - 1)))).alias("c"), "entity_id", "t", "codes", "ns")
    best = qb.groupBy("b", "c").cogroup(rb.groupBy("b", "c")).applyInArrow(_best_of_texts(top, n), "q string, entity_id string, sim double")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), F.desc("entity_id")))).where(F.col("rank") <= top)


def _half_up(x: np.ndarray) -> np.ndarray:
    """Six digits, as Spark rounds: a half as written goes up."""
    out, y = np.round(x, 6), x * 1e6
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


def _best_in_documents(n: int):
    """Per document and name the candidate of best 0.65 surface + 0.35 context, where the context is the cosine of the whole document and the record's text.

    A few documents at a time become rows of weights, and only the records asked for are looked up there.
    """
    names = ["doc_id", "q", "entity_id", "kb_name", "kb_type", "score", "rank", "fits"]
    types = [pa.string()] * 5 + [pa.float64(), pa.int32(), pa.bool_()]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asks, texts = left.filter(left["q"].is_valid()).combine_chunks(), left.filter(left["text"].is_valid()).combine_chunks()
        space, rec = _Space(right.filter(right["codes"].is_valid())), right.filter(right["entity_id"].is_valid()).combine_chunks()
        if not len(asks) or not len(rec):
            return pa.table([pa.array([], t) for t in types], names=names)
        own, gram, weight = space.vectors([t or "" for t in rec["t"].to_pylist()], n)
        cut = np.searchsorted(own, np.arange(len(rec) + 1))
        docs = pa.compute.unique(asks["doc_id"])
        found = lambda x, among: pa.compute.fill_null(pa.compute.index_in(x, value_set=among), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        cands = asks["cands"].combine_chunks()
        ask = np.repeat(np.arange(len(asks)), pa.compute.list_value_length(cands).to_numpy(zero_copy_only=False))
        cands = cands.flatten()
        value = lambda c: cands.field(c).to_numpy(zero_copy_only=False)
        doc, which = found(asks["doc_id"], docs)[ask], found(cands.field("entity_id"), rec["entity_id"].combine_chunks())
        pair, at = np.unique(doc * len(rec) + which, return_inverse=True)
        p_doc, p_rec = pair // len(rec), pair % len(rec)
        context = np.zeros(len(pair))
        of = found(texts["doc_id"], docs)
        by = np.argsort(of, kind="stable")
        by = by[of[by] >= 0]
        of = of[by]
        size, wide = np.cumsum(pa.compute.utf8_length(texts["text"]).to_numpy(zero_copy_only=False).astype(np.int64)[by]), max(len(space.code), 1)
        some = max(1, (1 << 22) // wide)
        row, lo = np.zeros(some * wide), 0
        while lo < len(by):
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + CHARS, side="right")))
            hi = min(hi, int(np.searchsorted(of, of[lo] + some)))
            hi = int(np.searchsorted(of, of[hi - 1], side="right"))  # all texts of a document
            d, g, v = space.vectors(texts["text"].take(pa.array(by[lo:hi])).to_pylist(), n, of[lo:hi] - of[lo])
            row[d * wide + g] = v
            part = slice(*np.searchsorted(p_doc, (of[lo], of[hi - 1] + 1)))
            count = cut[p_rec[part] + 1] - cut[p_rec[part]]
            flat = _ramp(cut[p_rec[part]], count)
            context[part] = np.bincount(np.repeat(np.arange(len(count)), count), weight[flat] * row[np.repeat((p_doc[part] - of[lo]) * wide, count) + gram[flat]], minlength=len(count))
            row[d * wide + g] = 0
            lo = hi
        score = _half_up(0.65 * value("surface") + 0.35 * _half_up(context)[at])
        rank = value("rank")
        order = np.lexsort((rank, -score, ask))
        first = order[np.unique(ask[order], return_index=True)[1]]
        pick = pa.array(which[first])
        return pa.table([asks[c].take(pa.array(ask[first])) for c in ("doc_id", "q")] + [rec[c].take(pick) for c in ("entity_id", "kb_name", "kb_type")] + [pa.array(score[first]), pa.array(rank[first].astype(np.int32)), pa.array(value("fits")[first].astype(bool))], schema=pa.schema(list(zip(names, types))))
    return run


def best_in_documents(asked: DataFrame, docs: DataFrame, kb: DataFrame, rows: DataFrame, some: int, n: int = 2) -> DataFrame:
    """(doc_id, q, entity_id, kb_name, kb_type, score, rank, fits) of (doc_id, q, cands): the best of each document's candidates, scored with the whole document (doc_id, text). About ``some`` are asked for.

    Documents, mentions and the records' texts move once, block by block; no row is made for a gram or for a pair of document and record. A document without text has context 0.
    """
    k = kb.select("entity_id", F.concat_ws(" ", "name", "description").alias("doc")).groupBy("entity_id").agg(F.min("doc").alias("doc"))
    k = materialise(k.select("entity_id", _plain("doc").alias("t")), "contexts")
    counts = materialise(gram_counts(k.select("t"), n), "context_grams")
    records = k.join(rows.select("entity_id", F.get("names", F.lit(0)).alias("kb_name"), F.col("type").alias("kb_type")), "entity_id")
    nd, nr = max(-(-some // MENTION_BLOCK), min(12, some // 1024), 1), -(-k.count() // CONTEXT_BLOCK) or 1
    left = asked.select(_of("doc_id", nd).alias("b"), _every(nr).alias("c"), "doc_id", F.lit(None).cast("string").alias("text"), "q", "cands")
    if nr > 1:
        left = left.withColumn("cands", F.filter("cands", lambda x: F.pmod(F.xxhash64(x["entity_id"]), F.lit(nr)) == F.col("c"))).where("size(cands) > 0")
    left = left.unionByName(docs.select(_of("doc_id", nd).alias("b"), _every(nr).alias("c"), "doc_id", _plain("text").alias("text")), allowMissingColumns=True)
    right = _with_grams(records.withColumn("c", _of("entity_id", nr)), counts).select(_every(nd).alias("b"), F.explode(F.when(F.col("c").isNotNull(), F.array("c")).otherwise(F.sequence(F.lit(0), F.lit(nr - 1)))).alias("c"), "entity_id", "t", "kb_name", "kb_type", "codes", "ns")
    best = left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInArrow(_best_in_documents(n), "doc_id string, q string, entity_id string, kb_name string, kb_type string, score double, rank int, fits boolean")
    if nr > 1:
        best = best.groupBy("doc_id", "q").agg(F.max_by(F.struct("entity_id", "kb_name", "kb_type", "score", "rank", "fits"), F.struct("score", -F.col("rank"))).alias("b")).select("doc_id", "q", "b.*")
    return best


def _alike(a: str, names: list[str]) -> float:
    """The best SequenceMatcher ratio; a name that cannot beat the best so far by the characters in common is left out."""
    if a in names:
        return 1.0
    best, held = 0.0, {x: a.count(x) for x in set(a)}
    for b in names:
        if 2 * sum(min(k, b.count(x)) for x, k in held.items()) > best * (len(a) + len(b)):
            best = max(best, SequenceMatcher(None, a, b).ratio())
    return best


def _surface(q: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([_alike(a, list(bs)) for a, bs in zip(q, names)], dtype="float64")


def link(queries: DataFrame, kb: DataFrame, top: int = 5, least: float = 0.45, context: DataFrame | None = None) -> DataFrame:
    """(q, entity_id, score, accepted): candidates reranked by surface similarity, and whether the best one is accepted.

    Accepted: score of at least ``least`` and some spelling equal, or one containing the other with at most one extra
    character, or similar from 0.85 with lengths at most one apart. Only ``top`` pairs a query reach Python.
    score = 0.65 surface + 0.35 context; ``context`` (q, entity_id, context) may be given, else the name cosine stands for it.
    """
    c = candidates(queries, kb, top).join(kb.select("entity_id", "names"), "entity_id")
    c = c.withColumn("context", F.col("sim")) if context is None else c.join(context.select("q", "entity_id", "context"), ["q", "entity_id"], "left").na.fill(0.0, ["context"])
    c = c.withColumn("surface", F.pandas_udf(_surface, T.DoubleType())("q", "names")).withColumn("score", F.round(0.65 * F.col("surface") + 0.35 * F.col("context"), 6))
    one = c.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rank"))).where("r = 1")
    near = F.exists("names", lambda a: (a == F.col("q")) | ((F.contains(F.col("q"), a) | F.contains(a, F.col("q"))) & (F.abs(F.length(a) - F.length("q")) <= 1)))
    alike = (F.col("surface") >= 0.85) & F.exists("names", lambda a: F.abs(F.length(a) - F.length("q")) <= 1)
    return one.select("q", "entity_id", "score", ((F.col("score") >= least) & (near | alike)).alias("accepted"))


def link_mentions(mentions: DataFrame, docs: DataFrame, kb: DataFrame, top: int = 5, least: float = 0.45) -> DataFrame:
    """Every mention (mention_id, mention, entity_type, source_file) with its best record, or none: the linker's output.

    Distinct names look for candidates once; each (document, candidate) pair is scored once against the whole document; a mention takes the
    candidate of best 0.65 surface + 0.35 context. Where that is not accepted the record's columns are null, the type is what the name's shape says, and the score stays. Null and blank mentions,
    mentions whose name has no gram in the base and mentions of unknown documents have score 0 and no record.
    """
    rows = materialise(kb_rows(kb), "records_named")
    q = X.strip(F.col("mention"))
    c = candidates(mentions.select(q.alias("q")).where("q <> ''"), rows, top).join(rows.select("entity_id", "names"), "entity_id")
    near = F.exists("names", lambda a: (a == F.col("q")) | ((F.contains(F.col("q"), a) | F.contains(a, F.col("q"))) & (F.abs(F.length(a) - F.length("q")) <= 1)))
    alike = (F.col("surface") >= 0.85) & F.exists("names", lambda a: F.abs(F.length(a) - F.length("q")) <= 1)
    c = c.withColumn("surface", F.pandas_udf(_surface, T.DoubleType())("q", "names")).select("q", F.struct("entity_id", "rank", "surface", (near | alike).alias("fits")).alias("x"))
    c = materialise(c.groupBy("q").agg(F.collect_list("x").alias("cands")), "surfaces")  # ``top`` of a name
    at = mentions.where("source_file IS NOT NULL").select(F.col("source_file").alias("doc_id"), q.alias("q")).where("q <> ''").repartition("q").distinct()
    d = docs.where("text IS NOT NULL AND source_file IS NOT NULL").select(F.col("source_file").alias("doc_id"), "text")
    best = materialise(best_in_documents(at.join(c, "q"), d, kb, rows, mentions.count()), "linked").withColumnRenamed("doc_id", "source_file")
    m = mentions.select("mention_id", "mention", "entity_type", "source_file", q.alias("q")).repartition("source_file", "q").distinct()
    out = m.join(best, ["source_file", "q"], "left").withColumn("ok", F.coalesce((F.col("score") >= least) & F.col("fits"), F.lit(False)))
    ok = F.col("ok")
    return out.select("mention_id", "mention", F.when(ok, F.coalesce("kb_type", "entity_type")).otherwise(F.coalesce(X.infer_label(F.col("q")), "entity_type")).alias("entity_type"), F.when(ok, F.col("entity_id")).alias("entity_id"), F.when(ok, F.col("kb_name")).alias("kb_name"),
                      "kb_type", F.coalesce("score", F.lit(0.0)).alias("link_score"), F.when(ok, F.col("kb_name")).otherwise(F.col("mention")).alias("normalized_entity"))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Union by key in which the new side wins, then the later row."""
    u = old.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1)))
    return u.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("side"), F.desc(order)))).where("r = 1").drop("r", "side")
