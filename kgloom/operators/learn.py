"""Learned operators: a relation classifier over marked texts, and a character tagger with Viterbi decoding."""
from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.functions.text import bio_tags, mark_entities
from kgloom.operators.link import _piece
from kgloom.sources.writers import materialise


def _grams() -> Column:
    per = [F.transform(F.sequence(F.lit(1), F.greatest(F.length("t") - (k - 1), F.lit(1))), _piece("t", k)) for k in (1, 2, 3)]
    return F.array_compact(F.concat(*per))


def marked(re_rows: DataFrame) -> DataFrame:
    """(sample_id, label, grams): character 1- to 3-grams of the text with its ends marked; rows without text or ends drop."""
    t = re_rows.where("text IS NOT NULL AND head IS NOT NULL AND tail IS NOT NULL").select("sample_id", "label", F.lower(mark_entities(F.col("text"), F.col("head"), F.col("tail"))).alias("t")).distinct()
    return t.select("sample_id", "label", _grams().alias("grams"))


def fit_relations(train: DataFrame, features: int = 1 << 14) -> PipelineModel:
    """Hashed gram counts weighted by inverse document frequency and a class-weighted multinomial logistic regression, fitted on all labelled rows. The model can be saved and loaded by path."""
    fit = train.where("label IS NOT NULL").repartition(4 * train.sparkSession.sparkContext.defaultParallelism, "sample_id")  # texts are small, their grams are not
    tf = HashingTF(inputCol="grams", outputCol="c", numFeatures=features)
    fit = materialise(tf.transform(marked(fit)).select("label", "c"), "features")  # each text is cut into grams once, not in every pass
    n = fit.groupBy("label").agg(F.count("*").alias("n"))
    total = fit.count()
    fit = fit.join(F.broadcast(n), "label").withColumn("weight", F.lit(float(total)) / F.col("n"))  # n: one row per label
    out = [StringIndexer(inputCol="label", outputCol="y", handleInvalid="keep").fit(fit), tf, IDF(inputCol="c", outputCol="f").fit(fit), Normalizer(inputCol="f", outputCol="x")]
    ready = out[3].transform(out[2].transform(out[0].transform(fit))).select("y", "x", "weight")
    return PipelineModel([*out, LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", maxIter=40, regParam=0.0001, standardization=False).fit(ready)])


def _predicted(model: PipelineModel, df: DataFrame) -> DataFrame:
    labels = F.array(*[F.lit(x) for x in model.stages[0].labels])
    p = model.transform(df)
    return p.withColumn("pred", F.coalesce(F.get(labels, F.col("prediction").cast("int")), F.lit("NO_REL"))).withColumn("score", F.round(F.array_max(vector_to_array("probability")), 6))


def relation_classifier(train: DataFrame, rows: DataFrame, features: int = 1 << 14) -> DataFrame:
    """(sample_id, gold, pred, score) of ``rows``."""
    return _predicted(fit_relations(train, features), marked(rows)).select("sample_id", F.col("label").alias("gold"), "pred", "score")


def _murmur3(words: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """MurmurHash3 (32 bits, seed 42) of stretches of up to 15 bytes, as HashingTF has it; ``words`` are the four bytes from each place on."""
    u = np.uint32
    turn = lambda x, r: (x << u(r)) | (x >> u(32 - r))
    mixed = lambda k: turn(k * u(0xCC9E2D51), 15) * u(0x1B873593)
    h, full = np.full(len(at), 42, dtype=u), size >> 2
    for j in range(int(full.max(initial=0))):
        h = np.where(full > j, turn(h ^ mixed(words[at + 4 * j]), 13) * u(5) + u(0xE6546B64), h)
    h ^= mixed(words[at + 4 * full] & ((u(1) << (8 * (size & 3)).astype(u)) - u(1)))
    h ^= size.astype(u)
    h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
    h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
    return h ^ (h >> u(16))


def _buckets(texts: list[str], features: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every 1- to 3-gram of the texts, as _grams and HashingTF have them."""
    raw = np.frombuffer("".join(texts).encode() + bytes(16), dtype=np.uint8)
    first = np.flatnonzero((raw[:-16] & 0xC0) != 0x80)  # where characters begin
    off = np.append(first, len(raw) - 16)
    words = sum(raw[j:len(raw) - 3 + j].astype(np.uint32) << np.uint32(8 * j) for j in range(4))
    n = np.array([len(t) for t in texts], dtype=np.int64)
    row = np.repeat(np.arange(len(texts)), n)
    room = np.repeat(np.cumsum(n), n) - np.arange(len(row))
    out = []
    for k in (1, 2, 3):
        i = np.flatnonzero(room >= k)
        h = _murmur3(words, off[i], off[i + k] - off[i]).view(np.int32).astype(np.int64)
        out.append((row[i], np.mod(h, features)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _scores(texts: list[str], idf: np.ndarray, coef: np.ndarray, intercept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and its probability for each text: hashed counts times inverse document frequency, scaled to length 1, a linear score per class."""
    row, bucket = _buckets(texts, len(idf))
    key, c = np.unique(row * len(idf) + bucket, return_counts=True)
    row, bucket = key // len(idf), key % len(idf)
    w = c * idf[bucket]
    norm = np.sqrt(np.bincount(row, w * w, minlength=len(texts)))
    norm[norm == 0] = 1
    m = np.stack([np.bincount(row, w * k[bucket], minlength=len(texts)) / norm + b for k, b in zip(coef, intercept)])
    e = np.exp(m - m.max(axis=0))
    return m.argmax(axis=0), e.max(axis=0) / e.sum(axis=0)


def predict(texts: DataFrame, model: PipelineModel, col: str) -> DataFrame:
    """``texts`` with pred and score, as the pipeline gives them; grams are counted in Arrow batches, no row holds them. A null text is NO_REL."""
    labels, lr = list(model.stages[0].labels), model.stages[4]
    coef, intercept = lr.coefficientMatrix.toArray(), lr.interceptVector.toArray()
    if len(coef) == 1:  # of two classes only the second has a row
        coef, intercept = np.vstack([0 * coef, coef]), np.append(0.0, intercept)
    held = texts.sparkSession.sparkContext.broadcast((model.stages[2].idf.toArray(), coef, intercept))  # features x classes

    def run(t: pd.Series) -> pd.DataFrame:
        pred, score = ["NO_REL"] * len(t), np.full(len(t), np.nan)
        some = np.flatnonzero(t.notna().to_numpy())
        for lo in range(0, len(some), 512):
            part = some[lo:lo + 512]
            k, p = _scores([t.iat[i] for i in part], *held.value)
            score[part] = p
            for i, c in zip(part, k):
                pred[i] = labels[c] if c < len(labels) else "NO_REL"
        return pd.DataFrame({"pred": pred, "score": score})
    p = F.pandas_udf(run, "pred string, score double")(F.col(col))
    return texts.withColumn("p", p).select(*texts.columns, F.col("p.pred").alias("pred"), F.round("p.score", 6).alias("score"))


def pair_relations(pairs: DataFrame, model: PipelineModel) -> DataFrame:
    """Relations the classifier sees between pairs (source_file, sent_idx, text, head, tail); NO_REL drops, the best of each pair of ends and relation in a sentence stays."""
    t = pairs.select("source_file", "sent_idx", "head", "tail", F.lower(mark_entities(F.col("text"), F.col("head"), F.col("tail"))).alias("t"))
    # written before it is filtered, else the model would score a row once for the filter and again for the result
    p = materialise(predict(t, model, "t").select("source_file", "sent_idx", F.struct("head.eid", "head.name").alias("head"), F.struct("tail.eid", "tail.name").alias("tail"), "pred", "score"), "predicted").where("pred <> 'NO_REL'")
    return p.groupBy("source_file", "sent_idx", F.concat(F.lit("R_"), "pred").alias("relation_id"), F.col("head.eid").alias("head_id"), F.col("tail.eid").alias("tail_id")).agg(
        F.max("score").alias("confidence"), F.max_by(F.col("head.name"), "score").alias("head"), F.max_by(F.col("tail.name"), "score").alias("tail"), F.lit("classifier").alias("source"))


def _feats(text: str, i: int) -> list[str]:
    c = lambda j: text[j] if 0 <= j < len(text) else "^"
    a, b, x, y, z = c(i - 2), c(i - 1), c(i), c(i + 1), c(i + 2)
    kind = "d" if x.isdigit() else "u" if x.isupper() else "l" if x.isascii() and x.isalpha() else "h" if x >= "一" else "o"
    return ["0" + x, "1" + b, "2" + y, "3" + a + b, "4" + b + x, "5" + x + y, "6" + y + z, "k" + kind, "7" + b + x + y]


def _viterbi(text: str, w: dict, tags: list[str]) -> list[str]:
    if not text:
        return []
    back, score = [], {t: 0.0 for t in tags}
    for i in range(len(text)):
        fs = _feats(text, i)
        emit = {t: sum(w.get((f, t), 0.0) for f in fs) for t in tags}
        new, ptr = {}, {}
        for t in tags:
            ok = [p for p in tags if not t.startswith("I-") or (i > 0 and p[2:] == t[2:] and p != "O")]
            if not ok:
                new[t], ptr[t] = -1e9, tags[0]
                continue
            p = max(ok, key=lambda q: score[q] + w.get((q, t), 0.0)) if i else ok[0]
            new[t], ptr[t] = (score[p] + w.get((p, t), 0.0) if i else 0.0) + emit[t], p
        score, _ = new, back.append(ptr)
    t = max(score, key=score.get)
    out = [t]
    for ptr in reversed(back[1:]):
        t = ptr[t]
        out.append(t)
    return out[::-1]


def fit_tagger(samples: DataFrame, rows: int = 300, epochs: int = 3) -> dict:
    """Averaged structured perceptron over character features, fitted on the driver on at most ``rows`` labelled samples."""
    fit = samples.where("text IS NOT NULL AND entities IS NOT NULL").select("sample_id", "text", bio_tags(F.col("text"), F.col("entities")).alias("tags")).distinct().orderBy(F.xxhash64("sample_id"), "sample_id").limit(rows).collect()
    tags = sorted({t for r in fit for t in r.tags} | {"O"})
    w, total, step = defaultdict(float), defaultdict(float), 1
    for _ in range(epochs):
        for r in fit:
            got = _viterbi(r.text, w, tags)
            for i, (g, t) in enumerate(zip(got, r.tags)):
                if g != t or (i and got[i - 1] != r.tags[i - 1]):
                    ups = [((f, t), 1.0) for f in _feats(r.text, i)] + [((f, g), -1.0) for f in _feats(r.text, i)]
                    ups += [((r.tags[i - 1], t), 1.0), ((got[i - 1], g), -1.0)] if i else []
                    for k, d in ups:
                        w[k] += d
                        total[k] += step * d
            step += 1
    return {"tags": tags, "w": {k: v - total[k] / step for k, v in w.items() if v - total[k] / step}}


def tag(samples: DataFrame, model: dict) -> DataFrame:
    """(sample_id, start, end, label) by Viterbi decoding, one Arrow batch at a time; null and empty texts give none."""
    b = samples.sparkSession.sparkContext.broadcast(model)  # bounded by the fitted sample

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([_viterbi(t, b.value["w"], b.value["tags"]) if isinstance(t, str) else [] for t in texts])

    t = samples.where("text IS NOT NULL").select("sample_id", "text").distinct().select("sample_id", F.posexplode(F.pandas_udf(run, T.ArrayType(T.StringType()))("text")).alias("i", "tag"))
    from kgloom.operators.evaluate import decode_bio
    return decode_bio(t)
