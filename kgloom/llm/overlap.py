"""Problem 1: same or near-same records across splits.

Records are brought to words (an ideograph or a run of other letters and digits is one word) after one
consistent writing: width, case, accents, look-alikes, traditional forms, bracketed note marks and
punctuation do not count. A record is the set of its word n-grams (``WORDS`` words). A gram weighs 1 / (1 + df / (SPREAD q)),
df being the evaluation records that hold it and q the record's own ``QUANTILE`` of df, so phrases far more common
than the rest of a record count little. Containment of a record in another is the weighted share of its grams there.
Two records are the same if each contains ``SAME`` of the other: a typing error breaks five grams, so 0.8 would miss
almost-same records; on the larger check input no pair lies between 0.31 and 0.42.

Evaluation grams are counted in a sketch of fixed size, which is broadcast (``SKETCH`` bytes, whatever the data) and gives df. Then
training and evaluation records are scanned; of each only a prefix is sent on: its grams in the order of (df, hash) until what
remains weighs less than SAME - SLACK. Shared grams beyond the earlier of two such ends weigh less than SAME - SLACK of one of the
records, so a pair to be found shares at least SLACK of one record within both prefixes: nothing is lost. Training grams no evaluation
record holds are never sent. Hits are joined by hash and counted; pairs with enough are compared in full.
Grams held by many evaluation records are salted by the sketch's count, alike on both sides.

Copies of a text form one class; classes are compared, ids only appended. Within a partition only the first copy sends grams.
"""
from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.llm.lookalike import consistent
from kgloom.sources.writers import materialise

WORDS, SAME, SLACK, SPREAD, QUANTILE = 5, 0.36, 0.12, 8.0, 1 / 3
# buckets of the sketch (a byte each when broadcast) and of its chunks; evaluation records of a salted gram that meet in one task
SKETCH, CHUNK, TOGETHER = 1 << 23, 1 << 16, 2000
# Frequent traditional forms and their simplified ones
TRADITIONAL = """於于 後后 記记 員员 設设 誤误 關关 書书 開开 個个 計计 這这 學学 實实 驗验 證证 錄录 觀观 數数 議议 鄰邻 從从 門门 測测 會会 師师 習习 報报 據据 進进 對对 時时 來来 為为 與与 動动
國国 過过 發发 經经 說说 長长 兩两 樣样 點点 體体 間间 機机 種种 應应 內内 無无 現现 電电 論论 題题 業业 頁页 單单 場场 協协 傳传 號号 係系 幾几 問问 聽听 讀读 寫写 畫画 圖图 館馆 園园 庫库 鐵铁 鐘钟 錶表 紙纸
線线 紅红 練练 組组 織织 細细 終终 結结 給给 統统 絕绝 續续 維维 綱纲 網网 總总 緣缘 編编 緊紧 縮缩 績绩 繪绘 約约 級级 純纯 術术 裝装 製制 複复 見见 規规 視视 親亲 覺觉 訂订 訊讯 討讨 訓训 託托 訪访 許许 評评 詞词
試试 詩诗 話话 該该 詳详 認认 語语 誠诚 請请 課课 調调 談谈 謀谋 講讲 謝谢 識识 譯译 護护 變变 讓让 貝贝 負负 財财 責责 貨货 質质 購购 費费 資资 賽赛 賴赖 軍军 軌轨 軟软 較较 載载 輕轻 輪轮 輯辑 輸输 轉转 辦办 農农 連连 運运
達达 遠远 適适 選选 遷迁 還还 邊边 醫医 釋释 針针 鋼钢 錯错 鏡镜 閉闭 閱阅 陽阳 陸陆 陳陈 際际 隨随 險险 雖虽 雙双 雜杂 離离 難难 雲云 靜静 響响 項项 順顺 預预 頭头 頻频 顆颗 類类 顯显 風风 飛飞 養养 馬马 驚惊 黃黄 齒齿 龍龙"""
_SIMPLE = {ord(p[0]): p[1] for p in TRADITIONAL.split()}
_OLD = re.compile("[" + "".join(map(chr, _SIMPLE)) + "]")
_MARKS = re.compile("[\u0300-\u036f\u0483-\u0487\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")  # marks over letters
_FAR = re.compile("[\u0591-\u1aaf\u1b00-\u1dbf\ua640-\uabff\U00010000-\U0001efff]")  # scripts with marks of their own
_NOTE = re.compile(r"\[\s*\d+\s*\]|【[^】]{0,12}】")
_WORDS = re.compile(r"[㐀-䶿一-鿿]|(?:(?![㐀-䶿一-鿿])[^\W_])+")


def words(text: str | None) -> str:
    """The record's words in one writing, parted by spaces; "" for null, empty and letterless texts."""
    if not text:
        return ""
    t = _NOTE.sub(" ", consistent(text)).casefold()
    if not t.isascii():
        t = _MARKS.sub("", unicodedata.normalize("NFD", t))
        if _FAR.search(t):
            t = "".join(c for c in t if not unicodedata.combining(c))
        if _OLD.search(t):
            t = t.translate(_SIMPLE)
    return " ".join(_WORDS.findall(t))


_CODE: dict[str, int] = {}
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "little")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.int64) % buckets


def grams(tasks: list[str], texts: list[str], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash), sorted by both: the distinct word n-grams of texts of words parted by spaces; hashes differ by task. A text of fewer words is one gram."""
    if len(_CODE) > 1 << 20:
        _CODE.clear()
    codes, sizes = [], []
    for t in texts:
        ws = t.split(" ")
        for w in ws:
            c = _CODE.get(w)
            if c is None:
                c = _CODE[w] = _hash(w)
            codes.append(c)
        for _ in range(n - len(ws)):
            codes.append(0)
        sizes.append(max(len(ws), n))
    c, sizes = np.array(codes, dtype=np.uint64), np.array(sizes, dtype=np.int64)
    if not len(c):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    own = np.repeat(np.arange(len(texts)), sizes)
    h = np.zeros(len(c) - n + 1, dtype=np.uint64)
    for k in range(n):
        h += _mixed(c[k:len(c) - n + 1 + k]) * _MULTIPLIERS[k % len(_MULTIPLIERS)]
    inside = own[:len(h)] == own[n - 1:]
    own, h = own[:len(h)][inside], h[inside]
    salt = np.array([_hash(t) for t in tasks], dtype=np.uint64)
    h = _mixed(h + salt[own])
    at = np.lexsort((h, own))
    own, h = own[at], h[at]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (h[1:] != h[:-1])
    return own[new], h[new]


def weighed(own: np.ndarray, h: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(df, weight, at): of each gram the evaluation records that hold it, its share of its record's weight, and the order (record, df, hash)."""
    byte = sketch[_bucket(h, len(sketch))]
    df = np.where(byte > 0, np.exp2((byte.astype(np.float64) - 1) / 8), 0)
    at = np.lexsort((h, df, own))
    first = np.searchsorted(own, np.arange(own[-1] + 2)) if len(own) else np.zeros(1, np.int64)
    sizes = np.diff(first)
    q = np.maximum(df[at][np.minimum(first[:-1] + ((sizes - 1) * QUANTILE).astype(np.int64), len(own) - 1)], 1) if len(own) else np.empty(0)
    w = 1 / (1 + np.maximum(df, 1) / (SPREAD * q[own]))
    return df, w / np.bincount(own, w)[own], at


def prefix(own: np.ndarray, h: np.ndarray, sketch: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, weight, df) of the grams of each record until what remains weighs less than ``least``."""
    df, w, at = weighed(own, h, sketch)
    before = np.cumsum(w[at]) - w[at]
    if not len(at):
        return at, w, df
    start = np.searchsorted(own, own[at], side="left")  # the order keeps records together, so a record's places are those of its grams
    done = before - before[start]
    keep = at[1 - done >= least - 1e-9]
    return keep, w[keep], df[keep]


def in_words(records: DataFrame) -> DataFrame:
    """(side, task, id, cls, w) of (side, task, id, text), written once to the shared folder. Of the copies of a partition only the first carries its words; texts without words are left out."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set = set()
        for p in parts:
            out = []
            for side, task, i, text in zip(p["side"], p["task"], p["id"], p["text"]):
                w = words(text)
                if w:
                    cls = _hash(task + "\t" + w) - (1 << 63)
                    out.append((side, task, i, cls, None if (side, cls) in seen else w))
                    seen.add((side, cls))
            yield pd.DataFrame(out, columns=["side", "task", "id", "cls", "w"])
    r = records.where("text IS NOT NULL AND task IS NOT NULL AND id IS NOT NULL")
    return materialise(r.mapInPandas(run, "side string, task string, id bigint, cls bigint, w string"), "words")


def gram_sketch(evals: DataFrame, buckets: int = SKETCH, chunk: int = CHUNK) -> np.ndarray:
    """How many records of (task, w) hold the grams of each bucket, as bytes of 8 log2 + 1 (0: none). Its size is fixed, so it may be collected and broadcast."""
    chunk = min(chunk, buckets)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = np.zeros(buckets, dtype=np.uint32)
        for p in parts:
            _, h = grams(list(p["task"]), list(p["w"]))
            np.add.at(count, _bucket(h, buckets), 1)
        rows = [(k, zlib.compress(c.tobytes(), 1)) for k, c in enumerate(count.reshape(-1, chunk)) if c.any()]
        yield pd.DataFrame(rows, columns=["chunk", "counts"])

    def add(p: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(chunk, dtype=np.uint64)
        for c in p["counts"]:
            total += np.frombuffer(zlib.decompress(c), dtype=np.uint32)
        byte = np.where(total > 0, np.minimum(np.round(8 * np.log2(np.maximum(total, 1))) + 1, 255), 0).astype(np.uint8)
        return pd.DataFrame({"chunk": [int(p["chunk"].iloc[0])], "bytes": [byte.tobytes()]})
    sketch = np.zeros(buckets, dtype=np.uint8)
    for r in evals.mapInPandas(run, "chunk int, counts binary").groupBy("chunk").applyInPandas(add, "chunk int, bytes binary").toLocalIterator():
        sketch[r.chunk * chunk:(r.chunk + 1) * chunk] = np.frombuffer(r.bytes, dtype=np.uint8)
    return sketch


def prefix_grams(records: DataFrame, sketch, train: bool, same: float, slack: float, together: int = TOGETHER) -> DataFrame:
    """(h, salt, cls, share): prefix grams of (task, cls, w). Grams of ``train`` that no evaluation record holds are left out; those of many stand once a salt."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            p = b.to_pandas()
            own, h = grams(list(p["task"]), list(p["w"]))
            at, w, df = prefix(own, h, sketch.value, same - slack)
            cls, salts = p["cls"].to_numpy()[own[at]], np.maximum(np.ceil(df / together), 1).astype(np.int64)
            h = h[at].view(np.int64)
            if train:
                here = df > 0
                h, cls, w, salts = h[here], cls[here], w[here], salts[here]
                times = np.repeat(np.arange(len(h)), salts)
                salt = np.arange(len(times)) - np.repeat(np.cumsum(salts) - salts, salts)
                h, cls, w = h[times], cls[times], w[times]
            else:
                salt = cls % salts
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(salt.astype(np.int32), pa.int32()), pa.array(cls, pa.int64()), pa.array(w.astype(np.float32), pa.float32())], ["h", "salt", "cls", "share"])
    return records.mapInArrow(run, "h bigint, salt int, cls bigint, share float")


def overlaps(train: DataFrame, evals: DataFrame, same: float = SAME, slack: float = SLACK, buckets: int = SKETCH, together: int = TOGETHER) -> DataFrame:
    """(task, train_id, eval_id, containment): all cross-split overlaps.

    ``train`` (task, sample_id, text), ``evals`` likewise; further columns are not looked at. Repeated
    rows count once. ``containment`` is the weighted share of the evaluation record's grams in the training record. Null
    tasks, ids and texts and texts without words give nothing; empty tables give no rows.
    """
    spark = train.sparkSession
    rows = lambda d, side: d.select(F.lit(side).alias("side"), "task", F.col("sample_id").cast("bigint").alias("id"), "text").distinct()
    w = in_words(rows(train, "train").unionByName(rows(evals, "eval")))
    tw, ew = (w.where((F.col("side") == side) & F.col("w").isNotNull()).select("task", "cls", "w") for side in ("train", "eval"))
    sketch = spark.sparkContext.broadcast(gram_sketch(ew.select("task", "w"), buckets))
    t = prefix_grams(tw, sketch, True, same, slack, together).select("h", "salt", F.col("cls").alias("t"), F.col("share").alias("ts"))
    e = prefix_grams(ew, sketch, False, same, slack, together).select("h", "salt", F.col("cls").alias("e"), F.col("share").alias("es"))
    # one hash partitioning serves both the copies of other partitions and the join; neither side is small
    t, e = (x.repartition("h", "salt").dropDuplicates(["h", "salt", c]) for x, c in ((t, "t"), (e, "e")))
    hits = t.hint("merge").join(e, ["h", "salt"]).groupBy("t", "e").agg(F.sum("ts").alias("ts"), F.sum("es").alias("es"))
    near = materialise(hits.where(F.greatest("ts", "es") >= slack - 1e-4).select("t", "e"), "near")

    def both(task: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        n = len(a)
        own, h = grams([*task, *task], [*a, *b])
        _, share, _ = weighed(own, h, sketch.value)
        at = np.searchsorted(own, np.arange(2 * n + 1))
        out = []
        for i in range(n):
            x, y = slice(at[i], at[i + 1]), slice(at[n + i], at[n + i + 1])
            _, p, q = np.intersect1d(h[x], h[y], assume_unique=True, return_indices=True)
            out.append((share[x][p].sum(), share[y][q].sum()))
        return pd.DataFrame(out, columns=["of_train", "of_eval"])
    both_ways = F.pandas_udf(both, T.StructType([T.StructField("of_train", T.DoubleType()), T.StructField("of_eval", T.DoubleType())]))
    ta = tw.join(near.select(F.col("t").alias("cls")).distinct(), "cls", "left_semi").dropDuplicates(["cls"]).select("task", F.col("cls").alias("t"), F.col("w").alias("wa"))
    ea = ew.join(near.select(F.col("e").alias("cls")).distinct(), "cls", "left_semi").dropDuplicates(["cls"]).select(F.col("cls").alias("e"), F.col("w").alias("wb"))
    c = near.join(ta, "t").join(ea, "e").withColumn("c", both_ways("task", "wa", "wb"))
    c = materialise(c.where((F.col("c.of_train") >= same) & (F.col("c.of_eval") >= same)).select("task", "t", "e", F.col("c.of_eval").alias("containment")), "pairs")
    tm, em = (w.where(F.col("side") == side).select(F.col("cls").alias(k), F.col("id").alias(f"{side}_id")) for side, k in (("train", "t"), ("eval", "e")))
    return c.join(tm, "t").join(em, "e").select("task", "train_id", "eval_id", "containment")


def split_overlaps(ner: DataFrame, re_: DataFrame, evals: DataFrame) -> DataFrame:
    t = ner.select(F.lit("ner").alias("task"), "sample_id", "text").unionByName(re_.select(F.lit("re").alias("task"), "sample_id", "text"))
    return overlaps(t, evals.select("task", "sample_id", "text"))


def report(found: DataFrame, evals: DataFrame) -> DataFrame:
    """Per task, split and source (null source kept): evaluation records, those that recur, and pairs."""
    per = found.groupBy("task", F.col("eval_id").alias("sample_id")).agg(F.count("*").alias("k"))
    e = evals.select("task", "split", "source", "sample_id").distinct().join(per, ["task", "sample_id"], "left")
    return e.groupBy("task", "split", "source").agg(F.count("*").alias("n_records"), F.count("k").alias("n_overlapping"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_pairs"))
