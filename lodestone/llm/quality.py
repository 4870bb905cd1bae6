"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model's unit is the character (n-grams of ``ORDER`` symbols): words of open vocabularies are mostly unseen, their
letters are not. An n-gram is one long, 16 bits a symbol.

* Counts: every trusted document is read; each task adds up its n-grams in sorted arrays, and Spark sums them by code.
  Lower orders are continuation counts, a group of the order above. Discounts D1, D2, D3+ come from the counts of
  counts of each order.
* Scoring by sharded count joins: each input split asks once for each distinct n-gram that its texts hold. The requests
  meet the counts, sharded by code, order by order, and go back as a table of log probabilities for each split,
  which the task that reads that split loads. Texts are never shuffled for this, and no task holds the whole model.
* Folds: a hash of its id gives each document one of FOLDS folds, and its perplexity comes from the counts of the
  trusted documents of the other folds, for a model flatters the texts that it was made from. All folds' models are
  made from one count, less the fold's own share, and go through the same joins.
* Thresholds: quantiles of all trusted documents' perplexity in each language, on both sides, as junk such as endless
  repetition can also be too easy to predict. A far quantile of a few hundred documents is one odd document, so it is
  fitted: log perplexity has a centre (median) and a spread on either side (to the 5 % and 95 % quantiles) of its
  language, and the quantiles of the deviations in spreads come from all languages together. Centre and spreads are
  shrunk towards those over all languages by the weight n / (n + ``prior``) of the language's own n trusted documents;
  no size switches anything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import StageTables, bare_scan, fresh_path

ORDER, BITS = 4, 16
BOS, EOS, SYMBOLS = 0xFFFF, 0xFFFE, 0x10000
#: The share of trusted documents that a language's upper and lower thresholds leave outside.
UPPER_TAIL, LOWER_TAIL, FOLDS = 0.004, 0.001, 5
#: The trusted documents of a language that weigh as much as all languages do.
PRIOR, SHAPE = 20, ("__centre", "__down", "__up")
#: Characters that one step works on, and distinct n-grams that a task holds before it passes them on.
STEP_CHARS, HELD_GRAMS = 2_000_000, 1_000_000
_START, _STOP = chr(0x10FFFF), chr(0x10FFFE)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, list[str]]]:
    """Slices of a batch's texts with about STEP_CHARS in each: (batch, first row, texts)."""
    for batch in batches:
        n, at = batch.num_rows, 0
        each = max(1, min(8192, n * STEP_CHARS // max(1, batch.column(column).nbytes)))
        while at < n:
            yield batch, at, [(t or "").replace(_START, "�").replace(_STOP, "�") for t in batch.column(column).slice(at, each).to_pylist()]
            at += each


def codes(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram code that ends at each character and at each text's end, and the number of them for each text.

    Symbols are the code points of the basic plane. Those beyond it share the 2,048 places that no character has there,
    32 neighbours to a place.
    """
    sizes = np.array([len(t) + 1 for t in texts])
    pad = _START * (order - 1)
    raw = np.frombuffer("".join(f"{pad}{t}{_STOP}" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    high = raw >= EOS
    if high.any():
        folded = 0xD800 + (raw[high] >> 5) % 2048
        folded[raw[high] == 0x10FFFF] = BOS
        folded[raw[high] == 0x10FFFE] = EOS
        raw[high] = folded
    out = raw[order - 1 :].copy()
    for k in range(1, order):
        out |= raw[order - 1 - k : len(raw) - k] << (BITS * k)
    return out[raw[order - 1 :] != BOS], sizes


def _count_batches(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        pack = lambda f: pa.RecordBatch.from_arrays([pa.array(np.full(len(held[f][0]), f, np.int32)), *map(pa.array, held[f])], ["fold", "code", "c"])
        for batch, at, texts in _texts(batches, 0):
            folds = batch.column(1).slice(at, len(texts)).to_numpy()
            for fold in np.unique(folds).tolist():
                grams, n = np.unique(codes([t for t, f in zip(texts, folds) if f == fold], order)[0], return_counts=True)
                had, counts = held.get(fold, (none, none))
                both, place = np.unique(np.concatenate([had, grams]), return_inverse=True)
                held[fold] = both, np.bincount(place, weights=np.concatenate([counts, n]), minlength=len(both)).astype(np.int64)
            if sum(len(h[0]) for h in held.values()) > HELD_GRAMS:
                for fold in list(held):
                    yield pack(fold)
                held.clear()
        for fold in list(held):
            yield pack(fold)

    return run


def _request_batches(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        pack = lambda chunk: pa.RecordBatch.from_arrays([pa.array(np.full(len(held[chunk]), chunk[0])), pa.array(np.full(len(held[chunk]), chunk[1], np.int32)), pa.array(held[chunk])], ["chunk", "fold", "code"])
        for batch, at, texts in _texts(batches, 0):
            chunks = list(zip(batch.column(1).slice(at, len(texts)).to_pylist(), batch.column(2).slice(at, len(texts)).to_pylist()))
            for chunk in dict.fromkeys(chunks):
                grams = np.unique(codes([t for t, c in zip(texts, chunks) if c == chunk], order)[0])
                held[chunk] = np.union1d(held[chunk], grams) if chunk in held else grams
            if sum(map(len, held.values())) > HELD_GRAMS:
                for chunk in list(held):
                    yield pack(chunk)
                held.clear()
        for chunk in list(held):
            yield pack(chunk)

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2 and D3+ of modified Kneser-Ney; customary values where counts of counts are missing."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.0), k + 1.0) for k, x in enumerate(d))


class Model:
    """Counts ``levels[n](fold, code, c)`` and contexts ``contexts[n](fold, context, total, gamma)`` for each order.

    ``discount[n]`` has D1, D2 and D3+ for each fold. With ``fold_col``, numbers under ``folds``, a fold's model leaves
    that fold's documents out; without it there is one model, of all documents, in fold 0.
    """

    def __init__(self, trusted: DataFrame, text_col: str, tables: StageTables, order: int = ORDER, fold_col: str | None = None, folds: int = FOLDS):
        self.order, self.levels, self.contexts, self.discount = order, {}, {}, {}
        fold = (F.lit(0) if fold_col is None else F.col(fold_col)).cast("int")
        raw = trusted.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), fold.alias("fold")).mapInArrow(_count_batches(order), "fold int, code long, c long")
        if fold_col is None:
            folds, table = 1, raw.groupBy("fold", "code").agg(F.sum("c").alias("c"))
        else:
            whole = raw.groupBy("code").agg(F.sum("c").alias("c"), *[F.sum(F.when(F.col("fold") == k, F.col("c")).otherwise(0)).alias(f"c{k}") for k in range(folds)])
            others = F.explode(F.array(*[F.struct(F.lit(k).alias("fold"), (F.col("c") - F.col(f"c{k}")).alias("c")) for k in range(folds)]))
            table = whole.select("code", others.alias("x")).select("x.fold", "code", "x.c").filter("c > 0")
        for n in range(order, 0, -1):
            table = self.levels[n] = tables.keep(table, f"kn-counts{n}")
            if n == order:
                tables.rest()  # the trusted texts were shuffled for it
            rows = {r[0]: r[1:] for r in table.groupBy("fold").agg(*[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)]).collect()}
            self.discount[n] = [discounts(*rows.get(k, (0, 0, 0, 0))) for k in range(folds)]
            d1, d2, d3 = self._cuts(n)
            context = F.shiftrightunsigned("code", BITS)
            seen = table.groupBy("fold", context.alias("context")).agg(
                F.sum("c").alias("total"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"), F.count_if(F.col("c") > 2).alias("n3")
            )
            gamma = (d1 * F.col("n1") + d2 * F.col("n2") + d3 * F.col("n3")) / F.col("total")
            self.contexts[n] = tables.keep(seen.select("fold", "context", "total", gamma.alias("gamma")), f"kn-contexts{n}")
            table = table.groupBy("fold", F.col("code").bitwiseAND(F.lit((1 << BITS * (n - 1)) - 1)).alias("code")).agg(F.count("*").alias("c"))

    def _cuts(self, n: int) -> list:
        """D1, D2 and D3+ of order ``n`` as Columns over ``fold``."""
        return [F.element_at(F.array(*[F.lit(float(d[k])) for d in self.discount[n]]), F.col("fold") + 1) for k in range(3)]

    def score(self, grams: DataFrame, tables: StageTables) -> DataFrame:
        """``(fold, code, p)`` for each of the distinct n-grams ``grams(fold, code)``, seen or not.

        The suffixes that they need are gathered order by order, then scored from single symbols up. Keys of a join
        have at most SYMBOLS rows, as only one symbol of a code differs.
        """
        wanted = {self.order: grams}
        for n in range(self.order - 1, 0, -1):
            wanted[n] = wanted[n + 1].select("fold", F.col("code").bitwiseAND(F.lit((1 << BITS * n) - 1)).alias("code")).distinct()
        low = None
        for n in range(1, self.order + 1):
            d1, d2, d3 = self._cuts(n)
            c = F.coalesce(F.col("c"), F.lit(0))
            cut = F.when(c == 0, 0.0).when(c == 1, d1).when(c == 2, d2).otherwise(d3)
            rows = wanted[n].join(self.levels[n], ["fold", "code"], "left").withColumn("context", F.shiftrightunsigned("code", BITS))
            rows = rows.join(self.contexts[n], ["fold", "context"], "left")
            if low is None:
                rows = rows.withColumn("lower", F.lit(1.0 / SYMBOLS))
            else:
                rows = rows.withColumn("suffix", F.col("code").bitwiseAND(F.lit((1 << BITS * (n - 1)) - 1))).join(low.select("fold", F.col("code").alias("suffix"), F.col("p").alias("lower")), ["fold", "suffix"])
            p = F.when(F.col("total").isNull(), F.col("lower")).otherwise(F.greatest(c - cut, F.lit(0.0)) / F.col("total") + F.col("gamma") * F.col("lower"))
            low = tables.keep(rows.select("fold", "code", p.alias("p")), f"kn-scores{n}")
        return low


def perplexities(docs: DataFrame, model: Model, text_col: str, tables: StageTables, fold: Column | None = None, with_text: bool = True) -> DataFrame:
    """``docs`` with ``perplexity``: exp of the mean negative log probability over characters and the text's end.

    ``fold`` is the number of the model that judges a row, 0 by default. Without ``with_text`` the texts are left out.
    """
    spark, order = docs.sparkSession, model.order
    fold = (F.lit(0) if fold is None else fold).cast("int")
    docs = docs.drop("perplexity", "__chunk", "__fold").withColumns({"__chunk": F.xxhash64(F.input_file_name(), F.input_file_block_start(), F.input_file_block_length()), "__fold": fold})
    asked = docs.select(F.coalesce(F.col(text_col), F.lit("")), "__chunk", "__fold").mapInArrow(_request_batches(order), "chunk long, fold int, code long").distinct()
    asked = tables.keep(asked, "kn-requests")
    scored = model.score(asked.select("fold", "code").distinct(), tables)
    answers = fresh_path(spark, "kn-answers")
    answered = asked.join(scored, ["fold", "code"]).select("chunk", "fold", "code", F.log("p").cast("float").alias("logp"))
    answered.repartition("chunk").write.partitionBy("chunk").parquet(answers)
    tables.written.append(answers)
    tables.drop(asked)
    tables.rest()
    out_of = {"__chunk", "__fold"} | (set() if with_text else {text_col})
    stays = [k for k, c in enumerate(docs.columns) if c not in out_of]
    names = [docs.columns[k] for k in stays]
    place, chunk_at, fold_at = (docs.columns.index(c) for c in (text_col, "__chunk", "__fold"))

    def load(chunk: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        system, root = fs.FileSystem.from_uri(answers)
        table = pads.dataset(f"{root}/chunk={chunk}", filesystem=system, format="parquet").to_table(columns=["fold", "code", "logp"])
        folds, keys, logs = (table[c].to_numpy() for c in ("fold", "code", "logp"))
        by = np.lexsort((keys, folds))
        folds, keys, logs = folds[by], keys[by], logs[by]
        return {f: (keys[a:b], logs[a:b]) for f in np.unique(folds).tolist() for a, b in [np.searchsorted(folds, [f, f + 1])]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, scores = None, {}
        for batch, at, texts in _texts(batches, place):
            chunks = list(zip(batch.column(chunk_at).slice(at, len(texts)).to_pylist(), batch.column(fold_at).slice(at, len(texts)).to_pylist()))
            out = np.zeros(len(texts))
            for chunk in sorted(set(chunks)):
                if chunk[0] != now:
                    now, scores = chunk[0], load(chunk[0])
                keys, logs = scores.get(chunk[1], (np.zeros(1, np.int64), np.zeros(1, np.float32)))
                mine = [i for i, c in enumerate(chunks) if c == chunk]
                grams, sizes = codes([texts[i] for i in mine], order)
                spot = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
                if (keys[spot] != grams).any():
                    raise ValueError("the input changed between two reads")
                out[mine] = np.exp(-np.add.reduceat(logs[spot].astype(np.float64), np.r_[0, np.cumsum(sizes)[:-1]]) / sizes)
            kept = [batch.column(k).slice(at, len(texts)) for k in stays]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out)], [*names, "perplexity"])

    return docs.mapInArrow(run, docs.drop(*out_of).withColumn("perplexity", F.lit(None).cast("double")).schema)


def classify(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    upper_tail: float = UPPER_TAIL,
    lower_tail: float = LOWER_TAIL,
    prior: float = PRIOR,
    order: int = ORDER,
    with_text: bool = True,
) -> DataFrame:
    """``docs`` with ``perplexity``, ``low``, ``high`` (its language's thresholds) and ``keep``.

    ``trusted`` has the ids of trusted documents in ``id_col``; ids without a document don't matter. Null texts are
    empty. A null language is one of its own. With no trusted document at all every row is kept. Rows, repeated rows
    and other columns are kept; existing columns of the four names are replaced. Thresholds are inclusive. Without
    ``with_text`` the texts are not written to a stage table and are left out of the result.
    """
    spark = docs.sparkSession
    tables = StageTables(spark)
    docs = docs.drop("perplexity", "low", "high", "keep")
    if not bare_scan(docs):  # else a row's input split is known
        docs = tables.keep(docs, "quality-docs")
    ids = trusted.select(F.col(id_col)).filter(F.col(id_col).isNotNull()).distinct()
    fold = F.pmod(F.xxhash64(F.col(id_col)), F.lit(FOLDS)).cast("int")
    model = Model(docs.select(id_col, text_col).join(ids.hint("shuffle_hash"), id_col, "left_semi").withColumn("__fold", fold), text_col, tables, order, "__fold")
    scored = tables.keep(perplexities(docs, model, text_col, tables, fold, with_text), "quality-scored")
    tables.drop_others(scored)
    known = scored.select(id_col, F.coalesce(F.col(lang_col), F.lit("")).alias("__lang"), "perplexity").join(ids.hint("shuffle_hash"), id_col, "left_semi")
    x = F.log("perplexity")
    ends = F.percentile_approx(x, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)), F.lit(10_000))
    by = tables.keep(known.rollup("__lang").agg(ends.alias("ends"), F.count("*").alias("n"), F.grouping("__lang").alias("all")), "quality-languages")
    total = by.filter("all = 1").select("ends").first()
    if not (total and total[0]):
        return scored.withColumns({"low": F.lit(-math.inf), "high": F.lit(math.inf)}).withColumn("keep", F.lit(True))
    shape = lambda e: [e[1], e[1] - e[0], e[2] - e[1]]
    whole, share = [float(v) for v in shape(total[0])], F.col("n") / (F.col("n") + F.lit(float(prior)))
    own = by.filter("all = 0").select("__lang", *[(share * c + (1 - share) * F.lit(w)).alias(name) for c, w, name in zip(shape(F.col("ends")), whole, SHAPE)])
    if own.limit(10_001).count() <= 10_000:  # languages; beyond that bound the join shuffles
        own = F.broadcast(own)
    centre, down, up = (F.coalesce(name, F.lit(w)) for name, w in zip(SHAPE, whole))
    down, up = F.greatest(down, F.lit(1e-6)), F.greatest(up, F.lit(1e-6))
    off = x - centre
    known = known.join(own, "__lang", "left").select(F.when(off > 0, off / up).otherwise(off / down).alias("off"))
    least, most = known.agg(F.percentile_approx("off", F.array(F.lit(lower_tail), F.lit(1 - upper_tail)), F.lit(10_000))).first()[0]
    side = lambda z: F.exp(centre + F.lit(float(z)) * (up if z > 0 else down))
    judged = scored.withColumn("__lang", F.coalesce(F.col(lang_col), F.lit(""))).join(own, "__lang", "left")
    judged = judged.withColumns({"low": side(least), "high": side(most)}).drop("__lang", *SHAPE)
    return judged.withColumn("keep", F.col("perplexity").between(F.col("low"), F.col("high")))


def trusted_ids(spark, sf_dir: str) -> DataFrame:
    """The documents that are labelled as good and as not toxic; a missing label is neither."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 AND toxic = 0").select("doc_id")


def op10_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    return classify(docs, trusted_ids(spark, sf_dir), with_text=False)
