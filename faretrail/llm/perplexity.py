"""Operator 5: quality rules with n-gram perplexity.

The model is a modified Kneser-Ney model of order four over UTF-16 code units
of the lower-cased, space-joined words, one a language. Four units are one
64-bit key, so a key's context and suffix are shifts and masks, and Spark
counts, discounts and interpolates the orders with groupings and joins over
distinct n-grams. Logarithms are whole numbers of 2**-20, so sums do not depend
on their order. Since every document is counted, every n-gram that is scored has
its row in the model.

The model is read as arrays sorted by key and searched by bisection when it has
at most ``MODEL_ROWS`` rows; a larger one is joined to the documents' n-gram
counts instead. Both ways give the same sums.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from faretrail.llm import textarrays as ta
from faretrail.llm.common import fresh_name, on_workers, own_state, released, staged

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ORDER = 4
SCALE = 1 << 20
#: Languages up to which their discounts (one row each) are broadcast; more are joined.
BROADCAST_LANGS = 10_000
#: Rows (12 bytes each) up to which the model is broadcast.
MODEL_ROWS = 16_000_000
#: Bytes of texts in one array pass.
GROUP = 2 << 20
SYMBOL = np.zeros(256, np.int64)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def units(text: str | None) -> np.ndarray:
    """UTF-16 code units of the words, lower-cased and joined by spaces; three spaces stand before them, one after. No words: none."""
    found = WORD.findall(text or "")
    if not found:
        return np.zeros(0, np.uint16)
    return np.frombuffer(("   " + " ".join(found).lower() + " ").encode("utf-16-le", "surrogatepass"), "<u2")


def grams(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all runs of four units within each text, and their texts."""
    sizes = np.array([len(t) for t in texts])
    flat = np.concatenate(texts).astype(np.uint64) if len(texts) else np.zeros(0, np.uint64)
    if len(flat) < ORDER:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = flat[:-3] << np.uint64(48) | flat[1:-2] << np.uint64(32) | flat[2:-1] << np.uint64(16) | flat[3:]
    ends = np.cumsum(sizes)[sizes > 0]
    inside = np.ones(len(flat), bool)
    for k in (1, 2, 3):
        inside[ends - k] = False
    inside = inside[: len(key)]
    doc = np.repeat(np.arange(len(texts)), sizes)[: len(key)]
    return key.view(np.int64)[inside], doc[inside]


def by_language(langs: list[str | None]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for k, x in enumerate(langs):
        out.setdefault(x or "", []).append(k)
    return out


def _parts(batch: pa.RecordBatch, lang: int, text: int) -> Iterator[tuple[list[str | None], list[str | None]]]:
    langs, texts = batch.column(lang).to_pylist(), batch.column(text)
    _, off = ta.utf8(texts)
    for i, j in ta.blocks(off, GROUP):
        yield langs[i:j], texts.slice(i, j - i).to_pylist()


def counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """``(lang, gram, n)`` over all documents; each task adds up its own before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_state("perplexity")
        for batch in batches:
            held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for langs, texts in _parts(batch, 0, 1):
                for name, rows in by_language(langs).items():
                    key, _ = grams([u for k in rows if len(u := units(texts[k]))])
                    held.setdefault(name, []).append(np.unique(key, return_counts=True))
            for name, parts in held.items():
                key, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(which, np.concatenate([p[1] for p in parts]), len(key)).astype(np.int64)
                if len(key):
                    yield pa.record_batch({"lang": pa.repeat(name, len(key)), "gram": pa.array(key), "n": pa.array(n)})
        released()

    rows = docs.select(F.col(lang).cast("string"), F.col(text)).mapInArrow(counted, "lang string, gram long, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _few_languages(rows: DataFrame, lang: str) -> Callable[[DataFrame], DataFrame]:
    """Marks tables of one row a language for broadcast, if ``rows`` has few languages; leaves them as they are otherwise."""
    return F.broadcast if rows.select(lang).distinct().count() <= BROADCAST_LANGS else (lambda df: df)


def kneser_ney(counted: DataFrame) -> DataFrame:
    """``(lang, gram, logp)``: the interpolated probability of each n-gram's last unit, as logarithm times ``SCALE``."""
    orders = {ORDER: counted}
    for k in range(ORDER - 1, 0, -1):  # how many units stand before each lower n-gram
        orders[k] = orders[k + 1].groupBy("lang", F.col("gram").bitwiseAND((1 << 16 * k) - 1).alias("gram")).agg(F.count("*").alias("n"))
    # one row a language; within the bound no n-gram is dealt out by its language alone
    held = _few_languages(counted, "lang")
    lower = None
    for k in range(1, ORDER + 1):
        rows = orders[k]
        of = [F.sum((F.col("n") == i).cast("long")).alias(f"t{i}") for i in (1, 2, 3, 4)]
        sums = {"total": F.sum("n")} | {f"c{i}": F.sum((F.col("n") == i if i < 3 else F.col("n") >= 3).cast("long")) for i in (1, 2, 3)}
        # a language's units have one context, the empty one: its sums are added up before the shuffle
        own = [x.alias(c) for c, x in sums.items()] if k == 1 else []
        some = rows.groupBy("lang").agg(*of, F.count("*").alias("types"), *own)
        y = F.expr("IF(t1 + t2 = 0, 0D, t1 / (t1 + 2D * t2))")
        cut = [F.least(F.lit(i - 0.01), F.greatest(F.lit(0.0), F.when(F.col(f"t{i}") > 0, i - (i + 1) * y * F.col(f"t{i + 1}") / F.col(f"t{i}")).otherwise(0.0))).alias(f"d{i}") for i in (1, 2, 3)]
        if k > 1:
            context = Window.partitionBy("lang", F.shiftrightunsigned("gram", 16))
            rows = rows.select("lang", "gram", "n", *[x.over(context).alias(c) for c, x in sums.items()])
        rows = rows.join(held(some.select("lang", "types", *cut, *(sums if k == 1 else []))), "lang")
        rows = rows.withColumn("cut", F.expr("CASE WHEN n = 1 THEN d1 WHEN n = 2 THEN d2 ELSE d3 END"))
        rest = F.expr("(d1 * c1 + d2 * c2 + d3 * c3) / total")
        if lower is None:
            below = 1 / F.col("types")
        else:
            rows = rows.withColumn("suffix", F.col("gram").bitwiseAND((1 << 16 * (k - 1)) - 1)).join(
                lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"])
            below = F.col("below")
        lower = rows.select("lang", "gram", ((F.col("n") - F.col("cut")) / F.col("total") + rest * below).alias("p"))
    return lower.select("lang", "gram", F.round(F.log("p") * SCALE).cast("int").alias("logp"))


def features(docs: DataFrame, text: str, lang: str, model: DataFrame | None) -> DataFrame:
    """Add the base features, ``n_grams`` and, with a model within the bound, the sum of its logarithms ``score``."""
    spark = docs.sparkSession
    shared = None
    if model is not None:
        rows = model.orderBy("lang", "gram").toArrow()
        arrays = {}
        names = rows.column("lang").to_numpy()
        for name in dict.fromkeys(names.tolist()):
            a, b = np.searchsorted(names, [name, name + "\0"])
            arrays[name] = (rows.column("gram").to_numpy()[a:b].copy(), rows.column("logp").to_numpy()[a:b].copy())
        shared = spark.sparkContext.broadcast(arrays)
    made = [*FEATURES, "n_grams", "score"]

    def measured(langs: list[str | None], column: pa.Array) -> dict[str, np.ndarray]:
        raw, off = ta.utf8(column)
        n = len(off) - 1
        w = ta.words(raw, off, ta.SPACED)
        texts = column.to_pylist()
        points = ta.starts_of_points(raw)
        out = {"n_words": np.bincount(w.doc, minlength=n)}
        out["word_chars"] = np.bincount(w.doc, points[w.end] - points[w.start], n)
        symbols = np.concatenate([[0], np.cumsum(SYMBOL[raw])])
        out["n_symbols"] = symbols[off[1:]] - symbols[off[:-1]]
        lines = [[x for x in t.split("\n") if WORD.search(x)] if t else [] for t in texts]
        out["n_dup_lines"] = np.array([len(x) - len(set(x)) for x in lines])
        h, doc, at = ta.windows(w, n, 3)
        _, which, times = np.unique(ta.mix(h + doc.astype(np.uint64) * ta.BASE), return_inverse=True, return_counts=True)
        again = at[times[which] > 1]
        change = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(change, again, 1)
        np.add.at(change, again + 3, -1)
        out["n_repeat_words"] = np.bincount(w.doc[np.cumsum(change)[:-1] > 0], minlength=n)
        out["n_grams"], out["score"] = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if shared is not None:
            for name, rows in by_language(langs).items():
                key, doc = grams([units(texts[k]) for k in rows])
                if len(key):
                    keys, logp = shared.value.get(name, (np.zeros(0, np.int64), np.zeros(0, np.int32)))
                    at = np.searchsorted(keys, key)
                    if len(keys) == 0 or (keys[np.minimum(at, len(keys) - 1)] != key).any():
                        raise ValueError("an n-gram that the model lacks: the documents differ from those counted")
                    found = logp[at].astype(np.int64)
                    sums = np.concatenate([[0], np.cumsum(found)])
                    ends = np.searchsorted(doc, np.arange(len(rows) + 1))
                    out["n_grams"][rows] = np.diff(ends)
                    out["score"][rows] = sums[ends[1:]] - sums[ends[:-1]]
        return out

    def scored(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own_state("perplexity")
        for names, texts in batches:
            _, off = ta.utf8(texts)
            langs = names.to_pylist()
            parts = [measured(langs[i:j], texts.slice(i, j - i)) for i, j in ta.blocks(off, GROUP)]
            columns = [np.concatenate([np.zeros(0, np.int64), *[p[m] for p in parts]]).astype(np.int64) for m in made]
            yield pa.StructArray.from_arrays([pa.array(c) for c in columns], made)
        released()

    # the text goes to Python once and only numbers come back; the row's other columns stay where they are
    numbers = F.arrow_udf(scored, "struct<" + ",".join(f"{m}:bigint" for m in made) + ">", ArrowUDFType.SCALAR_ITER)
    inner = fresh_name(docs, "measured")
    keep = [f"`{c}`" for c in docs.columns if c.lower() not in made]
    return docs.withColumn(inner, numbers(F.col(lang).cast("string"), F.col(text))).select(*keep, *[F.col(f"{inner}.{m}") for m in made])


def _joined_scores(docs: DataFrame, text: str, lang: str, model: DataFrame) -> DataFrame:
    """``n_grams`` and ``score`` by a join of the documents' n-gram counts with a model of any size."""
    row = fresh_name(docs, "row")
    docs = staged(features(docs, text, lang, None).drop("n_grams", "score").withColumn(row, F.monotonically_increasing_id()))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, name, t in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                key, n = np.unique(grams([units(t)])[0], return_counts=True)
                yield pa.record_batch({"row": pa.array([number] * len(key), pa.int64()), "lang": pa.array([name or ""] * len(key), pa.string()),
                                       "gram": pa.array(key, pa.int64()), "n": pa.array(n, pa.int64())})

    own = docs.select(F.col(row).alias("row"), F.col(lang).cast("string"), F.col(text)).mapInArrow(counted, "row long, lang string, gram long, n long")
    sums = own.join(model, ["lang", "gram"]).groupBy(F.col("row").alias(row)).agg(
        F.sum("n").alias("n_grams"), F.sum(F.col("n") * F.col("logp")).alias("score"))
    return docs.join(sums, row, "left").drop(row).fillna(0, ["n_grams", "score"])


def quality(docs: DataFrame, text: str = "text", lang: str = "lang", keep_text: bool = True, width: float = 8.0,
            least: float = 0.05, model_rows: int = MODEL_ROWS) -> DataFrame:
    """Add the base features, ``perplexity``, its band, ``base_failed`` and ``kept`` to every row.

    The model and the bands come from all documents. A language's band is its
    median log perplexity plus and minus ``width`` robust deviations (1.4826
    times the median absolute deviation, at least ``least``); documents outside
    are rejected, as are those with fewer than 50 words or with over half of
    their words in repeated 3-word windows. Null languages are one language of
    their own; null texts have no words, no perplexity, and fail. Repeated rows
    count as often as they occur. Columns of these names, and of the names
    ``n_grams``, ``score``, ``lowest``, ``highest`` and ``band_lang``, are
    replaced; an empty table stays empty. ``keep_text=False`` drops the text from the result.
    """
    on_workers(docs.sparkSession)
    model = staged(kneser_ney(staged(counts(docs, text, lang))))
    if model.count() <= model_rows:
        out = features(docs, text, lang, model)
    else:
        out = _joined_scores(docs, text, lang, model)
    out = staged(out if keep_text else out.drop(text))
    name = F.coalesce(F.col(lang).cast("string"), F.lit(""))
    bands = staged(out.where("n_grams > 0").groupBy(name.alias("band_lang"), F.round(-F.col("score") / F.col("n_grams") / SCALE * 1000).cast("long").alias("bin")).agg(F.count("*").alias("n")))
    # one row a language; within the bound no document is dealt out by its language
    held = _few_languages(bands, "band_lang")
    middle = _median(bands, "bin").withColumnRenamed("median", "middle")
    off = bands.join(middle, "band_lang").withColumn("off", F.abs(F.col("bin") - F.col("middle")))
    spread = _median(off.groupBy("band_lang", "off").agg(F.sum("n").alias("n")), "off")
    limits = middle.join(spread, "band_lang").withColumn("reach", F.greatest(F.lit(least), 1.4826 * F.col("median") / 1000) * width).select(
        "band_lang", F.exp(F.col("middle") / 1000 - F.col("reach")).alias("lowest"), F.exp(F.col("middle") / 1000 + F.col("reach")).alias("highest"))
    out = out.drop("perplexity", "lowest", "highest", "base_failed", "kept").withColumn("band_lang", name).join(held(limits), "band_lang", "left").drop("band_lang")
    out = out.withColumn("perplexity", F.when(F.col("n_grams") > 0, F.exp(-F.col("score") / F.col("n_grams") / SCALE)))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    inside = F.coalesce(F.col("perplexity").between(F.col("lowest"), F.col("highest")), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & inside).drop("n_grams", "score")


def _median(rows: DataFrame, value: str) -> DataFrame:
    """Lower median of counted whole numbers by language; the rows are bins of a fixed width, not documents."""
    upto = Window.partitionBy("band_lang").orderBy(value)
    every = Window.partitionBy("band_lang")
    ranked = rows.select("band_lang", value, F.sum("n").over(upto).alias("upto"), F.sum("n").over(every).alias("every"))
    return ranked.where("2 * upto >= every").groupBy("band_lang").agg(F.min(value).alias("median"))
