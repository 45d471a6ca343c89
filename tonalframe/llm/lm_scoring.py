r"""Log-likelihood of whole documents by a gated recurrent language model that is trained on the corpus.

Tokens are words [^\x20\x09-\x0D]+ of the text after lower-casing A-Z, then one end. Texts are split once: each task turns its documents
into shards of word numbers with the shard's own list of words. Spark counts the words over all training texts and joins the counts
back to every shard's list, however many words there are, so that documents become entries of the model and sums of the base score
without another look at a text.

The most frequent words enter the model's class-factored softmax; every rarer word belongs to one of some groups by its ending, each a
class of its own (as does every word of more than 64 bytes), within which a word has the chance (count + 1) / (sum of these + 1), the 1 being left for words never seen. So the
model's probabilities, like the base's, add up to one over counted words and one unknown word.

Training: truncated backpropagation in numpy over all training documents, each once. It goes in turns over growing shares of them; in a
turn every task trains the model at hand on its own documents, and the mean of the tasks' parameters, weighted by tokens, is the next
model. Scoring carries the state through each whole document.

Defined results: null text counts as empty (one end); null identifiers count as empty text for the fold; repeated rows get equal
results up to rounding; with nothing to train on, base and model give each token the chance of one unknown word, 1; an empty table gives no rows;
other columns are ignored. Beside a shard (`shard_tokens`, or one longer document) tasks hold two bytes a token of `block_tokens`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonalframe.llm.gru import Gru, Vocabulary
from tonalframe.llm.language_id import fold
from tonalframe.sources.scratch import written

CHUNK = 4096  # parameters in a row when tasks' models are averaged
PARTS = "shard long, chunk int, weight double, values binary"
SHARDS = "shard long, id array<long>, held array<boolean>, size array<int>, codes binary, words array<binary>, n array<int>"
ENCODED = "id long, held_out boolean, n_tokens long, n_known long, base double, inner double, entries binary"
#: Shares of the training documents that each turn adds, and its learning rate.
TURNS = ((1 / 64, 0.01), (1 / 16, 0.01), (1 / 4, 0.01), (1.0, 0.005))


def group_of(word: Column, groups: int) -> Column:
    """Group of a rare word: a hash of its last two bytes."""
    return (F.crc32(F.substring(word, F.greatest(F.length(word) - 1, F.lit(1)), F.lit(2))) % groups).cast("int")


class Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _shards(given: DataFrame, shard_tokens: int) -> DataFrame:
    """Shards of documents: ids, folds, numbers of words, the words' numbers end to end, and the shard's words with their counts in training documents."""

    def rows(batches):
        made, shard = 0, TaskContext.get().partitionId() << 32
        number, docs, codes, size = Numbers(), [], [], 0

        def one():
            flat = np.concatenate(codes)
            learnt = np.repeat([not h for _, h in docs], [len(c) for c in codes])
            n = np.bincount(flat[learnt], minlength=len(number))
            columns = [[shard + made], [[d for d, _ in docs]], [[h for _, h in docs]], [[len(c) for c in codes]], [flat.tobytes()], [list(number)], [n]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32())]
            names = ["shard", "id", "held", "size", "codes", "words", "n"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for b in batches:
            for doc, held, text in zip(b["id"].to_pylist(), b["held_out"].to_pylist(), b["text"].to_pylist(), strict=True):
                words = text.lower().split()
                docs.append((doc, held))
                codes.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                size += len(words) + 1
                if size >= shard_tokens:
                    yield one()
                    made, number, docs, codes, size = made + 1, Numbers(), [], [], 0
        if docs:
            yield one()

    # Of bytes, lower() changes A-Z only, and split() knows the six ASCII spaces only.
    return given.select("id", "held_out", F.col("text").cast("binary").alias("text")).mapInArrow(rows, SHARDS)


def _known(counts: DataFrame, known: int) -> DataFrame:
    """The `known` most frequent words of up to 64 bytes, ties by word: whole steps on a scale of counts, and the first words of the step that no longer fits."""
    short = counts.where(F.length("word") <= 64).withColumn("step", F.floor(F.log2("c") * 64).cast("int"))
    least, left, part = 1 << 30, known, None
    for r in short.groupBy("step").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():
        if r["n"] > left:
            part = r["step"]
            break
        least, left = r["step"], left - r["n"]
    whole = short.where(F.col("step") >= least)
    if part is not None and left:
        whole = whole.union(short.where(F.col("step") == part).orderBy(F.desc("c"), "word").limit(left))
    return whole.drop("step")


def _encoded(shards: DataFrame, found: DataFrame, norm: float, ends: int, end: int, first_group: int, sums: np.ndarray) -> DataFrame:
    """A row for each document, from its shard's numbers and what was found of the shard's words: place, c (0: never seen in training) and entry."""

    def rows(shard, words):
        docs, size = shard["id"].iloc[0], np.array(shard["size"].iloc[0], np.int64)
        codes = np.frombuffer(shard["codes"].iloc[0], np.int32)
        n = len(words)
        c, entry = np.zeros(n), np.zeros(n, np.uint16)
        c[words["place"]] = words["c"]
        entry[words["place"]] = words["entry"]
        log = np.log10(c + 1)
        rare = entry >= first_group
        inner = np.where(rare, log - np.log10(sums[np.where(rare, entry - first_group, 0)] + 1), 0)

        stop = np.cumsum(size)
        full = np.flatnonzero(size)

        def by_doc(values):
            out = np.zeros(len(size), values.dtype)
            if len(full):
                out[full] = np.add.reduceat(values[codes], (stop - size)[full])
            return out

        entries, mark = entry[codes], np.array([end], np.uint16)
        parts = [np.append(entries[b - s : b], mark).tobytes() for b, s in zip(stop, size, strict=True)]
        return pd.DataFrame({
            "id": pd.array([None if pd.isna(x) else int(x) for x in docs], "Int64"), "held_out": np.array(shard["held"].iloc[0], bool), "n_tokens": size + 1,
            "n_known": by_doc((c > 0).astype(np.int64)) + (ends > 0), "base": by_doc(log - norm) + np.log10(ends + 1) - norm, "inner": by_doc(inner), "entries": parts,
        })

    whole = shards.select(F.col("shard").alias("own"), "id", "held", "size", "codes")
    return whole.groupBy("own").cogroup(found.groupBy("shard")).applyInPandas(rows, ENCODED)


def _in_blocks(batches, most: int):
    """Frames with about `most` tokens at most, or one longer document."""
    held, size = [], 0
    for b in batches:
        start = 0
        for i, n in enumerate(b["entries"].map(len).tolist()):
            size += n // 2
            if size >= most:
                yield pd.concat([*held, b.iloc[start : i + 1]])
                held, size, start = [], 0, i + 1
        if start < len(b):
            held.append(b.iloc[start:])
    if held:
        yield pd.concat(held)


def _entries(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in rows["entries"]]


def _trained(rows: DataFrame, model: Gru, end: int, rate: float, block_tokens: int) -> DataFrame:
    """Each task's model after its own texts, cut into rows: shard, chunk, weight, values."""

    def train(batches):
        held, n = {}, 0
        for b in _in_blocks(batches, block_tokens):
            docs = _entries(b)
            n += sum(map(len, docs))
            model.train(docs, end, rate=rate, held=held)
        if n:
            values = model.flat()
            parts = range(0, len(values), CHUNK)
            yield pd.DataFrame({"shard": TaskContext.get().partitionId(), "chunk": list(range(len(parts))), "weight": float(n), "values": [values[i : i + CHUNK].tobytes() for i in parts]})

    return rows.select("entries").mapInPandas(train, PARTS)


def _mean(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("shard")
    w = pdf["weight"].to_numpy()
    values = w @ np.stack([np.frombuffer(x, np.float32) for x in pdf["values"]]) / w.sum()
    return pdf.iloc[:1].assign(weight=w.sum(), values=[values.astype(np.float32).tobytes()])


def _averaged(models: DataFrame, fan: int = 64) -> list:
    """The chunks of the weighted mean of all models. Means are taken of `fan` models at a time, so no group grows with their number."""
    models = written(models, "models")
    last = models.agg(F.coalesce(F.max("shard"), F.lit(0))).first()[0]
    while last:
        models = models.withColumn("shard", F.floor(F.col("shard") / fan).cast("long")).groupBy("shard", "chunk").applyInPandas(_mean, PARTS)
        last //= fan
    return models.collect()


def _loaded(model: Gru, rows: list) -> Gru:
    return model.load(np.concatenate([np.frombuffer(r["values"], np.float32) for r in sorted(rows, key=lambda r: r["chunk"])])) if rows else model


def lm_scores(
    docs: DataFrame, held_folds: int = 7, held: int = 2, in_model: int = 2048, groups: int = 8, known: int = 65_536, classes: int = 32, hidden: int = 12,
    shard_tokens: int = 4_000_000, block_tokens: int = 6_000_000, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of `docs`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).cast("long").alias("id"), (fold(id_col, held_folds) == held).alias("held_out"), text.alias("text"))
    shards = written(_shards(given, shard_tokens), "shards")
    each = shards.select("shard", F.posexplode(F.arrays_zip("words", "n")).alias("place", "x"))
    each = each.select("shard", "place", F.col("x.words").alias("word"), F.col("x.n").alias("n"))
    counts = written(each.where("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "word-counts")
    ends = shards.agg(F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0))).first()[0]
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, kinds = total[0] + ends, total[1] + (ends > 0)

    often = _known(counts, known)
    top = often.orderBy(F.desc("c"), "word").limit(in_model).collect()
    model_words = sorted([(b"", ends), *((bytes(r["word"]), r["c"]) for r in top)], key=lambda x: (-x[1], x[0]))  # the end is the empty word
    end, first_group = model_words.index((b"", ends)), len(model_words)
    spark = docs.sparkSession
    ranks = F.broadcast(spark.createDataFrame([(w, i) for i, (w, _) in enumerate(model_words) if w], "word binary, rank int"))
    own_group = group_of(F.col("word"), groups)
    sums = np.zeros(groups)
    for r in counts.join(ranks, "word", "left_anti").groupBy(own_group.alias("g")).agg(F.sum(F.col("c") + 1).alias("s")).collect():
        sums[r["g"]] = r["s"]
    norm = float(np.log10(tokens + kinds + 1.0))

    # Frequent words, bounded, meet the shards by a broadcast; only the others are shuffled.
    often = F.broadcast(often.join(ranks, "word", "left").select("word", F.col("c").alias("c"), F.coalesce("rank", first_group + own_group).alias("entry")))
    near = each.join(often, "word").select("shard", "place", "c", "entry")
    far = each.join(often, "word", "left_anti").join(counts, "word", "left").select("shard", "place", F.coalesce("c", F.lit(0)).cast("long").alias("c"), (first_group + own_group).alias("entry"))
    encoded = written(_encoded(shards, near.unionByName(far), norm, ends, end, first_group, sums), "encoded")

    vocabulary = Vocabulary(np.array([c for _, c in model_words], float), sums, classes)
    model = Gru(vocabulary, hidden)
    where = F.pmod(F.xxhash64("id", "n_tokens", "base"), F.lit(1 << 20)) / (1 << 20)
    before = 0.0
    for share, rate in TURNS:
        turn = encoded.where(~F.col("held_out") & (where >= before) & (where < share))
        model = _loaded(model, _averaged(_trained(turn, model, end, rate, block_tokens)))
        before = share

    def scored(batches):
        for b in _in_blocks(batches, block_tokens):
            yield b.drop(columns="entries").assign(lm=model.score(_entries(b), end) / np.log(10), id=b["id"].astype("Int64"))

    found = encoded.mapInPandas(scored, "id long, held_out boolean, n_tokens long, n_known long, base double, inner double, lm double")
    return found.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"),
        (F.col("lm") + F.col("inner")).alias("score"),
    )
