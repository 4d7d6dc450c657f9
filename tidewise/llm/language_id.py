"""Language identification with interpolated Kneser-Ney character models.

Counting: every task counts the character n-grams of the words of its learning documents
by language; the counts are summed over the whole corpus. Building: per language,
interpolated Kneser-Ney with one discount an order, lower orders from continuation counts. The
models of all languages share sorted arrays of n-gram hashes, one an order, beside a
matrix of log probabilities. Scoring: each distinct word of a slice is scored once; a
document goes to the language of the lowest cross-entropy per character. A cross-entropy
above the language's calibrated limit marks the prediction as rejected.

A model of too many n-grams for one process is spread: the same recursion runs as joins over all
counts, and gives the log probabilities of the corpus's distinct n-grams. These become sorted hash arrays again,
one for each range of hashes and of a bounded size. A slice of documents asks each range for the hashes that lie there,
by a shuffle, and a task that holds one range answers the slices as they stream past.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise.llm.common import SLICE_BYTES, held_out, map_text, read, saved, slices, small_batches

ORDER = 4
START, END = "\x02", "\x03"
#: Most n-grams of a model in the arrays of one process, and most numbers in a matrix of it; a larger model is spread, with all n-grams.
MODEL_GRAMS = 400_000
MODEL_NUMBERS = 20_000_000
#: Numbers in the matrix of one range of hashes of a spread model, and most asked hashes that one copy of a range answers.
RANGE_NUMBERS = 2_000_000
ASKED = 8_000_000
#: Learning documents on which the scores' scale is calibrated: those with the smallest hashes of their ids.
CALIBRATION = 3000
#: Share of a language's learning documents beyond its limit, and slack above it.
REJECTED_SHARE, SLACK = 0.002, 1.05
#: The share is right to one in so many.
QUANTILE_STEPS = 100_000
UNKNOWN = "und"


def letter_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Document and code of each lower-case word of letters, and the distinct words."""
    low = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(text, "")), r"[^\p{L}\p{M}\s]+", " ")
    parts = pc.utf8_split_whitespace(low)
    off = parts.offsets.to_numpy().astype(np.int64)
    enc = parts.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
    words = enc.dictionary
    code = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ok = pc.match_substring_regex(words, r"\p{L}").to_numpy(zero_copy_only=False)
    number = np.cumsum(ok) - 1
    doc = np.repeat(np.arange(len(parts)), np.diff(off))
    good = ok[code] if len(code) else np.zeros(0, bool)
    return doc[good], number[code[good]], words.filter(pa.array(ok)).to_pylist()


def _characters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words with their padding, places that end an n-gram, word of each place."""
    pad = START * (ORDER - 1)
    text = pad + (END + pad).join(words) + END if words else ""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(c != ord(START))
    word = np.cumsum(np.r_[0, (c[at] == ord(END))[:-1]]) if len(at) else np.zeros(0, np.int64)
    return c, at, word


def count_grams(text: pa.Array, lang: np.ndarray, n_langs: int):
    """(language number, n-gram as ORDER code points, count) of a slice."""
    doc, code, words = letter_words(text)
    if not words:
        return np.zeros(0, np.int64), np.zeros((0, ORDER), np.uint32), np.zeros(0, np.int64)
    c, at, word = _characters(words)
    alphabet, letter = np.unique(c, return_inverse=True)
    packed = letter[at].astype(np.int64)
    for k in range(1, ORDER):
        if (int(packed.max()) + 1) * len(alphabet) >= 1 << 62:  # very many characters: number what there is anew
            packed = np.unique(packed, return_inverse=True)[1]
        packed = packed * len(alphabet) + letter[at - k]
    langs, grams, counts = [], [], []
    for x in range(n_langs):
        times = np.bincount(code[lang[doc] == x], minlength=len(words))
        if not times.any():
            continue
        here = times[word] > 0
        kinds, first, place = np.unique(packed[here], return_index=True, return_inverse=True)
        example = at[here][first]
        langs.append(np.full(len(kinds), x))
        grams.append(np.column_stack([c[example - k] for k in range(ORDER - 1, -1, -1)]))
        counts.append(np.bincount(place, weights=times[word][here]).astype(np.int64))
    if not langs:
        return np.zeros(0, np.int64), np.zeros((0, ORDER), np.uint32), np.zeros(0, np.int64)
    return np.concatenate(langs), np.concatenate(grams), np.concatenate(counts)


def corpus_counts(learning: DataFrame) -> DataFrame:
    """(lang, gram, n) summed over all rows of ``learning`` (lang, text)."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches):
        for b in batches:
            for lo, hi in slices(b.column(1), 2 * SLICE_BYTES):
                part = b.slice(lo, hi - lo)
                names = pc.unique(part.column(0))
                lang = pc.index_in(part.column(0), names).to_numpy(zero_copy_only=False)
                which, grams, n = count_grams(part.column(1), lang, len(names))
                text = np.ascontiguousarray(grams.astype("<u4")).view(f"<U{ORDER}").ravel()
                yield pa.RecordBatch.from_arrays([names.take(pa.array(which, pa.int64())).cast(pa.string()), pa.array(text.tolist(), pa.string()),
                                                  pa.array(n, pa.int64())], names=schema.names)

    return learning.select("lang", "text").mapInArrow(run, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _hash(grams: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of code points, folded from the left."""
    h = np.full(len(grams), 0xCBF29CE484222325, np.uint64)
    for k in range(grams.shape[1]):
        h = (h ^ grams[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _find(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, h)
    at[at == len(table)] = 0
    return at, table[at] == h if len(table) else np.zeros(len(h), bool)


@dataclass
class Model:
    """By order 1..ORDER: sorted n-gram hashes and log probabilities; sorted context hashes and log weights."""

    langs: list[str]
    grams: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    weight: list[np.ndarray]
    floor: np.ndarray
    scale: float = 1.0
    limit: np.ndarray | None = None

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word with its end under each language."""
        c, at, word = _characters(words)
        out = np.zeros((len(words), len(self.langs)))
        for lo in range(0, len(at), 1 << 20):  # bounds the matrices
            a = at[lo:lo + (1 << 20)]
            view = np.column_stack([c[a - k] for k in range(ORDER - 1, -1, -1)])
            p = self._score(view)
            w = word[lo:lo + (1 << 20)]
            for x in range(len(self.langs)):
                out[:, x] += np.bincount(w, weights=p[:, x], minlength=len(words))
        return out

    def _score(self, view: np.ndarray) -> np.ndarray:
        p = np.zeros((len(view), len(self.langs)), np.float32)
        open_ = np.arange(len(view))
        for k in range(ORDER, 0, -1):
            place, hit = _find(self.grams[k - 1], _hash(view[open_, ORDER - k:]))
            p[open_[hit]] += self.logp[k - 1][place[hit]]
            open_ = open_[~hit]
            if not len(open_):
                return p
            if k > 1:
                place, hit = _find(self.contexts[k - 1], _hash(view[open_, ORDER - k:ORDER - 1]))
                p[open_[hit]] += self.weight[k - 1][place[hit]]
        p[open_] += self.floor
        return p

    def entropies(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character by language, and characters (ends included), of each text."""
        doc, code, words = letter_words(text)
        n = len(text)
        total = np.zeros((n, len(self.langs)))
        length = np.array([len(w) + 1 for w in words], np.float64)
        size = np.bincount(doc, weights=length[code], minlength=n)[:n] if len(code) else np.zeros(n)
        if len(code):
            scores = self.word_scores(words)
            for x in range(len(self.langs)):
                total[:, x] = np.bincount(doc, weights=scores[code, x], minlength=n)[:n]
        return -total / np.maximum(size, 1)[:, None], size

    def posterior(self, ce: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Calibrated probability of each language."""
        z = -ce * (size / self.scale)[:, None]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


@dataclass
class Spread(Model):
    """A spread model. By order 1..ORDER: (gram, p), (context, w) with maps of language number to log probability or weight."""

    tables: list[tuple[DataFrame, DataFrame]] | None = None


def _discount(ones: int, twos: int) -> float:
    return min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.9) if ones else 0.5


def spread(counts: DataFrame, langs: list[str]) -> Spread:
    """What ``build`` makes, from all (lang, gram, n) counts, in tables. The driver gets a row a language and order."""
    place = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")).cast("int") - 1
    level = {ORDER: counts.select(place.alias("lang"), "gram", "n")}
    for k in range(ORDER - 1, 0, -1):
        level[k] = saved(level[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"grams-{k}")
    letters = level[1].select("gram").distinct().count() + 1

    def by_gram(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
        entries = F.collect_list(F.struct("lang", F.ln(value)))
        return saved(rows.groupBy(key).agg(F.map_from_entries(entries).alias(name)), f"model-{name}")

    below, tables, floor = None, [], np.zeros(len(langs))
    for k in range(1, ORDER + 1):
        some = level[k].groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect()
        known = {r.lang: _discount(r.ones, r.twos) for r in some}
        discount = F.get(F.array(*[F.lit(known.get(x, 0.5)) for x in range(len(langs))]), F.col("lang"))
        own = level[k].withColumn("context", F.substring("gram", 1, k - 1))
        contexts = saved(own.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
                         .withColumn("gamma", discount * F.col("kinds") / F.col("total")), f"contexts-{k}")
        rows = own.join(contexts, ["lang", "context"]).withColumn("suffix", F.substring("gram", 2, k - 1))
        if below is None:
            rows = rows.withColumn("below", F.lit(1 / letters))
            for r in contexts.collect():  # one row a language
                floor[r.lang] = np.log(r.gamma) - np.log(letters)
        else:
            rows = rows.join(below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"])
        p = F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total") + F.col("gamma") * F.col("below")
        below = saved(rows.select("lang", "gram", p.alias("p")), f"p-{k}")
        tables.append((by_gram(below, "gram", "p", "p"), by_gram(contexts, "context", "gamma", "w")))
    return Spread(langs, [], [], [], [], floor, tables=tables)


def _gram_scores(model: Spread, grams: DataFrame) -> DataFrame:
    """(gram, s) for each distinct gram: its log probability in each language."""
    need = {ORDER: saved(grams.select("gram").distinct(), "need")}
    for k in range(ORDER - 1, 0, -1):
        need[k] = need[k + 1].select(F.substring("gram", 2, k).alias("gram")).distinct()
    below = None
    for k, (p, w) in enumerate(model.tables, 1):
        rows = need[k].join(p, "gram", "left")
        if below is None:
            rows = rows.withColumn("w", F.lit(None).cast("map<int,double>")).withColumn("below", F.array(*[F.lit(float(x)) for x in model.floor]))
        else:
            rows = (rows.withColumn("context", F.substring("gram", 1, k - 1)).join(w, "context", "left").withColumn("suffix", F.substring("gram", 2, k - 1))
                    .join(below.select(F.col("gram").alias("suffix"), F.col("s").alias("below")), "suffix"))
        score = F.transform(F.sequence(F.lit(0), F.lit(len(model.langs) - 1)), lambda x: F.coalesce(
            F.try_element_at("p", x), F.coalesce(F.try_element_at("w", x), F.lit(0.0)) + F.get("below", x)))
        below = saved(rows.select("gram", score.alias("s")), f"scores-{k}")
    return below


def _points(grams: pa.Array) -> np.ndarray:
    """Code points of n-grams of the highest order, a row each."""
    return np.frombuffer("".join(grams.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER)


def _range_of(h: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` equal ranges of signed hashes each hash lies in."""
    return ((h >> 32) + (1 << 31)) * n >> 32


def _ranges(scores: DataFrame, n_langs: int, n: int) -> DataFrame:
    """(range, h, s) from (gram, s): the sorted hashes of a range and the matrix of their log probabilities, as bytes."""
    def hashed(batches):
        for b in batches:
            h = _hash(_points(b.column(0))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(_range_of(h, n)), pa.array(h), b.column(1)], names=["range", "h", "s"])

    def packed(rows: pa.Table) -> pa.Table:
        h = rows["h"].to_numpy()
        order = np.argsort(h)
        p = pc.list_flatten(rows["s"]).to_numpy().reshape(-1, n_langs).astype(np.float32)[order]
        return pa.table({"range": rows["range"][:1], "h": pa.array([h[order].tobytes()], pa.binary()), "s": pa.array([p.tobytes()], pa.binary())})

    return (scores.select("gram", "s").mapInArrow(hashed, "range long, h long, s array<double>")
            .groupBy("range").applyInArrow(packed, "range long, h binary, s binary"))


def _answers(asked: DataFrame, ranges: DataFrame, copies: int, n_langs: int) -> DataFrame:
    """(slice, range, s) for each asked (slice, range, h): the rows of the range's matrix for the hashes.

    The questions to a range are dealt out to its copies. A task has one range at a time, ahead of its questions.
    """
    own = ranges.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select(
        (F.col("range") * copies + F.col("copy")).alias("key"), F.lit(None).cast("string").alias("slice"), "range", "h", "s")
    questions = asked.select((F.col("range") * copies + F.pmod(F.xxhash64("slice"), F.lit(copies))).alias("key"), "slice", "range", "h",
                             F.lit(None).cast("binary").alias("s"))

    def answer(batches):
        table = p = None
        for b in batches:
            for i in range(b.num_rows):
                h = np.frombuffer(b.column(3)[i].as_buffer(), np.int64)
                if b.column(4)[i].is_valid:
                    table, p = h.copy(), np.frombuffer(b.column(4)[i].as_buffer(), np.float32).reshape(-1, n_langs).copy()
                    continue
                place, hit = _find(table, h)
                if not hit.all():
                    raise ValueError("a hash that its range does not hold")
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, 1), b.column(2).slice(i, 1), pa.array([p[place].tobytes()], pa.binary())],
                                                 names=["slice", "range", "s"])

    return (own.unionByName(questions).repartition("key").sortWithinPartitions("key", F.col("slice").isNotNull())
            .mapInArrow(answer, "slice string, range long, s binary"))


def _kinds(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted signed hashes of the distinct n-grams of words, their code points, kind and word of each n-gram."""
    c, at, word = _characters(words)
    view = np.column_stack([c[at - k] for k in range(ORDER - 1, -1, -1)])
    h, first, kind = np.unique(_hash(view).view(np.int64), return_index=True, return_inverse=True)
    return h, view[first], kind, word


def _packed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)


def _spread_scored(docs: DataFrame, model: Spread, carry: list[str]) -> DataFrame:
    """``_scored`` for a spread model: texts become slices of word numbers, whose n-grams are asked of the ranges."""
    n_langs = len(model.langs)
    kept = [T.StructField(c, T.ArrayType(docs.schema[c].dataType)) for c in carry]
    schema = T.StructType([*kept, T.StructField("__slice", T.StringType()), T.StructField("__sizes", T.ArrayType(T.IntegerType())),
                           T.StructField("__codes", T.BinaryType()), T.StructField("__words", T.BinaryType()), T.StructField("__most", T.LongType())])
    m = len(carry)

    def cut(batches):
        for b in batches:
            for lo, hi in slices(b.column(m), min(2 * SLICE_BYTES, MODEL_NUMBERS // n_langs + 1)):
                part = b.slice(lo, hi - lo)
                doc, code, words = letter_words(part.column(m))
                sizes = np.bincount(doc, minlength=hi - lo).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), part.column(j)) for j in range(m)),
                     pa.array([uuid.uuid4().hex]), pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), pa.array(sizes)),
                     pa.array([_packed(code.astype("<u4").tobytes())], pa.binary()),
                     pa.array([_packed(" ".join(words).encode())], pa.binary()), pa.array([sum(map(len, words)) + len(words)])], names=schema.names)

    def words_of(value: pa.Scalar) -> list[str]:
        text = _unpacked(value.as_py()).decode()
        return text.split(" ") if text else []

    def grams(batches):
        for b in batches:
            for value in b.column(0):
                points = _kinds(words_of(value))[1]
                text = np.ascontiguousarray(points.astype("<u4")).view(f"<U{ORDER}").ravel()
                yield pa.RecordBatch.from_arrays([pa.array(text.tolist(), pa.string())], names=["gram"])

    def back(batches):
        for b in batches:
            for i in range(b.num_rows):
                sizes = b.column("__sizes")[i].values.to_numpy(zero_copy_only=False)
                code = np.frombuffer(_unpacked(b.column("__codes")[i].as_py()), np.uint32).astype(np.int64)
                words = words_of(b.column("__words")[i])
                n, size, total = len(sizes), np.zeros(len(sizes)), np.zeros((len(sizes), n_langs))
                if words:
                    doc = np.repeat(np.arange(n), sizes)
                    size = np.bincount(doc, weights=np.array([len(w) + 1 for w in words], np.float64)[code], minlength=n)
                    _, _, kind, word = _kinds(words)
                    found = b.column("__s")[i].values
                    p = np.frombuffer(b"".join(found.field("s").to_pylist()), np.float32).reshape(-1, n_langs)
                    for x in range(n_langs):
                        own = np.bincount(word, weights=p[kind, x])
                        total[:, x] = np.bincount(doc, weights=own[code], minlength=n)
                ce = -total / np.maximum(size, 1)[:, None]
                yield pa.RecordBatch.from_arrays([*(b.column(c)[i].values for c in carry), _lists(ce), pa.array(size)], names=[*carry, "ce", "size"])

    def ask(n: int):
        def run(batches):
            for b in batches:
                for i in range(b.num_rows):
                    h = _kinds(words_of(b.column(1)[i]))[0]
                    some, first = np.unique(_range_of(h, n), return_index=True)
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(some), pa.string()), pa.array(some, pa.int64()),
                                                      pa.array([x.tobytes() for x in np.split(h, first[1:])][:len(some)], pa.binary())],
                                                     names=["slice", "range", "h"])
        return run

    out = T.StructType([*(docs.schema[c] for c in carry), T.StructField("ce", T.ArrayType(T.DoubleType())), T.StructField("size", T.DoubleType())])
    parts = saved(docs.select(*carry, F.col("text").cast("string")).mapInArrow(cut, schema), "slices")
    with small_batches(docs.sparkSession, 1):  # a row is a slice
        scores = _gram_scores(model, parts.select("__words").mapInArrow(grams, "gram string"))
    n = scores.count() * n_langs // RANGE_NUMBERS + 1
    ranges = saved(_ranges(scores, n_langs, n), "ranges")
    most = parts.agg(F.coalesce(F.sum("__most"), F.lit(0)).alias("n")).first()["n"]  # a slice has no more distinct n-grams than characters
    asked = parts.select("__slice", "__words").mapInArrow(ask(n), "slice string, range long, h binary")
    answers = _answers(asked, ranges, most // (n * ASKED) + 1, n_langs)
    found = answers.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("range", "s"))).alias("__s"))
    with small_batches(docs.sparkSession, 1):  # a row is a slice, a range or a question
        return saved(parts.drop("__most").join(found.withColumnRenamed("slice", "__slice"), "__slice", "left").mapInArrow(back, out), "scored")


def build(counts: pd.DataFrame) -> Model:
    """Models of all languages from the (lang, gram, n) counts of the highest order."""
    if counts.empty:
        none = [np.zeros(0, np.uint64)] * ORDER
        return Model([], none, [np.zeros((0, 0), np.float32)] * ORDER, none, [np.zeros((0, 0), np.float32)] * ORDER, np.zeros(0, np.float32))
    langs = sorted(counts["lang"].unique())
    number = counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
    points = np.array([[ord(c) for c in g] for g in counts["gram"]], np.uint32).reshape(-1, ORDER)
    count, size = counts["n"].to_numpy(np.float64), len(langs)
    letters = len(np.unique(points[:, -1])) + 1 if len(points) else 1
    grams, logp, contexts, weights = [], [], [], []

    # counts by order: raw at the top, below it the number of different characters before the n-gram
    by_order = {ORDER: (points, number, count)}
    for k in range(ORDER - 1, 0, -1):
        above, lang, _ = by_order[k + 1]
        table = pd.DataFrame({"h": _hash(above[:, 1:]), "lang": lang, "at": np.arange(len(lang))}).groupby(["h", "lang"], sort=False)["at"].agg(["size", "first"])
        by_order[k] = (above[table["first"].to_numpy(), 1:], table.index.get_level_values("lang").to_numpy(), table["size"].to_numpy(np.float64))
    below = np.full((1, size), 1 / letters)
    for k in range(1, ORDER + 1):
        own, lang, c = by_order[k]
        h, row = np.unique(_hash(own), return_inverse=True)
        first = np.zeros(len(h), np.int64)
        first[row] = np.arange(len(row))
        own = own[first]
        n = np.zeros((len(h), size))
        np.add.at(n, (row, lang), c[:len(row)])
        ctx, ctx_row = np.unique(_hash(own[:, :-1]), return_inverse=True)
        total, kinds = np.zeros((len(ctx), size)), np.zeros((len(ctx), size))
        np.add.at(total, ctx_row, n)
        np.add.at(kinds, ctx_row, n > 0)
        ones, twos = (n == 1).sum(axis=0), (n == 2).sum(axis=0)
        discount = np.where(ones > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5).clip(0.1, 0.9)
        gamma = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        shorter = np.zeros(len(h), np.int64) if k == 1 else np.searchsorted(grams[-1], _hash(own[:, 1:]))
        p = np.maximum(n - discount, 0) / np.maximum(total, 1)[ctx_row] + gamma[ctx_row] * below[shorter]
        below = p
        grams.append(h)
        logp.append(np.log(p).astype(np.float32))
        contexts.append(ctx)
        weights.append(np.log(gamma).astype(np.float32))
    floor = (weights[0][0] - np.log(letters)).astype(np.float32) if len(weights[0]) else np.zeros(size, np.float32)
    return Model(langs, grams, logp, contexts, weights, floor)


def _calibrate(model: Model, rows: pd.DataFrame) -> None:
    """Scale of the scores by the lowest log loss."""
    if rows.empty:
        return
    ce, size = np.array(rows["ce"].tolist()), rows["size"].to_numpy(np.float64)
    truth = rows["lang"].map({x: i for i, x in enumerate(model.langs)}).to_numpy()
    losses = []
    for scale in 2.0 ** np.arange(0, 10):
        model.scale = scale
        losses.append((-np.log(model.posterior(ce, size)[np.arange(len(ce)), truth] + 1e-12).mean(), scale))
    model.scale = min(losses)[1]


def _limits(model: Model, scored: DataFrame) -> np.ndarray:
    """Limit of each language: a quantile of its cross-entropy over all of its rows in ``scored`` (lang, ce). One row a language."""
    limit = np.full(len(model.langs), np.inf)
    place = F.array_position(F.array(*[F.lit(x) for x in model.langs]), F.col("lang")).cast("int")
    own = scored.select((place - 1).alias("x"), F.try_element_at("ce", F.nullif(place, F.lit(0))).alias("own"))
    for r in own.groupBy("x").agg(F.percentile_approx("own", 1 - REJECTED_SHARE, QUANTILE_STEPS).alias("q")).filter("x >= 0").collect():
        limit[r.x] = r.q * SLACK
    return limit


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Count over all learning documents, build and calibrate.

    Learning documents have a language and are outside the held-out third; null ids are in it.
    The driver gets at most MODEL_GRAMS counts and CALIBRATION rows of numbers; with more counts the model is spread.
    """
    learning = _own(docs, doc_id, text, lang).filter("learns")
    model = _learnt(learning)
    _fit(model, saved(_scored(learning, model, ["doc_id", "lang"]), "entropies"))
    return model


def identify_own(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``identify(docs, train(docs))``, with each text scored once."""
    own = _own(docs, doc_id, text, lang)
    model = _learnt(own.filter("learns"))
    if not model.langs:
        return identify(docs, replace(model, limit=np.zeros(0)), doc_id, text)
    scored = saved(_scored(own, model, ["doc_id", "lang", "learns"]), "entropies")
    _fit(model, scored.filter("learns"))
    return _named(scored, model)


def _own(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """(doc_id, text, lang, learns): a document with a language outside the held-out third is learnt from."""
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    return own.withColumn("learns", F.col("lang").isNotNull() & ~held_out())


def _learnt(learning: DataFrame) -> Model:
    """The model of all learning documents, in the arrays of one process or spread."""
    counts = saved(corpus_counts(learning), "grams")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    most = min(MODEL_GRAMS, MODEL_NUMBERS // max(1, len(langs)))
    return build(counts.toPandas()) if counts.count() <= most else spread(counts, langs)


def _fit(model: Model, scored: DataFrame) -> None:
    """Scale and limits of a model from all of its scored learning documents (doc_id, lang, ce, size)."""
    chosen = scored.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION).distinct()
    known = scored.filter("size > 0")
    # at most CALIBRATION rows
    rows = known.join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "ce", "size").limit(2 * CALIBRATION).toPandas()
    _calibrate(model, rows[rows["lang"].isin(model.langs)])
    model.limit = _limits(model, known)


def _scored(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    if isinstance(model, Spread):
        return _spread_scored(docs, model, carry)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(t: pa.Array) -> list[pa.Array]:
        ce, size = known.value.entropies(t)
        return [_lists(ce), pa.array(size, pa.float64())]

    fields = [T.StructField("ce", T.ArrayType(T.DoubleType())), T.StructField("size", T.DoubleType())]
    return map_text(docs, "text", carry, fields, run, limit=2 * SLICE_BYTES)


def _lists(matrix: np.ndarray) -> pa.Array:
    """A list of numbers for each row."""
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(matrix.ravel(), pa.float64()))


def _predictions(model: Model, ce: np.ndarray, size: np.ndarray) -> list[pa.Array]:
    """lang_pred, score, cross_entropy, rejected."""
    best = ce.argmin(axis=1)
    some, rows = size > 0, np.arange(len(size))
    own = ce[rows, best]
    score = np.where(some, model.posterior(ce, size)[rows, best], 0.0)
    names = [model.langs[x] if s else UNKNOWN for x, s in zip(best.tolist(), some.tolist(), strict=True)]
    return [pa.array(names, pa.string()), pa.array(score), pa.array(own, pa.float64(), mask=~some), pa.array(~some | (own > model.limit[best]))]


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
          T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())]


def _named(scored: DataFrame, model: Model) -> DataFrame:
    """Predictions of scored rows (doc_id, ce, size)."""
    scored = scored.select("doc_id", "ce", "size")
    schema = T.StructType([scored.schema["doc_id"], *FIELDS])
    m = Model(model.langs, [], [], [], [], model.floor, model.scale, model.limit)

    def run(batches):
        for b in batches:
            ce = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(m.langs))
            yield pa.RecordBatch.from_arrays([b.column(0), *_predictions(m, ce, b.column(2).to_numpy(zero_copy_only=False))], names=schema.names)

    return scored.mapInArrow(run, schema).select("doc_id", held_out().alias("held_out"), *schema.names[1:])


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, cross_entropy, rejected) for each row.

    ``lang_pred`` is a learnt language, or ``und`` with score 0 if the text is null or has no
    letter, or nothing was learnt. ``rejected``: the cross-entropy exceeds the language's
    limit, or there is no language. Equal cross-entropies go to the first language in order.
    """
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    if isinstance(model, Spread):
        return _named(_scored(own, model, ["doc_id"]), model)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(t: pa.Array) -> list[pa.Array]:
        if not known.value.langs:
            return [pa.array([UNKNOWN] * len(t)), pa.array(np.zeros(len(t))), pa.nulls(len(t), pa.float64()), pa.array(np.ones(len(t), bool))]
        return _predictions(known.value, *known.value.entropies(t))

    return map_text(own, "text", ["doc_id"], FIELDS, run, limit=2 * SLICE_BYTES).select("doc_id", held_out().alias("held_out"), *(f.name for f in FIELDS))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify_own(docs)
